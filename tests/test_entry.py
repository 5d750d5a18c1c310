"""The entry in copies of the library without its optional parts."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


@pytest.mark.parametrize("without", [["rollout_lake/llm"], ["rollout_lake/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_optional_parts(tmp_path, without):
    left = shutil.ignore_patterns("__pycache__", ".git", "tests")
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda d, names: {*left(d, names), *[n for n in names if str((Path(d) / n).relative_to(ROOT)) in without]})
    done = subprocess.run([sys.executable, "-c", SAY], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    assert done.returncode == 0, done.stderr
    queries, oracles = (set(x.split()) for x in done.stdout.strip().split("\n"))
    assert len(queries) > 200 and oracles <= queries
    assert "pipeline" not in queries
    if "rollout_lake/llm" in without:
        assert not [q for q in queries if q.startswith("op")]
