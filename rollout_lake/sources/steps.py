"""Records of a step that appear as a whole or not at all: a data source whose commit writes a manifest.

``df.write.format("step_records").option("path", p).option("split", "train").option("step", 3).mode("append").save()``
writes the rows into files of their own names; they count only once the step's manifest names them. A task that fails, or a
job that ends early, leaves no visible row, and a step that is written again replaces itself. Reading returns the
rows of all manifests, with ``split`` and ``step``. The folder must be one that all executors reach, by any scheme pyarrow knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _manifests(path: str, split: str | None = None) -> list[dict]:
    store, folder = _store(path)
    listed = store.get_file_info(fs.FileSelector(f"{folder}/_manifests", allow_not_found=True))
    out = []
    for info in listed:
        if info.base_name.startswith("step-"):
            with store.open_input_stream(info.path) as file:
                out.append(json.loads(file.read()))
    return sorted((m for m in out if split in (None, m["split"])), key=lambda m: (m["split"], m["step"]))


def next_step(path: str, split: str) -> int:
    """Step to continue with: one after the last step whose manifest is there, 1 for none."""
    return max((m["step"] for m in _manifests(path, split)), default=0) + 1


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class StepWriter(DataSourceArrowWriter):
    def __init__(self, path: str, split: str, step: int, schema: StructType):
        self.path, self.split, self.step = path, split, step
        self.schema = to_arrow_schema(schema)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _store(self.path)
        store.create_dir(f"{folder}/data")
        name = f"data/{self.split}-{self.step}-{uuid.uuid4().hex}.parquet"
        rows = 0
        with store.open_output_stream(f"{folder}/{name}") as out, pq.ParquetWriter(out, self.schema) as file:
            for batch in iterator:
                file.write_batch(batch.cast(self.schema))
                rows += len(batch)
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        """The manifest replaces that of an earlier try in one move; the files that this one named are removed after."""
        store, folder = _store(self.path)
        name = f"{folder}/_manifests/step-{self.split}-{self.step}.json"
        before = [m for m in _manifests(self.path, self.split) if m["step"] == self.step]
        store.create_dir(f"{folder}/_manifests")
        kept = [m for m in messages if m is not None]
        told = {"split": self.split, "step": self.step, "files": [m.file for m in kept if m.rows], "rows": sum(m.rows for m in kept)}
        draft = f"{folder}/_manifests/.draft-{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            out.write(json.dumps(told).encode())
        store.move(draft, name)
        self._remove([m.file for m in kept if not m.rows] + [f for m in before for f in m["files"]])

    def abort(self, messages: list[Written | None]) -> None:
        self._remove([m.file for m in messages if m is not None])

    def _remove(self, files: list[str]) -> None:
        store, folder = _store(self.path)
        for file in files:
            store.delete_file(f"{folder}/{file}")


@dataclass
class StepFile(InputPartition):
    file: str
    split: str
    step: int


class StepReader(DataSourceReader):
    def __init__(self, path: str, split: str | None, schema: StructType):
        self.path, self.split = path, split
        self.schema = to_arrow_schema(schema)

    def partitions(self) -> list[StepFile]:
        return [StepFile(f, m["split"], m["step"]) for m in _manifests(self.path, self.split) for f in m["files"]] or [StepFile("", "", 0)]

    def read(self, partition: StepFile) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, folder = _store(self.path)
        own = [n for n in self.schema.names if n not in ("split", "step")]
        with store.open_input_file(f"{folder}/{partition.file}") as file:
            for batch in pq.ParquetFile(file).iter_batches(columns=own):
                n = len(batch)
                columns = {**dict(zip(batch.schema.names, batch.columns)), "split": pa.array([partition.split] * n), "step": pa.array([partition.step] * n)}
                yield pa.RecordBatch.from_arrays([columns[c] for c in self.schema.names], self.schema.names).cast(self.schema)


class StepRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "step_records"

    def schema(self) -> str:
        raise ValueError("give the schema of the records, with split string and step bigint if they are wanted")

    def writer(self, schema: StructType, overwrite: bool) -> StepWriter:
        return StepWriter(self.options["path"], self.options["split"], int(self.options["step"]), schema)

    def reader(self, schema: StructType) -> StepReader:
        return StepReader(self.options["path"], self.options.get("split"), schema)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(StepRecords)
