"""Golden literals for text, answers and code helpers."""

import re

import pytest
from pyspark.sql import functions as F

from rollout_lake.functions import answers as X
from rollout_lake.functions import text as T


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "s string").select(fn(F.col("s")).alias("r")).first()["r"]


def two(spark, a, b, fn):
    return spark.createDataFrame([(a, b)], "a string, b string").select(fn(F.col("a"), F.col("b")).alias("r")).first()["r"]


def check(spark, cases, fn):
    """All cases of a function in one plan."""
    rows = [(i, c[0]) for i, c in enumerate(cases)]
    got = spark.createDataFrame(rows, "i int, s string").select("i", fn(F.col("s")).alias("r")).collect()
    wrong = [(cases[r["i"]][0], r["r"], cases[r["i"]][1]) for r in got if r["r"] != cases[r["i"]][1]]
    assert not wrong


def check_pairs(spark, cases, fn):
    rows = [(i, c[0], c[1]) for i, c in enumerate(cases)]
    got = spark.createDataFrame(rows, "i int, a string, b string").select("i", fn(F.col("a"), F.col("b")).alias("r")).collect()
    wrong = [(cases[r["i"]], r["r"]) for r in got if r["r"] != cases[r["i"]][2]]
    assert not wrong


NORMALISE_CASES = [
    ("007", "7"), ("0000", "0"), ("5中m", "5中m"), ("\u30005 m\u3000", "5"),
    (r"\frac12", r"\frac{1}{2}"), (r"\dfrac{1}{2}", r"\frac{1}{2}"), (r"\frac1{72}", r"\frac{1}{72}"), ("1/2", r"\frac{1}{2}"),
    (r"\sqrt3", r"\sqrt{3}"), ("x = 5", "5"), ("5.000", "5"), (r"50\%", "50"), ("$3.50", "3.50"), ("three hundred", "300"),
    ("twenty one", "21"), ("12 hours", "12"), (r"30^\circ", "30"), (".5", "0.5"), (r"\text{Tuesday}", "Tuesday"), ("5.", "5"),
    (r"\left(1,2\right)", "(1,2)"), ("3 and 4", "34"), ("2j", "2i"), (r"10 \text{ cm}", "10"), ("", ""), ("two point five", "2.5"),
    (r"\frac", r"\frac"), ("infinity", r"\infty"),]


def test_normalise(spark):
    check(spark, NORMALISE_CASES, X.normalise)


NORMALISE_SHORT_CASES = [
    ("0.5", r"\frac{1}{2}"), ("a/b", None), ("1/2", r"\frac{1}{2}"), ("k = 7", "7"), (r"3\text{ cm}", "3"), (r"1\text{ a}\text{ b}", None),
    (r"\sqrt", None), (r"\sqrt2", r"\sqrt{2}"), (r"\frac", None), ("01/2", "01/2"),]


def test_normalise_short(spark):
    check(spark, NORMALISE_SHORT_CASES, X.normalise_short)


NORMALISE_STRICT_CASES = [
    ("7 3/4", "7+3/4"), ("1,234", "1234"), ("5 million", "5 *10^6"), (r"\text{Yes}", "yes"), ("12 cm^2", "12"), ("3.0", "3"), ("- 5", "-5"),
    ("{4}", "4"), (r"\frac{1}{2}", "1/2"),]


def test_normalise_strict(spark):
    check(spark, NORMALISE_STRICT_CASES, X.normalise_strict)


LAST_BOXED_CASES = [
    (r"a \boxed{1} b \boxed{\frac{1}{2}}", r"\boxed{\frac{1}{2}}"), (r"\boxed{a{b{c{d}}}}", r"\boxed{a{b{c{d}}}}"), (r"\boxed 5$ x", r"\boxed 5"),
    ("none", None), (r"\fbox{3}", r"\fbox{3}"), (r"\boxed{open", None),]


def test_last_boxed(spark):
    check(spark, LAST_BOXED_CASES, X.last_boxed)


def test_boxed_depth_and_tail(spark):
    assert one(spark, r"\boxed{a{b{c}}} ", X.last_boxed_in_tail) == r"\boxed{a{b{c}}}"
    assert one(spark, r"\boxed{1}" + "x" * 1500, X.last_boxed_in_tail) is None
    assert one(spark, "x{" * 20000 + r"\boxed{y}", X.boxed_content) == "y"


MATH_EQUAL_CASES = [
    ("1/2", "0.5", False), ("0.5", "50%", True), ("50", "0.5", True), ("(1, 2)", "(1,2)", True), ("[1.0,2]", "[1,2]", True), ("x=5", "5", True),
    ("B", "B", True), ("(b)", "B", True), ("3.00001", "3", True), ("3.1", "3", False), (None, "3", False), ("", "3", False), ("ABC", "abc", True),
    (r"\begin{pmatrix}1&2\\3&4\end{pmatrix}", r"\begin{pmatrix}1.0&2\\3&4\end{pmatrix}", True),
    (r"\begin{pmatrix}1&2\\3&4\end{pmatrix}", r"\begin{pmatrix}1&2\\3&5\end{pmatrix}", False), ("x=5", "y=5", False),]


def test_math_equal(spark):
    check_pairs(spark, MATH_EQUAL_CASES, X.math_equal)


GRADE_STRICT_CASES = [
    ("1/2", "1/2", True), ("2/4", "1/2", False), ("5", "5.0", True), ("5", "6", False), ("(1,2)", "(1,2)", True), ("[1,2]", "(1,2)", False),
    ("(1,2)", "(1,2,3)", False), ("1,000", "1000", True),]


def test_grade_strict(spark):
    check_pairs(spark, GRADE_STRICT_CASES, X.grade_strict)


CHOICE_CASES = [
    ("The answer is B.", "B"), ("choice is (c)", "C"), ("no letter here", "no letter here"), ("A then D", "D"), ("answer is A or B", "A"),]


def test_choice(spark):
    check(spark, CHOICE_CASES, X.choice_answer)


def test_interval_and_matrix(spark):
    assert one(spark, "Interval.open(a, b)", X.interval_text) == "(a, b)"
    assert one(spark, "Interval(a, b)", X.interval_text) == "[a, b]"
    assert one(spark, "{a,b}", X.set_to_matrix) == r"\begin{pmatrix}a\b\end{pmatrix}"


def test_number_forms(spark):
    assert one(spark, r"2\pi", lambda c: X.normalise_number(c, 3.14)) == "6.28"
    assert one(spark, "101_2", X.normalise_number) == "101"
    assert one(spark, "$5.50", X.normalise_number) == "5.50"
    assert one(spark, "5%", X.normalise_number) == "5"


def test_match_answer(spark):
    got = one(spark, "We think. The answer is 42", X.match_answer)
    assert (got["matched"], got["answer"]) == (True, "42")
    assert one(spark, "The answer is unknown", X.match_answer)["matched"] is False


def test_hash_and_think(spark):
    assert one(spark, "x #### 1,234", X.hash_answer) == "1234"
    assert one(spark, "a 5 then 7.", lambda c: X.hash_answer(c, "flexible")) == "7."
    text = r"<think>a</think> \boxed{3}"
    assert abs(two(spark, text, "3", X.think_score) - 1.0) < 1e-12
    assert abs(two(spark, text, "4", X.think_score) - 0.1) < 1e-12


def test_code_blocks_and_lines(spark):
    text = "say\n```python\nx = 1\n# c\n\ny = 2\n```\nafter ```py\nz\n```"
    assert one(spark, text, T.first_code) == "x = 1\n# c\n\ny = 2"
    assert one(spark, text, T.cut_after_code) == text[: text.index("\nafter")]
    n = one(spark, "x = 1\n# c\n\ny = 2\n", T.count_lines)
    assert (n["total_lines"], n["code_lines"]) == (4, 2)
    assert one(spark, "", T.count_lines)["total_lines"] == 0


def test_truncation_keeps_the_longer_tail(spark):
    got = one(spark, "abcdefghij", lambda c: T.truncate_middle(c, 5, "|"))
    assert got == "ab|hij"


def _spans(text):
    """Brute force over the protocol: label, blanks, content up to a fence or the end."""
    out, at = [], 0
    while True:
        m = re.compile(r"code execution result:", re.I).search(text, at)
        if not m:
            return out
        fence = text.find("```", m.end())
        end = fence if fence >= 0 else len(text)
        body = text[m.end():end].strip().lower()
        out.append((m.start(), end, any(w in body for w in ("err", "timeout", "exception", "traceback")) or body in ("", "[]", "none")))
        at = end


@pytest.mark.parametrize("text", [
    "a Code execution result: 1```b```Code execution result:\nValueError", "no label", "Code execution result:", "Code execution result: []```x Code execution result: ok",
    "é Code Execution Result: none```", "x" * 30000 + "Code execution result: fine```" + "y" * 30000,
])
def test_observation_spans(spark, text):
    got = [(s["start"], s["end"], s["has_error"]) for s in one(spark, text, T.find_observations)]
    assert got == _spans(text)


def test_labels_are_masked_up_to_the_last_failure(spark):
    text = "plan it Code execution result: Error x``` more words Code execution result: 4``` end"
    words = text.split(" ")
    labels = F.transform(F.split("s", " "), lambda _, i: i.cast("bigint"))
    got = one(spark, text, lambda c: T.mask_labels(c, labels))
    kept = [w for w, x in zip(words, got) if x != -100]
    assert kept == ["more", "words", "end"]


ONLY_FINAL_ANSWER_CASES = [
    ("final_answer(3)", True), ('"""d"""\nfinal_answer(x)', True), ("x = 1\nfinal_answer(x)", False), ("final_answer(", False), ("print(final_answer)", False),
]


def test_only_final_answer(spark):
    check(spark, ONLY_FINAL_ANSWER_CASES, T.is_only_final_answer)


def test_only_final_answer_and_loading(spark, tmp_path):
    from rollout_lake.functions.registry import load_reward_function

    cases = [("final_answer(1)", True), ('"doc"\nfinal_answer(x)', True), ("x = 1\nfinal_answer(x)", False), ("final_answer", False),
             ("obj.final_answer(1)", False), ('"a"\n"b"\nfinal_answer(1)', False), ("", False), (None, False), ("(", False)]
    check(spark, cases, T.is_only_final_answer)
    source = tmp_path / "r.py"
    source.write_text("BASE = 2\ndef reward(x):\n    return BASE * x\n")
    assert load_reward_function(str(source), "reward")(3) == 6
    for path, name in ((source, "other"), (tmp_path / "none.py", "reward")):
        with pytest.raises(LookupError):
            load_reward_function(str(path), name)
