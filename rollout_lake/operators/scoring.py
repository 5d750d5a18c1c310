"""Score records: failure defaults, routing, code tests."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as ans
from ..functions.text import FENCED, RAN_CODE, first_code, has, is_only_final_answer, replace, run_flags, strip


def settle_score(score: Column, failed: Column) -> Column:
    """Score struct after grading: a failed one counts zero and is marked for filtering."""
    bad = F.coalesce(failed, F.lit(True)) | score.isNull()
    return F.struct(
        F.when(bad, F.lit(0.0)).otherwise(score.cast("double")).alias("score"),
        F.when(bad, F.lit(1)).otherwise(F.lit(0)).alias("is_filter"),
    )


def fill_extra(info: Column, fields: Sequence[str]) -> Column:
    """Extra reward values as a struct of doubles; a missing one is zero."""
    return F.struct(*[F.coalesce(info[f].cast("double"), F.lit(0.0)).alias(f) for f in fields])


def prefer_model_score(rm_score: Column, rule_score: Column) -> Column:
    """The reward model's score where there is one."""
    return F.coalesce(rm_score, rule_score)


def transcript_score(transcript: Column, truth: Column) -> Column:
    """score, is_boxed_ratio and valid_code of a whole transcript.

    The answer is read from the trimmed transcript and compared on the textual and
    numeric rungs; code counts when its block is followed by an execution result.
    """
    def grade(t):
        answer = ans.extract_answer(t, "math")
        return F.struct(
            F.when(ans.math_equal(answer, truth), 1.0).otherwise(0.0).alias("score"),
            ans.last_boxed_in_tail(t).isNotNull().cast("int").alias("is_boxed_ratio"),
        )

    graded = ans.let(ans.trim_transcript(transcript), grade)
    return ans.let(graded, lambda g: F.struct(
        g["score"].alias("score"), g["is_boxed_ratio"].alias("is_boxed_ratio"),
        transcript.rlike(RAN_CODE).cast("int").alias("valid_code"),
    ))


# fixed values: parts of a source name that choose the scorer, in order
MATH_SOURCES = ("simplelr_math_35", "deepscaler", "custom_math_DAPO-Math-17k-Processed", "rstar2_dataset")
CODE_SOURCES = ("code", "LeetCodeDataset")


def route(data_source: Column, math: Column, code: Column) -> Column:
    """Scorer by substring of the data source, math parts first; an unknown source is an error."""
    def any_of(parts):
        hit = F.lit(False)
        for p in parts:
            hit = hit | has(data_source, p)
        return hit

    unknown = F.raise_error(F.concat(F.lit("Unknown data source: "), data_source))
    return F.when(any_of(MATH_SOURCES), math).when(any_of(CODE_SOURCES), code).otherwise(unknown)


def route_exact(data_source: Column, scorers: dict[str, Column]) -> Column:
    """Scorer by exact source name."""
    out = F.raise_error(F.concat(F.lit("Unknown data source: "), data_source))
    for name, scorer in scorers.items():
        out = F.when(data_source == name, scorer).otherwise(out)
    return out


def functional_program(code: Column, func_name: Column, raw_args: Column) -> Column:
    """Code, an instance, and a printed call; arguments are split at a literal backslash-n."""
    lines = F.filter(F.transform(F.split(strip(raw_args), r"\\n"), strip), lambda x: x != "")
    call = F.concat(F.lit("print(sol."), func_name, F.lit("("), F.array_join(lines, ", "), F.lit("))"))
    return F.concat_ws("\n", code, F.lit("sol = Solution()"), call)


TEST_LIST = "array<struct<testtype:string,input:string,output:string,metadata:struct<func_name:string>>>"
TEST_OBJECT = "struct<functional:string,inputs:array<string>,outputs:array<string>,fn_name:string>"


def expand_tests(df: DataFrame, key: str, code: str, truth: str) -> DataFrame:
    """One row per test of every solution that holds code: program, stdin, expected output.

    The ground truth is a list of tests, one program to append, or parallel inputs and
    outputs. ``check_output`` is false for the single-program form.
    """
    c = F.col(code)

    def test(program, stdin, expected, check):
        return F.struct(
            program.alias("program"), stdin.alias("stdin"), expected.alias("expected"), F.lit(check).alias("check_output")
        )

    listed = F.transform(
        F.filter("__list", lambda x: x["testtype"].isin("stdin", "functional")),
        lambda x: F.when(x["testtype"] == "stdin", test(c, x["input"], x["output"], True)).otherwise(
            test(functional_program(c, x["metadata"]["func_name"], x["input"]), F.lit(""), x["output"], True)
        ),
    )
    single = F.array(test(F.concat_ws("\n", c, F.col("__object.functional")), F.lit(""), F.lit(None).cast("string"), False))
    paired = F.zip_with("__object.inputs", "__object.outputs", lambda i, o: test(c, i, o, True))
    bad = F.raise_error(F.lit("ground truth is neither tests, functional nor input/output"))
    tests = F.when(F.col("__list").isNotNull(), listed).when(F.col("__object.functional").isNotNull(), single).when(
        F.col("__object.inputs").isNotNull() & F.col("__object.outputs").isNotNull(), paired
    ).otherwise(bad)
    is_list = F.ltrim(F.col(truth)).startswith("[")
    parsed = df.where(c != "").withColumns({
        "__list": F.when(is_list, F.from_json(truth, TEST_LIST)),
        "__object": F.when(~is_list, F.from_json(truth, TEST_OBJECT)),
    })
    exploded = parsed.select(key, F.posexplode(tests).alias("test_idx", "t"))
    return exploded.select(key, F.col("test_idx").cast("bigint").alias("test_idx"), "t.*")


def judge_tests(tests: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Join the recorded runs; a test passes without stderr and, where checked, with the same stripped output."""
    joined = tests.join(runs.select(key, "test_idx", "stdout", "stderr"), [key, "test_idx"], "left")
    same = ~F.col("check_output") | (strip(F.col("stdout")) == strip(F.col("expected")))
    return joined.withColumn("passed", F.coalesce((F.col("stderr") == "") & same, F.lit(False)))


def code_score(df: DataFrame, judged: DataFrame, key: str, code: str) -> DataFrame:
    """1 when every test passed, 0 on any failure or without code."""
    table = judged.groupBy(key).agg(F.bool_and("passed").alias("__ok"))
    has_code = F.col(code) != ""
    score = F.when(has_code & F.coalesce("__ok", F.lit(True)), 1.0).otherwise(0.0)
    return df.join(table, key, "left").withColumns({"score": score, "valid_code": has_code.cast("int")}).drop("__ok")


PARTIAL_TESTS = 10


def partial_code_score(judged: DataFrame, key: str) -> DataFrame:
    """Full credit when all tests pass, else the share of the first ten that do."""
    early = F.when(F.col("test_idx") < PARTIAL_TESTS, F.col("passed").cast("int"))
    return judged.groupBy(key).agg(
        F.when(F.bool_and("passed"), 1.0).otherwise(F.avg(early)).alias("score")
    )


def same_output(lines: Column, truth: Column) -> Column:
    """Printed lines equal the expected text, as they are or with every line stripped."""
    joined = strip(F.array_join(lines, "\n"))
    trimmed = strip(F.array_join(F.transform(lines, strip), "\n"))
    return (joined == strip(truth)) | (trimmed == strip(truth))


def tool_use(df: DataFrame, runs: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Used code, ran without error, used it for more than handing over the answer."""
    joined = df.withColumn("code", first_code(F.col(text))).join(
        runs.select(*keys, "stdout", "stderr"), list(keys), "left"
    )
    use = F.col("code").isNotNull()
    clean = use & F.coalesce(F.col("stderr") == "", F.lit(False))
    return joined.withColumns({
        "use_code": use.cast("int"),
        "no_bug_code": clean.cast("int"),
        "true_tool_use": (clean & ~is_only_final_answer(F.col("code"))).cast("int"),
    })
