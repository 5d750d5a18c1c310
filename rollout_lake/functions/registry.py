"""Registries of reward functions and reward managers, and the adapters around user code."""

from __future__ import annotations

import runpy
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, MapType, StringType, StructField, StructType

from .text import find_observations

RESULT = StructType([
    StructField("score", DoubleType()),
    StructField("is_filter", IntegerType()),
    StructField("extra_info", MapType(StringType(), DoubleType())),
])

RewardFn = Callable[[Column, Column, Column, Column], Column]


def coerce_result(result) -> dict:
    """Number, {score, extra_info} or a sequence whose first item is the score, as one record."""
    if isinstance(result, dict):
        extra = {k: float(v) for k, v in (result.get("extra_info") or {}).items()}
        return {"score": float(result["score"]), "is_filter": int(extra.pop("is_filter", 0)), "extra_info": extra}
    value = result if isinstance(result, (int, float)) else result[0]
    return {"score": float(value), "is_filter": 0, "extra_info": {}}


FAILED = {"score": 0.0, "is_filter": 1, "extra_info": {}}


def python_reward(fn: Callable) -> RewardFn:
    """A user function (data_source, solution, ground_truth, extra_info) as a vectorised column builder.

    A row the function fails on scores zero and is marked for filtering.
    """
    def one(source, solution, truth, extra):
        try:
            return coerce_result(fn(source, solution, truth, extra))
        except Exception:  # noqa: BLE001  user code: any failure is a filtered row
            return dict(FAILED)

    @F.pandas_udf(RESULT)
    def run(source: pd.Series, solution: pd.Series, truth: pd.Series, extra: pd.Series) -> pd.DataFrame:
        rows = [one(*args) for args in zip(source, solution, truth, extra)]
        return pd.DataFrame(rows, columns=["score", "is_filter", "extra_info"])

    return run


def column_reward(builder: Callable[[Column, Column, Column, Column], Column]) -> RewardFn:
    """A scoring expression as a reward function with the common result record."""
    def run(source, solution, truth, extra):
        score = builder(source, solution, truth, extra).cast("double")
        empty = F.create_map().cast("map<string,double>")
        return F.struct(
            F.coalesce(score, F.lit(0.0)).alias("score"), F.when(score.isNull(), 1).otherwise(0).alias("is_filter"),
            empty.alias("extra_info"),
        )

    return run


def load_reward_function(path: str, name: str) -> Callable:
    """What a Python file binds to ``name``; ``LookupError`` if it cannot be run or binds no such name."""
    try:
        return runpy.run_path(path)[name]
    except Exception as cause:
        raise LookupError(f"no function {name!r} from {path!r}") from cause


class Registry:
    """Names to functions; a name can be taken once."""

    def __init__(self, kind: str):
        self.kind = kind
        self._items: dict[str, Callable] = {}

    def add(self, name: str, fn: Callable) -> Callable:
        if name in self._items:
            raise ValueError(f"{self.kind} {name!r} exists")
        self._items[name] = fn
        return fn

    def get(self, name: str) -> Callable:
        if name not in self._items:
            raise NotImplementedError(f"unknown {self.kind} {name!r}")
        return self._items[name]

    def names(self) -> list[str]:
        return sorted(self._items)


REWARDS = Registry("reward function")
MANAGERS = Registry("reward manager")


def apply_reward(df: DataFrame, name: str, source: str, solution: str, truth: str, extra: str) -> DataFrame:
    fn = REWARDS.get(name)
    return df.withColumn("result", fn(F.col(source), F.col(solution), F.col(truth), F.col(extra)))


def map_shards(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """A function over every shard of rows, results put together again."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield fn(pdf)

    return df.mapInPandas(run, schema)


def coerce_column(result: Column) -> Column:
    """The common record from a recorded result, JSON text: a number, {score, extra_info} or a list whose first item is the score.

    A text that is none of these scores zero and is marked for filtering.
    """
    value = F.try_parse_json(result)

    def at(path: str, kind: str) -> Column:
        return F.try_variant_get(value, path, kind)

    extra = F.coalesce(at("$.extra_info", "map<string,double>"), F.create_map().cast("map<string,double>"))
    score = F.coalesce(at("$.score", "double"), at("$[0]", "double"), at("$", "double"))
    marked = F.coalesce(F.try_element_at(extra, F.lit("is_filter")).cast("int"), F.lit(0))
    return F.struct(
        F.coalesce(score, F.lit(0.0)).alias("score"), F.when(score.isNull(), 1).otherwise(marked).alias("is_filter"),
        F.map_filter(extra, lambda k, _: k != "is_filter").alias("extra_info"),
    )


def observation_rows(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """A row for each observation of a transcript: ``start, end, has_error`` beside the columns kept."""
    spans = df.select(*keep, F.explode(find_observations(F.col(text))).alias("s"))
    return spans.select(*keep, "s.*")
