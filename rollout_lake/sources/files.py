"""Readers and writers for prompt sets, records, snapshots and metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_parquet_list(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several parquet files as one dataset; a column some files lack is null there."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def stamp_source(df: DataFrame, column: str = "data_source") -> DataFrame:
    """Overwrite the source with the last two path components of the row's file."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    return df.withColumn(column, F.array_join(F.slice(parts, F.size(parts) - 1, F.lit(2)), "/"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON Lines; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON Lines in UTF-8, non-ASCII text as it is, nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")))


def cached_dataset(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The prepared dataset at ``path``; built and written first when it is not complete there."""
    if not path_exists(spark, path):
        built = build()
        write_jsonl(built, path, mode="overwrite")
        schema = built.schema
    else:
        schema = build().schema
    return read_jsonl(spark, path, schema)


def generations(prompts: DataFrame, samples: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Prompt rows, one for each prompt, with their responses as an array in sample order.

    ``order`` is the number of the sample within its prompt. A prompt's samples must fit into one row.
    """
    listed = F.sort_array(F.collect_list(F.struct(order, text)))
    arrays = samples.groupBy(key).agg(F.transform(listed, lambda s: s[text]).alias("responses"))
    return prompts.join(arrays, key, "left")


def append_records(records: DataFrame, path: str, split: str, step: int) -> None:
    """Append scored records of a step; training and validation are separate partitions."""
    stamped = records.withColumns({"split": F.lit(split), "step": F.lit(step)})
    stamped.write.mode("append").partitionBy("split", "step").json(path)


def next_step(spark: SparkSession, path: str, split: str) -> int:
    """Step to continue with: one after the last step written for the split, 1 for none."""
    if not path_exists(spark, path):
        return 1
    # only the folders' names are read: a binary file's content is not, unless it is selected
    folders = spark.read.format("binaryFile").load(path).select("split", "step")
    last = folders.where(F.col("split") == split).agg(F.max("step").alias("s")).first()["s"]
    return 1 if last is None else last + 1


def step_from_file_name(name: Column, prefix: str = "step-") -> Column:
    """Step number in a file's name or path, as in ``_metadata.file_name``; zero when it has none."""
    found = F.regexp_extract(name, rf"{prefix}(\d+)\.", 1)
    return F.coalesce(found.try_cast("int"), F.lit(0))


SNAPSHOT_EVERY = 20


def write_snapshots(batches: DataFrame, path: str, step: str = "step", every: int = SNAPSHOT_EVERY) -> None:
    """Full rows of every ``every``-th step, partitioned by step."""
    batches.where(F.col(step) % every == 0).write.mode("append").partitionBy(step).parquet(path)


def profile(df: DataFrame) -> DataFrame:
    """Type, rows, values, minimum, maximum and mean per column, arrays by their elements; one pass."""
    aggs, shapes = [], []
    for field in df.schema.fields:
        kind, c = field.dataType, F.col(field.name)
        is_array = isinstance(kind, T.ArrayType)
        inner = kind.elementType if is_array else kind
        numeric = isinstance(inner, T.NumericType)
        count = F.sum(F.greatest(F.size(c), F.lit(0)).cast("bigint")) if is_array else F.count(c)
        null = F.lit(None).cast("double")
        if numeric and is_array:
            total = F.sum(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x.cast("double")))
            low, high, mean = F.min(F.array_min(c)), F.max(F.array_max(c)), total / count
        elif numeric:
            low, high, mean = F.min(c), F.max(c), F.avg(c)
        else:
            low, high, mean = null, null, null
        aggs.append(F.struct(
            F.lit(field.name).alias("column"), F.lit(kind.simpleString()).alias("type"), F.count(F.lit(1)).alias("rows"),
            count.alias("values"), low.cast("double").alias("min"), high.cast("double").alias("max"), mean.alias("mean"),
        ).alias(f"c{len(shapes)}"))
        shapes.append(f"c{len(shapes)}")
    return df.agg(*aggs).select(F.explode(F.array(*shapes)).alias("p")).select("p.*")


def to_metric_table(wide: DataFrame, step: str) -> DataFrame:
    """One row per step with a column per metric, as (step, metric, value)."""
    names = [c for c in wide.columns if c != step]
    cast = wide.select(step, *[F.col(c).cast("double").alias(c) for c in names])
    return cast.unpivot([step], names, "metric", "value")


def log_metrics(wide: DataFrame, path: str, step: str = "step") -> None:
    to_metric_table(wide, step).write.mode("append").parquet(path)


def metric_line(long: DataFrame, step: str = "step") -> DataFrame:
    """"step:N - name:0.000 - ..." per step, names in order. Steps have one value per metric."""
    item = F.format_string("%s:%.3f", F.col("metric"), F.col("value"))
    body = F.array_join(F.array_sort(F.collect_set(item)), " - ")
    return long.where(F.col("value").isNotNull()).groupBy(step).agg(
        F.concat(F.lit("step:"), F.col(step).cast("string"), F.lit(" - "), body).alias("line")
    )


def validation_lines(metrics: DataFrame) -> DataFrame:
    """"name: value" lines sorted by name."""
    text = F.concat(F.col("metric"), F.lit(": "), F.col("value").cast("string")).alias("value")
    return metrics.orderBy("metric").select(text)


def write_validation(metrics: DataFrame, path: str) -> None:
    validation_lines(metrics).write.mode("overwrite").text(path)


def flatten_columns(df: DataFrame, sep: str = "/") -> DataFrame:
    """Nested structs as flat columns with joined names."""
    def leaves(schema: T.StructType, path: list[str]):
        for f in schema.fields:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, here)
            else:
                yield here

    def reach(path):
        c = F.col(f"`{path[0]}`")
        for p in path[1:]:
            c = c.getField(p)
        return c.alias(sep.join(path))

    return df.select(*[reach(p) for p in leaves(df.schema, [])])
