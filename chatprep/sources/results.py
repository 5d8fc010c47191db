"""Benchmark result documents, metric logs and checkpoint names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep import schemas


def result_documents(runs: DataFrame, model: str = "model", benchmark: str = "bench") -> DataFrame:
    """One JSON document per model from run rows.

    A row is one benchmark at one configuration with its array of run metrics.  The
    number of rows per model is configurations times benchmarks: a report, not data.
    """
    entry = F.struct(*CONFIG, "metrics", "num_samples")
    per_bench = runs.groupBy(model, benchmark).agg(
        F.array_sort(F.collect_list(entry), _by(*CONFIG)).alias("results")
    )
    listed = F.array_sort(F.collect_list(F.struct(F.col(benchmark).alias("name"), "results")), _by("name"))
    whole = per_bench.groupBy(model).agg(F.map_from_entries(listed).alias("benchmarks"))
    return whole.select(F.to_json(F.struct(F.col(model).alias("model"), "benchmarks")).alias("value"))


CONFIG = ("batch_size", "steps", "topk", "num_draft_tokens")


def _by(*fields: str):
    """Comparator on some fields (the others may have no order)."""

    def key(x):
        return F.struct(*[x[f].alias(f) for f in fields])

    return lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def write_results(runs: DataFrame, path: str, name: str = "") -> str:
    """Write the documents under a time-stamped name and return it."""
    from datetime import datetime

    stamp = datetime.now().strftime("%Y%m%d_%H%M%S")
    target = f"{path.rstrip('/')}/{name + '_' if name else ''}results_{stamp}.jsonl"
    result_documents(runs).write.text(target)
    return target


def parse_documents(df: DataFrame, column: str = "value") -> DataFrame:
    """JSON documents whose keys are data, as nested maps."""
    return df.select(F.from_json(column, schemas.RESULT_DOCUMENT).alias("document"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return parse_documents(spark.read.text(path, wholetext=True))


def log_metrics(df: DataFrame, path: str) -> None:
    """Append to the long metric table."""
    df.write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.METRIC_LOG).parquet(path)


def melt_metrics(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Wide to long: one row per metric value."""
    return df.unpivot(keys, metrics, "metric", "value")


def last_checkpoint(names: DataFrame, column: str = "path", prefix: str = "epoch") -> DataFrame:
    """``(path, epoch, step)`` of the latest ``{prefix}_X[_step_Y]`` directory.

    A missing step counts as 0; without any match the row is ``(null, 0, 0)``.  A number
    beyond 64 bits is an error.
    """
    pattern = rf"(?:^|/){re.escape(prefix)}_(\d+)(?:_step_(\d+))?/?\z"
    c = F.col(column)

    def number(group: int) -> Column:
        digits = F.regexp_extract(c, pattern, group)
        too_long = F.raise_error(F.concat(F.lit("not a 64-bit number in checkpoint name "), c)).cast("bigint")
        return F.when(digits == "", F.lit(0).cast("bigint")).otherwise(F.coalesce(digits.try_cast("bigint"), too_long))

    order = F.struct(number(1).alias("epoch"), number(2).alias("step"))
    found = names.filter(F.regexp_like(c, F.lit(pattern))).agg(
        F.max_by(c, order).alias("path"), F.max(order).alias("at")
    )
    return found.select(
        "path",
        F.coalesce("at.epoch", F.lit(0)).alias("epoch"),
        F.coalesce("at.step", F.lit(0)).alias("step"),
    )
