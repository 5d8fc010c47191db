"""Files in and out: suffix dispatch, skip-if-present writes, keyed stages."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping
from pathlib import PurePosixPath
from typing import Any
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGE_VERSION = 1
_FORMATS = {"json": "json", "jsonl": "json", "csv": "csv", "parquet": "parquet", "orc": "orc", "txt": "text"}


def load_by_suffix(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Read a file or directory by its suffix; pass a schema to avoid inference."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lstrip(".").lower()
    if suffix not in _FORMATS:
        raise ValueError(f"cannot tell the format of {path!r}; known suffixes: {sorted(_FORMATS)}")
    fmt = _FORMATS[suffix]
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    if fmt == "csv":
        # Texts hold line breaks and quotes.
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.load(path)


def exists(spark: SparkSession, path: str) -> bool:
    """True when the path exists, on whatever file system it names."""
    try:
        spark.read.format("text").load(path).schema  # noqa: B018  the path is looked up here
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def complete(spark: SparkSession, path: str) -> bool:
    """True when a finished write is there (an aborted one leaves no marker)."""
    return exists(spark, path.rstrip("/") + "/_SUCCESS")


def write_jsonl(df: DataFrame, path: str) -> bool:
    """Write JSON lines unless a finished output is there; True when written."""
    if complete(df.sparkSession, path):
        return False
    df.write.mode("overwrite").json(path)
    return True


def write_train_test(train: DataFrame, test: DataFrame | None, path: str, name: str) -> bool:
    """``{name}_train.jsonl`` and ``{name}_test.jsonl``; nothing when train exists.

    The test part goes first, so that a finished train part means both are there.
    """
    target = f"{path.rstrip('/')}/{name}"
    if complete(train.sparkSession, f"{target}_train.jsonl"):
        return False
    if test is not None:
        test.write.mode("overwrite").json(f"{target}_test.jsonl")
    train.write.mode("overwrite").json(f"{target}_train.jsonl")
    return True


def stage_key(**parameters: Any) -> str:
    """md5 over all parameters and the stage version."""
    text = json.dumps({"version": STAGE_VERSION, **parameters}, sort_keys=True, default=str)
    return hashlib.md5(text.encode()).hexdigest()


def keyed_stage(df: DataFrame, root: str, parameters: Mapping[str, Any]) -> DataFrame:
    """Write once per parameter set as Parquet, then read that copy.

    Also the way to cut a long lineage: executors may be lost, the table stays.
    """
    spark = df.sparkSession
    path = f"{root.rstrip('/')}/key={stage_key(**parameters)}"
    if not complete(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plan_key(df: DataFrame) -> str:
    """md5 over the plan, without the numbers of its columns, and over the path, size and time of
    every file it reads.

    Rows that were handed over by the driver are not in it; name those in the parameters.
    """
    spark = df.sparkSession
    plan = re.sub(r"#\d+L?|@[0-9a-f]+", "", df._jdf.queryExecution().optimizedPlan().toString())
    files, seen = df.inputFiles(), None
    if files:
        folders = sorted({f.rpartition("/")[0] for f in files})
        listing = spark.read.format("binaryFile").load([unquote(f) for f in folders])
        one = F.xxhash64("path", F.unix_micros("modificationTime"), "length")
        seen = tuple(listing.agg(F.bit_xor(one), F.count("*"), F.sum("length")).first())
    return hashlib.md5(repr((plan, len(files), seen)).encode()).hexdigest()


def planned_stage(df: DataFrame, root: str, parameters: Mapping[str, Any] | None = None) -> DataFrame:
    """A stage that is made anew when its plan or the files below it have changed."""
    return keyed_stage(df, root, {**(parameters or {}), "plan": plan_key(df)})


def write_by_status(df: DataFrame, path: str, append: bool = False) -> None:
    """Successes and errors in one pass, one directory each."""
    df.write.mode("append" if append else "overwrite").partitionBy("status").json(path)


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths of existing files below a directory, relative to it; contents are not read.

    The listing names scheme and host, which the caller's root may lack, so paths are compared
    from the root on.
    """
    root = re.sub(r"^\w+:(//[^/]*)?", "", path).strip("/")
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return listing.select(F.regexp_replace("path", rf"^(\w+:)?/*([^/]+/)??{re.escape(root)}/+", "").alias("path"))
