"""Feature store: one row per sample, grouped into row-number buckets.

A store is a folder of writes.  Beside it stand a table of the keys that are stored, bucketed by
key, and a manifest: the files of each write with their sizes, rows and a checksum of their keys.
A write counts from when its manifest is there; what an aborted one left is not looked at.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chatprep import schemas
from chatprep.functions.arrays import has_nan
from chatprep.sources.files import exists

GROUP_SIZE = 2000
KEY_BUCKETS = 64  # of the table of stored keys; large stores take more from the start
FEATURE_ARRAYS = ("hidden_state", "aux_hidden_state")


def bucket_start(index: Column, group_size: int = GROUP_SIZE) -> Column:
    return (F.floor(index / group_size) * group_size).cast("bigint")


def bucket_name(index: Column, group_size: int = GROUP_SIZE) -> Column:
    """``rows_{start}-{end}``."""
    start = bucket_start(index, group_size)
    return F.concat(F.lit("rows_"), start.cast("string"), F.lit("-"), (start + group_size).cast("string"))


def record_name(index: Column, group_size: int = GROUP_SIZE, suffix: str = "") -> Column:
    """``rows_{start}-{end}/data_{index}``."""
    return F.concat(bucket_name(index, group_size), F.lit("/data_"), index.cast("string"), F.lit(suffix))


def valid_features(df: DataFrame, *columns: str) -> DataFrame:
    """Drop records with NaN in any of the feature arrays."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | has_nan(F.col(c))
    return df.filter(~bad)


def rejected_features(df: DataFrame, *columns: str) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | has_nan(F.col(c))
    return df.filter(bad)


def not_stored(samples: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Samples whose record is not in the store yet."""
    return samples.join(stored.select(key), key, "left_anti")


def compute_features(samples: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str = schemas.FEATURE) -> DataFrame:
    """Apply the caller's model to Arrow batches; one pass, nothing kept in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return samples.mapInPandas(run, schema)


def bucketed_table(spark: SparkSession, path: str, schema: str, key: str, buckets: int = KEY_BUCKETS) -> str:
    """The name of a table over a folder that is bucketed and sorted by ``key``.

    Tables that share their buckets are joined by that key where they lie.
    """
    name = "bucketed_" + hashlib.md5(path.encode()).hexdigest()[:16]
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet "
        f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    return name


def save_bucketed(df: DataFrame, path: str, key: str, buckets: int = KEY_BUCKETS) -> DataFrame:
    """Add rows to a bucketed table, one file per bucket; gives the table."""
    schema = ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes)
    name = bucketed_table(df.sparkSession, path, schema, key, buckets)
    df.repartition(buckets, key).write.insertInto(name)
    return df.sparkSession.table(name)


def cluster(samples: DataFrame, index: str = "row", group_size: int = GROUP_SIZE) -> DataFrame:
    """Samples dealt by bucket.  This goes before the features are made: ids move, arrays do not."""
    return samples.repartition(bucket_start(F.col(index), group_size))


def write_features(
    df: DataFrame,
    path: str,
    key: str = "id",
    index: str = "row",
    group_size: int = GROUP_SIZE,
    compression: str = "zstd",
    rows_per_file: int = 0,
) -> None:
    """Add valid records as Parquet, one directory per bucket, and commit them.

    Rows stay in the task that made them; :func:`cluster` the samples before, so that a task opens
    few files.  Rejected records are counted on the way (:func:`writes`).
    """
    spark, root = df.sparkSession, path.rstrip("/")
    write, counts = uuid.uuid4().hex, Observation()
    bad = F.lit(False)
    for c in FEATURE_ARRAYS:
        bad = bad | has_nan(F.col(c))
    marked = df.withColumns({"__bad": bad, "bucket": bucket_start(F.col(index), group_size)})
    marked = marked.observe(counts, F.count_if("__bad").alias("rejected"), F.count(F.lit(1)).alias("rows"))
    writer = marked.filter(~F.col("__bad")).drop("__bad").write.option("compression", compression)
    writer.option("maxRecordsPerFile", rows_per_file).partitionBy("bucket").parquet(f"{root}/write={write}")

    files = f"{root}/write={write}/bucket=*"
    if counts.get["rows"] > counts.get["rejected"]:
        made = spark.read.schema(df.select(key).schema).option("basePath", root).parquet(files)
        save_bucketed(made.select(F.col(key).cast("string").alias("key"), F.lit(write).alias("write")), f"{root}.keys", "key")
        named = made.select("_metadata.file_path", "_metadata.file_size", F.xxhash64(key).alias("hash"))
        listed = named.groupBy("file_path", "file_size").agg(F.count("*").alias("rows"), F.bit_xor("hash").alias("checksum"))
        listed = listed.select(F.lit(write).alias("write"), _inside(F.col("file_path"), root).alias("file"), F.col("file_size").alias("bytes"), "rows", "checksum")
        listed.write.mode("append").parquet(f"{root}.files")
    summary = spark.range(1).select(F.lit(write).alias("write"), *[F.lit(counts.get[c]).cast("bigint").alias(c) for c in ("rows", "rejected")])
    summary.coalesce(1).write.mode("append").parquet(f"{root}.writes")


def _inside(file: Column, root: str) -> Column:
    """A file's path below the store; listings name scheme and host, which the caller's path may lack."""
    folder = re.sub(r"^\w+:(//[^/]*)?", "", root).strip("/")
    return F.element_at(F.split(F.url_decode(file), f"/{re.escape(folder)}/"), -1)


def writes(spark: SparkSession, path: str) -> DataFrame:
    """``write, rows, rejected`` of all committed writes."""
    folder = f"{path.rstrip('/')}.writes"
    schema = "write string, rows bigint, rejected bigint"
    return spark.read.schema(schema).parquet(folder) if exists(spark, folder) else spark.createDataFrame([], schema)


def _committed(spark: SparkSession, path: str) -> Column:
    return F.col("write").isin([r.write for r in writes(spark, path).select("write").collect()])  # one row per write


def stored_keys(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """Keys of committed records, bucketed."""
    name = bucketed_table(spark, f"{path.rstrip('/')}.keys", "key string, write string", "key")
    return spark.table(name).filter(_committed(spark, path)).select(F.col("key").alias(key))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All committed records with their ``bucket``."""
    return spark.read.parquet(path).filter(_committed(spark, path)).drop("write")


def broken_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, problem, rows``: committed files that are missing (or empty) or have another size.

    The manifest is held against a listing; no data is read.
    """
    root = path.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    found = found.select(_inside(F.col("path"), root).alias("file"), F.col("length").alias("found"))
    held = spark.read.parquet(f"{root}.files").filter(_committed(spark, path)).join(found, "file", "left")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("bytes"), "size")
    return held.select("file", problem.alias("problem"), "rows").filter("problem IS NOT NULL")


def changed_files(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """``file, rows, rows_read`` of committed files that do not hold their rows any more; reads the keys alone."""
    root = path.rstrip("/")
    held = spark.read.parquet(f"{root}.files").filter(_committed(spark, path))
    rows = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").schema(f"`{key}` string, write string").parquet(root)
    named = rows.select(_inside(F.col("_metadata.file_path"), root).alias("file"), F.xxhash64(key).alias("hash"))
    found = named.groupBy("file").agg(F.count("*").alias("rows_read"), F.bit_xor("hash").alias("found"))
    both = held.join(found, "file", "left").filter(~(F.col("found").eqNullSafe(F.col("checksum")) & F.col("rows_read").eqNullSafe(F.col("rows"))))
    return both.select("file", "rows", F.coalesce("rows_read", F.lit(0)).cast("bigint").alias("rows_read"))


def read_features(
    spark: SparkSession, path: str, schema: str | None = None, suffix: str = "*.parquet", tolerant: bool = False
) -> DataFrame:
    """All records below a directory, whatever the nesting.

    A file that cannot be read is an error.  In ``tolerant`` mode the reader goes on without what
    it cannot read; :func:`unreadable_files` then tells which files that is.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", suffix)
    reader = reader.option("ignoreCorruptFiles", str(tolerant).lower())
    if schema:
        reader = reader.schema(schema)
    return reader.parquet(path)


def unreadable_files(spark: SparkSession, path: str, schema: str, suffix: str = "*.parquet") -> DataFrame:
    """``(path, rows, rows_read)`` of files, in a folder without a manifest, that do not give all the
    rows their footer names.

    ``rows`` is null where not even the footer can be read.  Reading no column counts the rows by
    footers, reading all columns counts what is there.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", suffix)
        .load(path)
        .select("path")
    )
    records = read_features(spark, path, schema, suffix, tolerant=True)
    named = F.col("_metadata.file_path").alias("path")
    promised = records.select(named).groupBy("path").agg(F.count("*").alias("rows"))
    touched = F.xxhash64(*[F.col(c) for c in records.columns])
    # A sum that depends on all columns; a plain count would be answered by the footers again.
    one = F.pmod(touched, F.lit(1)) + 1
    given = records.select(named, one.alias("one")).groupBy("path").agg(F.sum("one").alias("rows_read"))

    def by_path(df: DataFrame) -> DataFrame:
        return df.withColumn("path", F.regexp_replace("path", r"^file:/+", "/"))

    found = by_path(listing).join(by_path(promised), "path", "left").join(by_path(given), "path", "left")
    found = found.select("path", "rows", F.coalesce("rows_read", F.lit(0)).cast("bigint").alias("rows_read"))
    return found.where(F.col("rows").isNull() | (F.col("rows") > F.col("rows_read")))


def resume(
    samples: DataFrame,
    path: str,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    key: str = "id",
    index: str = "row",
    group_size: int = GROUP_SIZE,
) -> None:
    """Compute and store what is missing.  Safe to run again after a failure.

    Samples that were stored with :func:`save_bucketed` by the same key meet the stored keys without
    a shuffle.
    """
    todo = not_stored(samples, stored_keys(samples.sparkSession, path, key), key)
    write_features(compute_features(cluster(todo, index, group_size), fn, schema), path, key, index, group_size)
