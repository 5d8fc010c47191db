"""What the operators of this package share: storage, Arrow columns, batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP_BYTES = 1 << 19  # text that is scanned at once inside a task; a longer document stands alone
BATCH_BYTES = 4 << 20  # largest Arrow batch sent to a Python worker


def configure(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well, because documents differ a lot in length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that the driver and all executors share.

    It is ``spark.checkpoint.dir``.  Where that is unset it is the warehouse, in a local session (as
    in tests) only: a cluster must name a folder that all its machines share.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/llm-tables"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage: when executors are lost, later steps read files that are complete.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """``(doc_id long, text string)`` of a table, whatever else it holds; null texts become empty.

    With ``key_col``, that column follows as the string ``row_key``.
    """
    key = [docs[key_col].cast("string").alias("row_key")] if key_col else []
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), *key
    )


def place(key: str) -> Column:
    """Where a row stands in the order that samples are taken in: a hash of its key, from 0 to 1."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 31)) / (1 << 31)


def reach(wanted: int, there: Column | int) -> Column:
    """A place beyond which the first ``wanted`` of so many rows hardly ever lie."""
    return (wanted * 1.5 + 200) / F.greatest(F.lit(there) if isinstance(there, int) else there, F.lit(1))


def first_rows(rows: DataFrame, key: str, wanted: int) -> DataFrame:
    """The ``wanted`` rows of the smallest hashes of ``key``.

    Rows that cannot be among them are left out first, so that the final sort gets few rows from
    all tasks together, however many tasks there are.
    """
    return rows.where(place(key) < reach(wanted, rows.count())).orderBy(place(key), *rows.columns).limit(wanted)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the borders of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, borders, data = column.buffers()
    offsets = np.frombuffer(borders, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[: offsets[-1]], offsets.astype(np.int64)


def groups(column: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows ``(low, high, bytes, borders)`` of at most ``limit`` bytes, or of one row."""
    if not len(column):
        return
    data, offsets = utf8(column)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), len(column))
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def lists(values: np.ndarray, borders: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and row borders."""
    return pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(values, kind))
