"""Token-id files: whole corpora as Simple-8b words in ascending document order.

A file is a Parquet part that holds segments, one per row.  A segment has whole documents::

    shard     int             number of the file in document order
    base      long            ids of the shard before this segment
    doc_ids   array<long>     documents in order
    n_tokens  array<long>     ids of each, with the end id
    words     binary          Simple-8b words, little-endian
    blocks    binary          first word of each block of 128 ids, and the end (int64)

Segments hold about 4 MB of text, or one longer document, so that readers need bounded memory
and can start anywhere.  Writing goes through Spark's commit, so lost executors leave no halves.

Nulls: a null text is an empty document (its end id alone); a null doc_id sorts first.
Repeated rows are documents of their own, ties in doc_id are ordered by a hash of the text.
An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatprep.llm import simple8b
from chatprep.llm.common import configure, documents, groups, store
from chatprep.llm.wordids import WordIds

FILE_SCHEMA = "shard int, base long, doc_ids array<bigint>, n_tokens array<bigint>, words binary, blocks binary"
READ_SCHEMA = "doc_id long, shard int, start long, n_tokens long, ids_crc32 long"


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Segments in ascending document order; one task makes one shard."""
    configure(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, base, shard = WordIds.of(tokenizer), 0, TaskContext.get().partitionId()
        for batch in batches:
            names = batch.column("doc_id")
            for low, high, data, borders in groups(batch.column("text")):
                ids, ends = ids_of.encode(data, borders, end_id)
                words, blocks = simple8b.encode(ids)
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([shard], pa.int32()),
                        "base": pa.array([base], pa.int64()),
                        "doc_ids": pa.array([names[low:high].to_pylist()], pa.list_(pa.int64())),
                        "n_tokens": pa.array([np.diff(ends)], pa.list_(pa.int64())),
                        "words": pa.array([words.astype("<u8").tobytes()], pa.binary()),
                        "blocks": pa.array([blocks.astype("<i8").tobytes()], pa.binary()),
                    }
                )
                base += len(ids)

    # Equal rows differ in the place they were read from, so that they can be cut into ranges as well.
    placed = docs.withColumns({"_text": F.xxhash64("text"), "_place": F.xxhash64(F.monotonically_increasing_id())})
    order = ["doc_id", "_text", "_place"]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_text", "_place")
    return ordered.mapInArrow(make, FILE_SCHEMA)


def write(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode a table into token files below the shared folder; gives the table of its segments."""
    return store(encoded(documents(docs, id_col, text_col), tokenizer, end_id), "tokens")


def read_ids(segments: DataFrame) -> DataFrame:
    """Every document of the files with its decoded ids."""
    return segments.mapInArrow(_decoder(_with_ids), "doc_id long, shard int, start long, ids array<bigint>")


def digests(segments: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the ids in the files."""
    found = segments.mapInArrow(_decoder(_digest), READ_SCHEMA)
    # One row per file: bounded by the number of partitions, whatever the size of the corpus.
    sizes = segments.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("_n"))
    bases = sizes.selectExpr("shard", "sum(_n) OVER (ORDER BY shard) - _n AS _base")
    return found.join(F.broadcast(bases), "shard").select(
        "doc_id", (F.col("start") + F.col("_base")).alias("start"), "n_tokens", "ids_crc32"
    )


def _decoder(rows):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                one = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                counts = np.array(one["n_tokens"], np.int64)
                words, blocks = np.frombuffer(one["words"], "<u8"), np.frombuffer(one["blocks"], "<i8")
                ids = simple8b.decode(words, blocks, int(counts.sum()))
                yield rows(one, counts, ids)

    return make


def _columns(one: dict, counts: np.ndarray) -> tuple[dict, np.ndarray]:
    ends = np.concatenate([[0], np.cumsum(counts)])
    return {
        "doc_id": pa.array(one["doc_ids"], pa.int64()),
        "shard": pa.array([one["shard"]] * len(counts), pa.int32()),
        "start": pa.array(ends[:-1] + one["base"], pa.int64()),
    }, ends


def _with_ids(one: dict, counts: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    columns, ends = _columns(one, counts)
    values = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int64)))
    return pa.RecordBatch.from_pydict(columns | {"ids": values})


def _digest(one: dict, counts: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    columns, ends = _columns(one, counts)
    raw, borders = ids.astype("<u4"), ends.tolist()
    sums = [zlib.crc32(raw[a:b]) for a, b in zip(borders, borders[1:], strict=False)]
    return pa.RecordBatch.from_pydict(
        columns | {"n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())}
    )
