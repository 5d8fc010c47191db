"""A training corpus from raw documents: stages over Parquet tables, each one operator of chatprep.llm.

Every stage takes all rows its predecessor kept, all but the last return the columns of the
documents.  An empty table gives empty stages; without labels, or with labels of one kind, all
documents get one score and stay or go together; of equal rows the dedup stage keeps one.  A document is what has one doc_id and one text (either may be null): rows that share
both are copies of it, rows that share a doc_id only are judged one by one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatprep.llm import decontamination, packing, quality_gam, secret_scan, simhash
from chatprep.llm.common import store

KEY = "_document_key"


def _keyed(docs: DataFrame) -> DataFrame:
    """With a key of doc_id and text, which no other pair of them has; nulls are "-", which no id or digest is."""
    parts = [F.coalesce(c, F.lit("-")) for c in (F.col("doc_id").cast("long").cast("string"), F.sha2(F.col("text").cast("string"), 256))]
    return docs.withColumn(KEY, F.concat_ws(":", *parts))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    return quality_gam.keep(docs, _table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id, one row of it."""
    docs = _keyed(docs)
    first = simhash.first_keys(docs, KEY).select(F.col("row_key").alias(KEY))
    one = Window.partitionBy(KEY).orderBy(F.xxhash64("text"), "text")
    kept = docs.join(first, KEY, "left_semi").withColumn("_document_row", F.row_number().over(one))
    return kept.where("_document_row = 1").drop(KEY, "_document_row")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items."""
    docs = _keyed(docs)
    index = decontamination.build_index(docs, id_col=KEY, string_ids=True)
    found = decontamination.contamination(decontamination.matches(index, _table(spark, sf_dir, "benchmark")))
    # Stored, so that its size is known: while it is small, the texts are filtered where they lie.
    bad = store(found.where("contaminated").select(F.col("doc_id").alias(KEY)).distinct(), "contaminated")
    return docs.join(bad, KEY, "left_anti").drop(KEY)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by marks and n_chars set anew."""
    masked = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        count = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(count))
    return masked


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of 4096."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_copies),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack_tokens),
]
ORACLE_SQL = None  # a learnt classifier and the tokenizer have no SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of a folder; each but the last is stored."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
