"""Structured Streaming jobs over a landing directory of chat JSON lines.

Every job runs on ``availableNow``: it takes what has arrived, each file once, and
stops.  Progress lives in the checkpoint directory, which must be on shared storage.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chatprep.operators.tokens import tokens
from chatprep.session import scratch_folder
from chatprep.sources.files import exists, keyed_stage
from chatprep.sources.jsonl import good_lines, parse_lines, quarantine


LEDGER_DIGITS = 2  # 256 parts


def landing(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Lines of the files in a landing directory."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def reject(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Lines that no job can use, with the reason, as JSON lines.

    A query of its own beside :func:`ingest` or :func:`count_tokens`, so that the file sink
    writes every line once.
    """
    lines = quarantine(parse_lines(landing(spark, source)))
    return (
        lines.writeStream.format("json")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """JSON lines to Parquet with the same columns as the batch scan; :func:`reject` keeps the others."""
    records = good_lines(parse_lines(landing(spark, source)))
    return (
        records.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id a query got when its checkpoint was made: a new checkpoint has another one."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def _part(key: Column) -> Column:
    return F.substring(F.md5(key.cast("string")), 1, LEDGER_DIGITS)


def build_unseen(
    spark: SparkSession,
    source: str,
    sink: str,
    checkpoint: str,
    build: Callable[[DataFrame], DataFrame],
    key: str = "id",
    rejected: str | None = None,
) -> StreamingQuery:
    """Run ``build`` on records whose key was not built yet; records without a key get the md5 of
    their content.

    Keys that were built stand in a ledger beside the sink (``{sink}.keys``), parted by the first
    digits of their hash.  A batch reads the parts that its own keys fall into, and never the sink.
    Sink, ledger and, with ``rejected``, the lines that cannot be used get one folder per checkpoint
    and batch (:func:`read_built` reads the sink): a batch that is retried after a failure overwrites
    its own folders, and does not look at its own keys.
    """
    ledger = f"{sink.rstrip('/')}.keys"

    def step(batch: DataFrame, number: int) -> None:
        run = run_id(spark, checkpoint)
        place = f"run={run}/batch={number}"
        if rejected:
            quarantine(batch).write.mode("overwrite").json(f"{rejected}/{place}")
        made = F.md5(F.to_json(F.struct("conversations", "text")))
        named = good_lines(batch).withColumn(key, F.coalesce(F.col(key), made)).dropDuplicates([key])
        if exists(spark, ledger):
            parts = [r.part for r in named.select(_part(F.col(key)).alias("part")).distinct().collect()]  # 16 ** LEDGER_DIGITS at most
            seen = spark.read.schema(f"{key} string, run string, batch bigint, part string").parquet(ledger).filter(F.col("part").isin(parts))
            seen = seen.filter((F.col("run") != run) | (F.col("batch") != number))
            named = named.join(seen.select(key), key, "left_anti")
        # Stored, because the records are used twice and a second look must find the same ones.
        fresh = keyed_stage(named, scratch_folder(spark, "unseen"), {"run": run, "batch": number})
        build(fresh).write.mode("overwrite").parquet(f"{sink.rstrip('/')}/{place}")
        keys = fresh.select(key, _part(F.col(key)).alias("part")).repartition("part")
        keys.write.mode("overwrite").partitionBy("part").parquet(f"{ledger}/{place}")

    return (
        parse_lines(landing(spark, source)).writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_built(spark: SparkSession, sink: str) -> DataFrame:
    """All rows that :func:`build_unseen` has built."""
    return spark.read.parquet(sink).drop("run", "batch")


def reply_tokens(records: DataFrame) -> DataFrame:
    """One row per token of every assistant message."""
    messages = records.select(F.explode("conversations").alias("m")).filter("m.role = 'assistant'")
    return messages.select(F.explode(tokens(F.col("m.content"))).alias("token"))


def count_tokens(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Keep running token counts in the query's state, and the latest ones at ``sink``.

    Each batch writes the tokens whose counts it changed, with their counts so far, to a folder of
    its own; :func:`token_totals` takes the latest of each.  A new checkpoint counts for itself and
    adds to what others have counted.  Large vocabularies want the RocksDB state store.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/run={run_id(spark, checkpoint)}/batch={number}")

    records = good_lines(parse_lines(landing(spark, source)))
    counts = reply_tokens(records).groupBy("token").agg(F.count("*").alias("n"))
    return (
        counts.writeStream.outputMode("update").foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _latest(spark: SparkSession, sink: str) -> DataFrame:
    """Counts only grow, so the latest of a token is the largest, and reading one twice does no harm."""
    rows = spark.read.schema("token string, n bigint, run string, batch string").parquet(sink)
    return rows.groupBy("run", "token").agg(F.max("n").alias("n"))


def token_totals(spark: SparkSession, sink: str) -> DataFrame:
    """Token counts of all checkpoints."""
    return _latest(spark, sink).groupBy("token").agg(F.sum("n").alias("n"))


def compact_counts(spark: SparkSession, sink: str) -> None:
    """Replace the batches that are there by one folder per checkpoint, while no query writes to the sink.

    The new folder is complete before the old ones go; after a failure in between both are there,
    which changes no count.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(sink)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [f.getPath() for run in files.listStatus(root) if run.isDirectory() for f in files.listStatus(run.getPath()) if f.isDirectory()]
    together = _latest(spark, sink).withColumn("batch", F.lit(f"upto-{uuid.uuid4().hex}"))
    together.repartition("run", F.pmod(F.hash("token"), F.lit(8))).write.mode("append").partitionBy("run", "batch").parquet(sink)
    for folder in old:
        files.delete(folder, True)
