"""Streaming jobs over the JSON lines of ``sources.chat_lines``; the tables they
leave behind must equal the batch results."""

from pyspark.sql import functions as F

from chatprep.plans import standins as S
from chatprep.plans.catalog import query
from chatprep.plans.checks.sources import _LINE_SQL, chat_lines
from chatprep.session import scratch_folder
from chatprep.streaming import jobs

_MESSAGES = """CASE WHEN kind IN (1, 2) THEN '' ELSE
  array_to_string(list_transform(l, lambda x, i: (CASE WHEN i % 2 = 1 THEN 'user:' ELSE 'assistant:' END) || x), '|') END"""


def landed(t, name):
    folder = scratch_folder(t.spark, name)
    chat_lines(t).select("value").repartition(3).write.text(f"{folder}/in")
    return folder


def flat(df):
    text = F.array_join(
        F.transform("conversations", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|"
    )
    return df.select("id", text.alias("messages"))


@query(f"WITH {_LINE_SQL} SELECT doc_id::VARCHAR AS id, {_MESSAGES} AS messages FROM lines WHERE kind NOT IN (0, 3, 7)")
def streaming_ingest(t):
    folder = landed(t, "ingest")
    for _ in range(2):  # the second run finds nothing new
        jobs.ingest(t.spark, f"{folder}/in", f"{folder}/out", f"{folder}/state").awaitTermination()
    return flat(t.spark.read.parquet(f"{folder}/out"))


@query(f"WITH {_LINE_SQL} SELECT doc_id::VARCHAR AS id, {_MESSAGES} AS messages FROM lines WHERE kind NOT IN (0, 3, 7)")
def streaming_unseen(t):
    folder = landed(t, "unseen")
    for run in range(2):  # the second run reads all again and must add nothing
        jobs.build_unseen(
            t.spark, f"{folder}/in", f"{folder}/out", f"{folder}/state{run}", flat
        ).awaitTermination()
    return jobs.read_built(t.spark, f"{folder}/out")


@query(
    f"""WITH {_LINE_SQL}, r AS (SELECT unnest(list_filter(l, lambda x, i: i % 2 = 0)) AS text FROM lines WHERE kind IN (4, 5, 6, 8))
SELECT token, count(*) AS n FROM (SELECT unnest({S.TOKENS_SQL}) AS token FROM r) GROUP BY token"""
)
def streaming_token_counts(t):
    folder = landed(t, "counts")
    for _ in range(2):
        jobs.count_tokens(t.spark, f"{folder}/in", f"{folder}/out", f"{folder}/state").awaitTermination()
    return jobs.token_totals(t.spark, f"{folder}/out")


@query(
    f"""WITH {_LINE_SQL}, r AS (SELECT unnest(list_filter(l, lambda x, i: i % 2 = 0)) AS text FROM lines WHERE kind IN (4, 5, 6, 8))
SELECT token, 2 * count(*) AS n FROM (SELECT unnest({S.TOKENS_SQL}) AS token FROM r) GROUP BY token"""
)
def streaming_token_counts_resumed(t):
    """Files that come in two runs, a second checkpoint that counts all again, compaction in between."""
    folder = scratch_folder(t.spark, "resumed")
    lines = chat_lines(t).select("value").withColumn("half", F.pmod(F.hash("value"), F.lit(2)))
    for half in range(2):
        lines.filter(F.col("half") == half).select("value").write.mode("append").text(f"{folder}/in")
        jobs.count_tokens(t.spark, f"{folder}/in", f"{folder}/out", f"{folder}/state").awaitTermination()
        jobs.compact_counts(t.spark, f"{folder}/out")
    jobs.count_tokens(t.spark, f"{folder}/in", f"{folder}/out", f"{folder}/other").awaitTermination()
    return jobs.token_totals(t.spark, f"{folder}/out")


@query(
    """SELECT CASE doc_id % 9 WHEN 0 THEN 'not JSON' ELSE 'conversations is not a list' END AS reason, count(*) AS n
FROM documents WHERE doc_id % 9 IN (0, 3) GROUP BY 1"""
)
def streaming_quarantine(t):
    folder = landed(t, "reject")
    for _ in range(2):
        jobs.reject(t.spark, f"{folder}/in", f"{folder}/out", f"{folder}/state").awaitTermination()
    return t.spark.read.schema("reason string, line string").json(f"{folder}/out").groupBy("reason").agg(F.count("*").alias("n"))
