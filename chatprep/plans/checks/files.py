"""Round trips through files below the session's storage folder."""

from pyspark.sql import functions as F

from chatprep.plans.catalog import query
from chatprep.session import scratch_folder
from chatprep.sources import files as FI
from chatprep.sources import results as RS


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def loaded_by_suffix(t):
    """A quarter of the documents through each format."""
    folder = scratch_folder(t.spark, "suffix")
    schema, parts = "doc_id bigint, text string", []
    for i, suffix in enumerate(("jsonl", "csv", "parquet", "orc")):
        part = t.documents.filter(F.col("doc_id") % 4 == i).select("doc_id", "text")
        path = f"{folder}/part.{suffix}"
        if suffix == "csv":
            part.write.option("header", True).option("escape", '"').csv(path)
        else:
            part.write.format({"jsonl": "json"}.get(suffix, suffix)).save(path)
        parts.append(FI.load_by_suffix(t.spark, path, schema))
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return whole.select("doc_id", F.md5("text").alias("digest"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS part, length(text) AS n FROM documents")
def train_test_files(t):
    folder = scratch_folder(t.spark, "split")
    rows, test = t.documents.select("doc_id", "text"), F.col("doc_id") % 10 == 0
    for wanted in (rows, rows.limit(0)):  # the second call finds the files and leaves them
        FI.write_train_test(wanted.filter(~test), wanted.filter(test), folder, "set")
    read = [
        FI.load_by_suffix(t.spark, f"{folder}/set_{part}.jsonl", "doc_id bigint, text string").withColumn("part", F.lit(part))
        for part in ("train", "test")
    ]
    return read[0].unionByName(read[1]).select("doc_id", "part", F.length("text").cast("bigint").alias("n"))


@query("SELECT doc_id, length(text) AS n FROM documents")
def keyed_stages(t):
    folder = scratch_folder(t.spark, "stage")
    rows = t.documents.select("doc_id", F.length("text").cast("bigint").alias("n"))
    FI.keyed_stage(rows, folder, {"step": 1})
    FI.keyed_stage(rows.limit(0), folder, {"step": 2})
    return FI.keyed_stage(rows.limit(0), folder, {"step": 1})  # not computed again


@query("SELECT CASE WHEN doc_id % 7 = 0 THEN 'error' ELSE 'success' END AS status, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def files_by_status(t):
    folder = scratch_folder(t.spark, "status")
    status = F.when(F.col("doc_id") % 7 == 0, "error").otherwise("success")
    FI.write_by_status(t.documents.select("doc_id", "text", status.alias("status")), folder)
    read = t.spark.read.schema("doc_id bigint, text string, status string").json(folder)
    return read.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars"))


@query(
    """SELECT 's' || l_suppkey AS model, 'b' || l_linenumber AS bench, count(*) AS results, sum(l_orderkey)::BIGINT AS samples
FROM lineitem GROUP BY 1, 2"""
)
def written_results(t):
    """One result document per supplier, written and read back."""
    folder = scratch_folder(t.spark, "results")
    runs = t.lineitem.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("model"),
        F.concat(F.lit("b"), F.col("l_linenumber").cast("string")).alias("bench"),
        *[F.lit(1).alias(c) for c in RS.CONFIG],
        F.array(F.struct(F.col("l_quantity").cast("double").alias("accuracy"))).alias("metrics"),
        F.col("l_orderkey").cast("bigint").alias("num_samples"),
    )
    path = RS.write_results(runs, folder)
    schema = "model string, benchmarks map<string, array<struct<num_samples: bigint>>>"
    read = t.spark.read.text(path).select(F.from_json("value", schema).alias("d"))
    flat = read.select("d.model", F.explode("d.benchmarks").alias("bench", "results"))
    total = F.aggregate("results", F.lit(0).cast("bigint"), lambda a, r: a + r["num_samples"])
    return flat.select("model", "bench", F.size("results").cast("bigint").alias("results"), total.alias("samples"))


@query(
    """WITH runs AS (SELECT unnest([1, 2, 3]) AS run)
SELECT run, source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents, runs WHERE run < 3 OR doc_id % 2 = 0 GROUP BY run, source
UNION ALL SELECT 4, '', 3, 0"""
)
def rewritten_stages(t):
    """The same stage over a table, again, and over the table as it is rewritten; the last row counts the stages made."""
    folder = scratch_folder(t.spark, "rewritten")
    rows = t.documents.select("doc_id", "source", F.length("text").cast("bigint").alias("n"))

    def stage(run, limit=None):
        read = t.spark.read.schema(rows.schema).parquet(f"{folder}/in")
        counted = read.groupBy("source").agg(F.count("*").alias("n"), F.sum("n").alias("chars"))
        kept = FI.planned_stage(counted if limit is None else counted.filter(F.col("n") > limit), f"{folder}/stages")
        return kept.select(F.lit(run).alias("run"), "source", "n", "chars")

    rows.write.parquet(f"{folder}/in")
    out = [stage(1), stage(2)]
    rows.filter("doc_id % 2 = 0").write.mode("overwrite").parquet(f"{folder}/in")
    out.append(stage(3))
    stage(5, limit=-1)  # another plan over the same files
    made = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{folder}/stages")
    stages = made.select(F.regexp_extract("path", "key=([0-9a-f]+)", 1).alias("key")).distinct().agg(F.count("*").alias("n"))
    last = stages.select(F.lit(4).alias("run"), F.lit("").alias("source"), "n", F.lit(0).cast("bigint").alias("chars"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(last)
