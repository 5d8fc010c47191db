from pyspark.sql import functions as F

from chatprep.operators import statistics
from chatprep.plans import standins as S
from chatprep.plans.catalog import query
from chatprep.session import scratch_folder
from chatprep.sources import features as FE
from chatprep.sources import jsonl as J
from chatprep.sources import normalise as N
from chatprep.sources import registry as G
from chatprep.sources import results as RS


def record(df):
    """A record as two texts: id and its messages."""
    flat = F.array_join(
        F.transform("conversations", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|"
    )
    return df.select(F.col("id").cast("string").alias("id"), flat.alias("messages"))


def pair_sql(q: str, a: str, source: str = "pairs", id: str | None = None) -> str:
    made = f"md5({q} || {a})"
    rid = made if id is None else f"coalesce({id}, {made})"
    return f"SELECT {rid} AS id, 'user:' || {q} || '|assistant:' || {a} AS messages FROM {source}"


# --- lenient scan --------------------------------------------------------------------------------

_LINE_SQL = """lines AS (
  SELECT doc_id, doc_id % 9 AS kind, string_split(text, chr(10)) AS l FROM documents)"""


def chat_lines(t):
    """JSON lines made of documents: good ones and every kind of bad one."""
    d = F.col("doc_id")
    messages = F.transform(
        F.split("text", "\n", -1),
        lambda x, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), x.alias("content")),
    )
    head = F.concat(F.lit('{"id": "'), d.cast("string"), F.lit('", "conversations": '))
    conv = F.to_json(messages)
    line = (
        F.when(d % 9 == 0, F.concat(head, F.lit("[{")))
        .when(d % 9 == 1, F.concat(head, F.lit("null}")))
        .when(d % 9 == 2, F.concat(F.lit('{"id": "'), d.cast("string"), F.lit('"}')))
        .when(d % 9 == 3, F.concat(head, F.lit('"text"}')))
        .when(d % 9 == 4, F.concat(head, F.lit("["), F.lit('"stray", 5, '), F.substring(conv, F.lit(2), F.length(conv)), F.lit(', "tools": null}')))
        .when(d % 9 == 5, F.concat(head, conv, F.lit(', "tools": "[{\\"a\\": 1}]"}')))
        .when(d % 9 == 6, F.concat(head, conv, F.lit(', "tools": "not json"}')))
        .when(d % 9 == 7, F.lit("  "))
        .otherwise(F.concat(head, conv, F.lit(', "tools": [{"b": [1, 2]}]}')))
    )
    return t.documents.select("doc_id", line.alias("value"))


@query(
    f"""WITH {_LINE_SQL} SELECT doc_id::VARCHAR AS id, CASE WHEN kind IN (1, 2) THEN '' ELSE
  array_to_string(list_transform(l, lambda x, i: (CASE WHEN i % 2 = 1 THEN 'user:' ELSE 'assistant:' END) || x), '|') END AS messages,
  CASE kind WHEN 4 THEN '[]' WHEN 5 THEN '[{{"a":1}}]' WHEN 6 THEN 'not json' WHEN 8 THEN '[{{"b":[1,2]}}]' END AS tools
FROM lines WHERE kind NOT IN (0, 3, 7)"""
)
def lenient_scan(t):
    good = J.good_lines(J.parse_lines(chat_lines(t)))
    flat = F.array_join(
        F.transform("conversations", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|"
    )
    return good.select("id", flat.alias("messages"), "tools")


@query(
    """SELECT CASE doc_id % 9 WHEN 0 THEN 'not JSON' ELSE 'conversations is not a list' END AS reason, count(*) AS n
FROM documents WHERE doc_id % 9 IN (0, 3) GROUP BY 1"""
)
def quarantined_lines(t):
    return J.quarantine(J.parse_lines(chat_lines(t))).groupBy("reason").agg(F.count("*").alias("n"))


# --- normalisers -----------------------------------------------------------------------------------


@query(f"WITH {S.PAIRS} SELECT conv_id || '-' || turn AS id, 'user:' || question || '|assistant:' || answer AS messages FROM pairs")
def messages_strict(t):
    m = F.array(N.message("user", F.col("question")), N.message("assistant", F.col("answer")))
    df = S.pairs(t).select(F.concat_ws("-", "conv_id", "turn").alias("prompt_id"), m.alias("messages"))
    return record(N.messages_strict(df))


_SPEAKERS = ("human", "gpt", "bing", "system", "bard", "chatgpt", "user")


def speaker_chats(t):
    d = F.col("doc_id")

    def speaker(x, i):
        who = F.get(F.array(*[F.lit(s) for s in _SPEAKERS]), ((d + i) % len(_SPEAKERS)).cast("int"))
        text = F.when(i % 3 == 0, F.concat(F.lit("<image>\n"), x)).otherwise(x)
        return F.struct(who.alias("from"), text.alias("value"))

    return t.documents.select(
        d.cast("string").alias("id"),
        "source",
        F.concat(F.lit("img/"), d.cast("string"), F.lit(".png")).alias("image"),
        F.transform(F.split("text", "\n", -1), speaker).alias("conversations"),
    )


_WHO = "['human', 'gpt', 'bing', 'system', 'bard', 'chatgpt', 'user'][(doc_id + i) % 7 + 1]"
_SPEAKER_SQL = f"""said AS (
  SELECT doc_id, source, unnest(range(len(l))) AS i, unnest(l) AS x FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)),
named AS (SELECT doc_id, source, i, {_WHO} AS who, CASE WHEN i % 3 = 0 THEN '<image>' || chr(10) || x ELSE x END AS v FROM said),
mapped AS (SELECT *, CASE WHEN who = 'human' THEN 'user' WHEN who IN ('gpt', 'bing', 'bard', 'chatgpt') THEN 'assistant' END AS role FROM named)"""


@query(
    f"""WITH {_SPEAKER_SQL} SELECT doc_id::VARCHAR AS id, coalesce(string_agg(role || ':' || v, '|' ORDER BY i) FILTER (WHERE role IS NOT NULL), '') AS messages,
  count(*) FILTER (WHERE role IS NULL) AS skipped FROM mapped GROUP BY doc_id"""
)
def from_value(t):
    df = N.from_value(speaker_chats(t))
    flat = F.array_join(
        F.transform("conversations", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|"
    )
    return df.select("id", flat.alias("messages"), F.col("skipped").cast("bigint").alias("skipped"))


@query(
    f"""WITH {_SPEAKER_SQL} SELECT source, count(*) FILTER (WHERE role IS NULL) AS skipped_messages, count(*) AS seen_messages,
  count(DISTINCT doc_id) AS records FROM mapped GROUP BY source"""
)
def skipped_messages(t):
    raw = speaker_chats(t)
    kept = N.from_value(raw.withColumn("id", F.struct("id", "source")))
    return N.skip_report(kept.withColumn("source", F.col("id.source")), "source")


@query(
    f"""WITH {_SPEAKER_SQL} SELECT doc_id::VARCHAR AS id, 'pages/img/' || doc_id || '.png' AS image,
  coalesce(string_agg(role || ':' || CASE WHEN role = 'user' THEN replace(v, '<image>' || chr(10), '') ELSE v END, '|' ORDER BY i) FILTER (WHERE role IS NOT NULL), '') AS messages
FROM mapped WHERE doc_id IN (SELECT page_id * 3 FROM pages) GROUP BY doc_id"""
)
def image_records(t):
    files = t.pages.select(
        F.concat(F.lit("img/"), (F.col("page_id") * 3).cast("string"), F.lit(".png")).alias("path")
    )
    df = N.with_image(speaker_chats(t), images=files, root="pages")
    flat = F.array_join(
        F.transform("conversations", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|"
    )
    return df.select("id", "image", flat.alias("messages"))


def as_pair(t, q, a):
    return S.pairs(t).select("conv_id", "turn", F.col("question").alias(q), F.col("answer").alias(a))


for _source, _q, _a in (
    ("opc", "instruction", "output"),
    ("codealpaca-20k", "instruction", "output"),
    ("magicoder-evol-instruct", "instruction", "response"),
    ("gsm8k", "question", "answer"),
    ("hendrycks_math", "problem", "solution"),
    ("camel", "message_1", "message_2"),
):
    query(
        f"WITH {S.PAIRS} {pair_sql('question', 'answer')}", name="source_" + _source.replace("-", "_")
    )(lambda t, s=_source, q=_q, a=_a: record(G.normalise(s, as_pair(t, q, a))))


@query(
    f"WITH {S.PAIRS} {pair_sql('question', 'answer', id='(CASE WHEN turn % 4 = 0 THEN (conv_id * 100 + turn)::VARCHAR END)')}"
)
def source_opencodeinstruct(t):
    given = F.when(F.col("turn") % 4 == 0, (F.col("conv_id") * 100 + F.col("turn")).cast("string"))
    return record(G.normalise("opencodeinstruct", as_pair(t, "input", "output").withColumn("id", given)))


@query(
    f"""WITH {S.PAIRS}, o AS (SELECT question || chr(10) || 'a) ' || turn || ' b) ' || conv_id AS q, answer AS a FROM pairs) {pair_sql('q', 'a', 'o')}"""
)
def source_math_qa(t):
    df = S.pairs(t).select(
        F.col("question").alias("Problem"),
        F.concat(F.lit("a) "), F.col("turn").cast("string"), F.lit(" b) "), F.col("conv_id").cast("string")).alias("options"),
        F.col("answer").alias("Rationale"),
    )
    return record(G.normalise("math_qa", df))


@query(
    """WITH q AS (
  SELECT p_name || ' ' || p_partkey AS question, p_brand AS right_answer, p_type AS d1, 'size ' || p_size AS d2,
    CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE 'price ' || p_size END AS d3, p_name AS support FROM part),
o AS (
  SELECT *, unnest([0, 1, 2, 3]) AS k, unnest([d3, d1, d2, right_answer]) AS x FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY md5('42:' || question || ':' || k)) AS slot FROM o),
g AS (
  SELECT question, any_value(support) AS support, any_value(right_answer) AS right_answer,
    string_agg(chr((96 + slot)::INT) || ') ' || x, chr(10) ORDER BY slot) AS opts, min(slot) FILTER (WHERE x = right_answer) AS hit FROM r GROUP BY question),
t AS (SELECT question || chr(10) || opts AS q, support || chr(10) || 'answer: ' || chr((96 + hit)::INT) || ') ' || right_answer AS a FROM g) """
    + pair_sql("q", "a", "t")
)
def source_sciq(t):
    p = t.part
    d3 = F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("price "), "p_size"))
    df = p.select(
        F.concat_ws(" ", "p_name", "p_partkey").alias("question"),
        F.col("p_brand").alias("correct_answer"),
        F.col("p_type").alias("distractor1"),
        F.concat(F.lit("size "), "p_size").alias("distractor2"),
        d3.alias("distractor3"),
        F.col("p_name").alias("support"),
    )
    return record(G.normalise("sciq", df))


@query(
    f"""WITH {S.DOC_CHATS} SELECT doc_id::VARCHAR AS id, array_to_string(list_transform(conv, lambda m: m.role || ':' || m.content), '|') AS messages FROM doc_chats"""
)
def source_passthrough(t):
    return record(G.normalise("eaglechat", S.doc_chats(t).withColumnRenamed("doc_id", "id")))


@query(
    f"""WITH {_SPEAKER_SQL} SELECT doc_id::VARCHAR AS id, coalesce(string_agg(role || ':' || v, '|' ORDER BY i) FILTER (WHERE role IS NOT NULL), '') AS messages
FROM mapped GROUP BY doc_id"""
)
def source_renamed_id(t):
    raw = speaker_chats(t).select(F.col("id").alias("uuid"), "conversations")
    return record(G.normalise("magpie-qwen2.5-pro-1m-v0.1", raw))


@query("SELECT doc_id, lang AS subset FROM documents WHERE lang IN ('en', 'fr', 'de', 'es')")
def concatenated_subsets(t):
    docs = t.documents.select("doc_id", "lang")
    parts = {x: docs.filter(F.col("lang") == x).select("doc_id") for x in ("en", "fr", "de", "es")}
    return G.concatenate(parts)


@query(
    f"""WITH {S.PAIRS}, a AS (SELECT 'gsm8k' AS source, md5(question || answer) AS id FROM pairs UNION ALL
  SELECT 'opencodeinstruct', doc_id::VARCHAR FROM documents)
SELECT source, count(*) AS records, count(DISTINCT id) AS ids FROM a GROUP BY source"""
)
def source_dispatch(t):
    docs = t.documents.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("input"), F.col("lang").alias("output"))
    made = {"gsm8k": G.normalise("gsm8k", as_pair(t, "question", "answer")), "opencodeinstruct": G.normalise("opencodeinstruct", docs)}
    return G.concatenate(made, "source").groupBy("source").agg(
        F.count("*").alias("records"), F.count_distinct("id").alias("ids")
    )


# --- feature store ---------------------------------------------------------------------------------------


@query(
    """SELECT vec_id, vec_id // 200 * 200 AS bucket, 'rows_' || (vec_id // 200 * 200) || '-' || (vec_id // 200 * 200 + 200) || '/data_' || vec_id AS name
FROM embeddings"""
)
def feature_buckets(t):
    v = F.col("vec_id")
    return t.embeddings.select("vec_id", FE.bucket_start(v, 200).alias("bucket"), FE.record_name(v, 200).alias("name"))


def features(t):
    broken = F.transform(
        "embedding", lambda x, i: F.when((F.col("vec_id") % 7 == 3) & (i == F.col("vec_id") % 64), F.lit(float("nan"))).otherwise(x)
    )
    return t.embeddings.select("vec_id", "label", F.col("embedding").alias("hidden_state"), broken.alias("aux_hidden_state"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 7 <> 3")
def valid_features(t):
    return FE.valid_features(features(t), "hidden_state", "aux_hidden_state").select("vec_id", "label")


@query("SELECT label, count(*) AS rejected FROM embeddings WHERE vec_id % 7 = 3 GROUP BY label")
def rejected_features(t):
    bad = FE.rejected_features(features(t), "hidden_state", "aux_hidden_state")
    return bad.groupBy("label").agg(F.count("*").alias("rejected"))


STORED = "id string, row bigint, hidden_state array<float>, aux_hidden_state array<float>"


def doubled(batch):
    """Stands for a model: both arrays of a sample from its vector."""
    return batch.assign(hidden_state=batch["vector"], aux_hidden_state=[v * 2 for v in batch["vector"]])[["id", "row", "hidden_state", "aux_hidden_state"]]


def feature_store(t, name):
    """A store made in two goes; every seventh record has a NaN."""
    folder = scratch_folder(t.spark, name)
    rows = features(t).select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("row"), F.col("aux_hidden_state").alias("vector"))
    samples = FE.save_bucketed(rows, f"{folder}/samples", "id")
    FE.resume(samples.filter("row % 3 = 1"), f"{folder}/store", doubled, STORED, group_size=200)
    FE.resume(samples, f"{folder}/store", doubled, STORED, group_size=200)
    FE.resume(samples.filter("row % 7 <> 3"), f"{folder}/store", doubled, STORED, group_size=200)  # nothing is missing
    return f"{folder}/store"


@query(
    """SELECT vec_id::VARCHAR AS id, vec_id // 200 * 200 AS bucket,
  list_sum(list_transform(embedding, lambda x: floor(x * 256)::BIGINT))::BIGINT AS hidden,
  list_sum(list_transform(embedding, lambda x: floor(x * 512)::BIGINT))::BIGINT AS aux
FROM embeddings WHERE vec_id % 7 <> 3"""
)
def feature_round_trip(t):
    def total(column):
        return F.aggregate(column, F.lit(0).cast("bigint"), lambda a, x: a + F.floor(x.cast("double") * 256)).alias

    kept = FE.read_store(t.spark, feature_store(t, "round-trip"))
    return kept.select("id", F.col("bucket").cast("bigint").alias("bucket"), total("hidden_state")("hidden"), total("aux_hidden_state")("aux"))


@query(
    """SELECT sum((vec_id % 7 <> 3)::INT)::BIGINT AS rows, (sum((vec_id % 7 = 3)::INT) + sum((vec_id % 7 = 3 AND vec_id % 3 = 1)::INT))::BIGINT AS rejected
FROM embeddings"""
)
def feature_writes(t):
    """Rejected records are not stored, so the second go tries those of the first once more."""
    return FE.writes(t.spark, feature_store(t, "writes")).agg(F.sum("rows").alias("all"), F.sum("rejected").alias("rejected")).select(
        (F.col("all") - F.col("rejected")).alias("rows"), "rejected"
    )


@query(
    """SELECT vec_id // 200 * 200 AS bucket, CASE WHEN vec_id < 200 THEN 'missing' ELSE 'size' END AS problem, count(*) AS rows
FROM embeddings WHERE vec_id % 7 <> 3 AND vec_id < 400 GROUP BY 1, 2"""
)
def broken_feature_files(t):
    """The files of one bucket go, those of the next lose their ends."""
    path = feature_store(t, "broken")
    root = t.spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(t.spark._jsc.hadoopConfiguration())
    for bucket in (0, 200):
        for found in files.globStatus(t.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/write=*/bucket={bucket}/*.parquet")):
            if bucket:
                cut = files.create(found.getPath(), True)
                cut.write(bytearray(b"cut"))
                cut.close()
            else:
                files.delete(found.getPath(), False)
    broken = FE.broken_files(t.spark, path).withColumn("bucket", F.regexp_extract("file", r"bucket=(\d+)", 1).cast("bigint"))
    return broken.groupBy("bucket", "problem").agg(F.sum("rows").alias("rows"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def not_stored(t):
    return FE.not_stored(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


# --- metric log and checkpoints ----------------------------------------------------------------------------


@query(
    """SELECT event_id AS step, metric, value FROM (
  SELECT event_id, 'acc' AS metric, value FROM events UNION ALL SELECT event_id, 'loss', round(value * 2, 6) FROM events)
WHERE event_id % 50 = 0"""
)
def metric_log(t):
    wide = t.events.select(
        F.col("event_id").alias("step"), F.col("value").alias("acc"), F.round(F.col("value") * 2, 6).alias("loss")
    )
    return RS.melt_metrics(statistics.every(wide, "step", 25, 2), ["step"], ["acc", "loss"])


@query(
    """WITH n AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'run/epoch_' || (o_orderkey % 17) WHEN o_orderkey % 3 = 1
    THEN 'run/epoch_' || (o_orderkey % 17) || '_step_' || o_custkey ELSE 'run/other_' || o_orderkey END AS path,
    o_orderkey % 17 AS epoch, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS step, o_orderkey % 3 < 2 AS ok FROM orders)
SELECT path, epoch, step FROM n WHERE ok ORDER BY epoch DESC, step DESC LIMIT 1"""
)
def last_checkpoint(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.concat(F.lit("run/epoch_"), (k % 17).cast("string"))
    path = (
        F.when(k % 3 == 0, name)
        .when(k % 3 == 1, F.concat(name, F.lit("_step_"), c.cast("string")))
        .otherwise(F.concat(F.lit("run/other_"), k.cast("string")))
    )
    return RS.last_checkpoint(t.orders.select(path.alias("path")))
