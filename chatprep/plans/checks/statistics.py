from pyspark.sql import functions as F

from chatprep.operators import regeneration as R
from chatprep.operators import statistics as M
from chatprep.plans import standins as S
from chatprep.plans.catalog import query

_WORDS = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> ''))"


@query(f"SELECT conv_id, sum({_WORDS.format('text')})::BIGINT AS context_length FROM conversations GROUP BY conv_id")
def context_lengths(t):
    return M.context_length_long(t.conversations)


@query(f"SELECT doc_id, {_WORDS.format('text')}::BIGINT AS context_length FROM documents")
def record_context_lengths(t):
    return S.doc_chats(t).select("doc_id", M.context_length(F.col("conversations")).alias("context_length"))


_STATUS = f"""{S.TURNS}, st AS (
  SELECT conv_id, CASE WHEN arg_min(role, turn) = 'assistant' THEN 'Data starts with an assistant message'
    WHEN min(turn) FILTER (WHERE role NOT IN ('system', 'user', 'assistant')) IS NOT NULL THEN 'Invalid message role: tool' END AS error,
    sum({_WORDS.format('text')})::BIGINT AS n FROM turns GROUP BY conv_id)"""


@query(f"WITH {_STATUS} SELECT conv_id, CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS status, error FROM st")
def replay_errors(t):
    return R.row_errors_long(S.turns(t))


@query(
    f"""WITH {_STATUS} SELECT count(*) FILTER (WHERE error IS NULL) AS successes, min(n) FILTER (WHERE error IS NULL) AS shortest,
  max(n) FILTER (WHERE error IS NULL) AS longest, round(avg(n) FILTER (WHERE error IS NULL), 6) AS average,
  count(error) AS errors, count(*) AS processed FROM st"""
)
def context_report(t):
    turns = S.turns(t)
    df = M.context_length_long(turns).join(R.row_errors_long(turns), "conv_id")
    return M.context_report(df).withColumn("average", F.round("average", 6))


# --- replay ------------------------------------------------------------------------------------------


@query(
    f"""WITH {S.MESSAGES}, e AS (
  SELECT doc_id, CASE WHEN arg_min(role, pos) = 'assistant' THEN 'Data starts with an assistant message'
    WHEN bool_or(role NOT IN ('system', 'user', 'assistant')) THEN 'Invalid message role: ' || (arg_min(role, pos) FILTER (WHERE role NOT IN ('system', 'user', 'assistant'))) END AS error
  FROM messages GROUP BY doc_id)
SELECT doc_id, error, CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS status FROM e"""
)
def record_errors(t):
    return R.validate(S.doc_chats(t)).select("doc_id", "error", "status")


@query(
    f"""WITH {S.MESSAGES}, ok AS (SELECT doc_id FROM messages GROUP BY doc_id HAVING arg_min(role, pos) <> 'assistant' AND bool_and(role <> 'tool')),
asked AS (SELECT m.*, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM messages m JOIN ok USING (doc_id) WHERE role IN ('system', 'user')),
users AS (SELECT doc_id, place, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS user_turn FROM asked WHERE role = 'user')
SELECT u.doc_id, u.user_turn, count(*)::BIGINT AS n, string_agg(a.role || ':' || a.content, '|' ORDER BY a.place) AS messages
FROM users u JOIN asked a ON a.doc_id = u.doc_id AND a.place <= u.place GROUP BY u.doc_id, u.user_turn"""
)
def replay_prompts(t):
    out = R.prompt_skeletons(S.doc_chats(t), "doc_id")
    flat = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return out.select(
        "doc_id", F.col("user_turn").cast("bigint").alias("user_turn"), F.size("messages").cast("bigint").alias("n"), flat.alias("messages")
    )


def echo(messages, request):
    """A stand-in model: a pure function of what it is asked."""
    return f"{len(messages)} {request.get('reasoning_effort')} {messages[-1]['content']}"


@query()
def replayed(t):
    records = S.doc_chats(t).withColumnRenamed("doc_id", "id")
    out = R.regenerate(records, echo, R.Sampling("m"), concurrency=4, effort_seed=42)
    return out.select("id", "status", "error", F.size("conversations").alias("n"))


@query(
    """SELECT status, count(*) AS n FROM (
  SELECT CASE WHEN bool_or(role = 'tool') OR arg_min(role, pos) = 'assistant' THEN 'error' ELSE 'success' END AS status FROM messages GROUP BY doc_id)
GROUP BY status""".replace("SELECT status, count(*) AS n", f"WITH {S.MESSAGES} SELECT status, count(*) AS n", 1)
)
def replay_outcomes(t):
    """What a replay will refuse, before any model is asked."""
    return R.validate(S.doc_chats(t)).groupBy("status").agg(F.count("*").alias("n"))


_DRAW = "('0x' || md5('{0}:' || doc_id)[1:7])::BIGINT"


@query(
    f"""SELECT doc_id, CASE WHEN {_DRAW.format(42)} % 10 < 4 THEN 'low' WHEN {_DRAW.format(42)} % 10 < 8 THEN 'medium' ELSE 'high' END AS effort,
  ['a:1', 'b:2', 'c:3'][{_DRAW.format('endpoint')} % 3 + 1] AS endpoint FROM documents"""
)
def effort_and_endpoint(t):
    d = F.col("doc_id")
    return t.documents.select(
        "doc_id", R.effort(42, d).alias("effort"), R.assign_endpoint(["a:1", "b:2", "c:3"], d).alias("endpoint")
    )


_DONE = """SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT page_id * 3 FROM pages)"""


@query(_DONE)
def remaining_records(t):
    errors = t.pages.select((F.col("page_id") * 3).alias("doc_id"))
    return R.remaining(t.documents.select("doc_id"), t.labels, errors, key="doc_id")


@query(_DONE + " ORDER BY doc_id LIMIT 100")
def capped_records(t):
    errors = t.pages.select((F.col("page_id") * 3).alias("doc_id"))
    return R.capped(R.remaining(t.documents.select("doc_id"), t.labels, errors, key="doc_id"), "doc_id", 100)


# --- training metrics over a log made of line items ------------------------------------------------------

_L = "l_linenumber"


@query(
    f"""SELECT {_L}::BIGINT AS step, round(sum(CASE WHEN l_partkey % 5 = l_suppkey % 5 AND l_returnflag <> 'N' THEN 1 ELSE 0 END)
  / greatest(sum(CASE WHEN l_returnflag <> 'N' OR l_linestatus = 'F' THEN 1 ELSE 0 END), 1e-6), 6) AS accuracy FROM lineitem GROUP BY 1"""
)
def position_accuracy(t):
    pm = (F.col("l_returnflag") != "N").cast("bigint")
    lm = ((F.col("l_returnflag") != "N") | (F.col("l_linestatus") == "F")).cast("bigint")
    out = M.position_accuracy(t.lineitem, [_L], F.col("l_partkey") % 5 == F.col("l_suppkey") % 5, pm, lm)
    return out.select(F.col(_L).cast("bigint").alias("step"), F.round("accuracy", 6).alias("accuracy"))


@query(
    f"""SELECT {_L}::BIGINT AS k, round(sum(CASE WHEN l_partkey % 5 = l_suppkey % 5 AND l_linestatus = 'F' THEN 1 ELSE 0 END)
  / (sum(CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0.0 END) + 1e-6), 6) AS accuracy FROM lineitem GROUP BY 1"""
)
def block_accuracy(t):
    w = F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0)
    out = M.block_accuracy(t.lineitem, [_L], F.col("l_partkey") % 5 == F.col("l_suppkey") % 5, w)
    return out.select(F.col(_L).cast("bigint").alias("k"), F.round("accuracy", 6).alias("accuracy"))


@query(
    f"""SELECT l_returnflag, round(sum(l_discount * exp(-greatest({_L} - 1, 0) / 7.0::DOUBLE)) / (sum(exp(-greatest({_L} - 1, 0) / 7.0::DOUBLE)) + 1e-6), 6) AS loss
FROM lineitem GROUP BY 1"""
)
def block_loss(t):
    from chatprep.operators.samples import decay

    out = M.block_loss(t.lineitem, ["l_returnflag"], F.col("l_discount"), decay(F.col(_L), 7.0))
    return out.withColumn("loss", F.round("loss", 6))


@query(
    """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT *, list_sum(list_transform(v, lambda x: exp(x))) AS z, list_reverse(v) AS r FROM e),
p AS (SELECT *, list_transform(r, lambda x: exp(x) / z) AS q, list_transform(v, lambda x: x - ln(z)) AS lq FROM s)
SELECT label, round(avg(-(SELECT sum(u) FROM (SELECT unnest(list_transform(range(64), lambda i: q[i + 1] * lq[i + 1])) AS u)) * (vec_id % 3 > 0)::INT), 5) AS loss
FROM p GROUP BY label"""
)
def soft_target_loss(t):
    df = t.embeddings.withColumn("target", M.softmax(F.reverse("embedding"))).withColumn(
        "pm", (F.col("vec_id") % 3 > 0).cast("int")
    )
    return M.position_loss(df, "embedding", "target", "pm", ["label"]).withColumn("loss", F.round("loss", 5))


@query(f"SELECT l_orderkey, round(sum(pow(0.8, {_L} - 1) * l_discount) / 4, 6) AS total_loss FROM lineitem GROUP BY 1")
def weighted_total_loss(t):
    df = t.lineitem.withColumn("position", F.col(_L) - 1)
    return M.weighted_total(df, ["l_orderkey"], "position", "l_discount", 4).withColumn("total_loss", F.round("total_loss", 6))


@query(f"SELECT l_orderkey, {_L}::BIGINT AS position, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY 1, 2")
def mean_over_ranks(t):
    df = t.lineitem.withColumn("position", F.col(_L).cast("bigint"))
    out = M.mean_over(df, ["l_orderkey", "position"], "l_discount", "l_tax")
    return out.withColumns({c: F.round(c, 6) for c in ("l_discount", "l_tax")})


@query(f"SELECT p AS position, round(avg(m), 6) AS l_discount FROM (SELECT {_L}::BIGINT AS p, l_suppkey, avg(l_discount) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def mean_of_batches(t):
    df = t.lineitem.withColumn("position", F.col(_L).cast("bigint"))
    out = M.mean_of_batches(df, ["position"], "l_suppkey", "l_discount")
    return out.withColumn("l_discount", F.round("l_discount", 6))


@query("SELECT l_orderkey AS step, round(avg(l_discount), 6) AS loss, round(avg(l_tax), 6) AS acc FROM lineitem GROUP BY 1")
def step_summary(t):
    df = t.lineitem.select(F.col("l_orderkey").alias("step"), F.col("l_discount").alias("loss"), F.col("l_tax").alias("acc"))
    return M.mean_over(df, ["step"], "loss", "acc").withColumns({c: F.round(c, 6) for c in ("loss", "acc")})
