from pyspark.sql import functions as F

from chatprep.functions import arrays as A
from chatprep.operators import samples as P
from chatprep.operators import sampling as L
from chatprep.plans import standins as S
from chatprep.plans.catalog import query

J = S.joined


def agg(expr, alias, sep=","):
    return f"string_agg(({expr})::VARCHAR, '{sep}' ORDER BY i) AS {alias}"


# --- trimming, filtering, shifting ------------------------------------------------------------------


@query(
    f"""WITH {S.SAMPLES} SELECT doc_id, {agg("id", "ids")}, {agg("CASE WHEN i = least(n, 400) - 1 THEN 0 ELSE m END", "mask", "")},
  count(*)::BIGINT AS attended FROM positions WHERE i < 400 GROUP BY doc_id"""
)
def offline_trim(t):
    out = P.offline_trim(S.samples(t), 400)
    return out.select(
        "doc_id", J("input_ids").alias("ids"), J("loss_mask", "").alias("mask"), F.size("attention_mask").cast("bigint").alias("attended")
    )


@query(f"WITH {S.SAMPLES} SELECT doc_id, list_sum(mask)::BIGINT AS supervised FROM samples WHERE list_sum(mask) >= 128")
def enough_supervision(t):
    out = P.enough_supervision(S.samples(t), 64)
    return out.select("doc_id", A.supervised(F.col("loss_mask")).alias("supervised"))


@query(
    f"""WITH {S.SAMPLES} SELECT count(*) AS rows_before, count(*) FILTER (WHERE list_sum(mask) >= 128) AS rows_after FROM samples"""
)
def supervision_report(t):
    return P.supervision_report(S.samples(t), 64)


@query(
    f"""WITH {S.SAMPLES} SELECT doc_id, {agg("CASE WHEN i + 1 < n THEN nxt ELSE 0 END", "shifted_left")}, {agg("coalesce(prv, 0)", "shifted_right")}
FROM (SELECT *, lead(id) OVER w AS nxt, lag(id) OVER w AS prv FROM positions WINDOW w AS (PARTITION BY doc_id ORDER BY i)) GROUP BY doc_id"""
)
def shift_by_one(t):
    ids = F.col("input_ids")
    return S.samples(t).select(
        "doc_id", J(A.shift_left(ids)).alias("shifted_left"), J(A.shift_right(ids)).alias("shifted_right")
    )


@query(
    f"""WITH {S.SAMPLES}, padded AS (SELECT doc_id, ids, mask, len(ids) AS n FROM samples),
steps AS (SELECT doc_id, ids, mask, n, unnest(range(7)) AS step FROM padded)
SELECT doc_id, step, array_to_string(list_transform(range(n), lambda x: CASE WHEN x + step + 1 < n THEN ids[x + step + 2] ELSE 0 END), ',') AS inputs,
  array_to_string(list_transform(range(n), lambda x: CASE WHEN x + step + 2 < n THEN ids[x + step + 3] ELSE 0 END), ',') AS targets,
  array_to_string(list_transform(range(n), lambda x: CASE WHEN x + step < n THEN mask[x + step + 1] ELSE 0 END), '') AS masks FROM steps"""
)
def step_views(t):
    out = P.step_views(S.samples(t), 7)
    return out.select(
        "doc_id",
        F.col("step").cast("bigint").alias("step"),
        J("step_input").alias("inputs"),
        J("step_target").alias("targets"),
        J("step_mask", "").alias("masks"),
    )


@query(
    f"""WITH {S.SAMPLES}, g AS (
  SELECT doc_id, ids, mask, least(len(ids), 1000) AS n, CAST(ceil(least(len(ids), 1000) / 4.0) AS BIGINT) AS chunk FROM samples),
sh AS (SELECT *, unnest(range(4)) AS shard FROM g)
SELECT doc_id, shard, chunk,
  array_to_string(list_transform(range(chunk + 7), lambda x: CASE WHEN shard * chunk + x < n THEN ids[shard * chunk + x + 1] ELSE 0 END), ',') AS ids,
  array_to_string(list_transform(range(chunk + 7), lambda x: CASE WHEN shard * chunk + x < n - 1 THEN mask[shard * chunk + x + 1] ELSE 0 END), '') AS mask,
  array_to_string(list_transform(range(chunk + 7), lambda x: CASE WHEN shard * chunk + x < n THEN 1 ELSE 0 END), '') AS attention,
  (shard // 2) * chunk * 2 AS first_position, (shard // 2) * chunk * 2 + chunk * 2 - 1 AS last_position FROM sh"""
)
def sequence_shards(t):
    out = P.sequence_shards(S.samples(t), shards=4, overlap=7, max_length=1000, ring=2)
    none = F.col("chunk") == 0  # an empty text has no positions: from 0 to -1
    return out.select(
        "doc_id",
        F.col("shard").cast("bigint").alias("shard"),
        F.col("chunk").cast("bigint").alias("chunk"),
        J("shard_ids").alias("ids"),
        J("shard_mask", "").alias("mask"),
        J("shard_attention", "").alias("attention"),
        F.coalesce(F.get("position_ids", F.lit(0)), F.when(none, 0)).cast("bigint").alias("first_position"),
        F.coalesce(F.try_element_at("position_ids", F.lit(-1)), F.when(none, -1)).cast("bigint").alias("last_position"),
    )


@query(
    f"""WITH {S.SAMPLES}, b AS (SELECT doc_id, doc_id // 16 AS batch_id, ids, mask FROM samples),
w AS (SELECT *, (ceil(max(len(ids)) OVER (PARTITION BY batch_id) / 8.0) * 8)::BIGINT AS width FROM b)
SELECT doc_id, batch_id, width AS padded_length, array_to_string(list_transform(range(width), lambda x: coalesce(ids[x + 1], 0)), ',') AS ids,
  array_to_string(list_transform(range(width), lambda x: coalesce(mask[x + 1], 0)), '') AS mask FROM w"""
)
def pad_batches(t):
    df = S.samples(t).withColumn("batch_id", F.floor(F.col("doc_id") / 16))
    out = P.pad_batches(df, ["batch_id"], ["input_ids", "loss_mask"], multiple=8)
    return out.select(
        "doc_id",
        "batch_id",
        F.col("padded_length").cast("bigint").alias("padded_length"),
        J("input_ids").alias("ids"),
        J("loss_mask", "").alias("mask"),
    )


# --- blocks ---------------------------------------------------------------------------------------------

ANCHORS = f"""{S.SAMPLES}, valid AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id) AS nv,
    row_number() OVER (PARTITION BY doc_id ORDER BY md5('42:' || doc_id || ':' || i), i) AS r
  FROM positions WHERE m = 1 AND i <= greatest(n - 16, 0)),
anchors AS (
  SELECT doc_id, i AS anchor, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS block
  FROM valid WHERE r <= least(8, nv - 1))"""


def anchored(t):
    return P.anchors(S.samples(t), "doc_id", block_size=16, num_anchors=8)


@query(f"WITH {ANCHORS} SELECT doc_id, string_agg(anchor::VARCHAR, ',' ORDER BY block) AS anchors FROM anchors GROUP BY doc_id")
def block_anchors(t):
    out = anchored(t).filter(F.size("anchors") > 0)
    return out.select("doc_id", J("anchors").alias("anchors"))


@query(
    f"""WITH {ANCHORS}, ks AS (SELECT *, unnest(range(16)) AS k FROM anchors)
SELECT a.doc_id, a.block::BIGINT AS block, a.anchor::BIGINT AS anchor, a.k::BIGINT AS k, s.ids[least(a.anchor + a.k, len(s.ids) - 1) + 1]::BIGINT AS label_id,
  a.anchor + a.k < len(s.ids) AS valid,
  (CASE WHEN a.k > 0 AND a.anchor + a.k < len(s.ids) THEN s.mask[a.anchor + a.k + 1] ELSE 0 END)::BIGINT AS eval_weight,
  round((CASE WHEN a.k > 0 AND a.anchor + a.k < len(s.ids) THEN s.mask[a.anchor + a.k + 1] ELSE 0 END) * exp(-greatest(a.k - 1, 0) / 7.0::DOUBLE), 6) AS loss_weight
FROM ks a JOIN samples s USING (doc_id)"""
)
def block_labels(t):
    out = P.blocks(anchored(t), "doc_id", 16, gamma=7.0)
    return out.select(
        "doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("block", "anchor", "k", "label_id", "eval_weight")],
        "valid", F.round("loss_weight", 6).alias("loss_weight")
    )


@query(
    f"""WITH {S.SAMPLES} SELECT doc_id, {agg("CASE WHEN i % 16 = 0 THEN id ELSE 99999 END", "every_block")},
  {agg("CASE WHEN edge THEN id ELSE 99999 END", "by_change")} FROM (
  SELECT *, m IS DISTINCT FROM lag(m) OVER (PARTITION BY doc_id ORDER BY i) AS edge FROM positions) GROUP BY doc_id"""
)
def noise_inputs(t):
    ids, mask = F.col("input_ids"), F.col("loss_mask")
    return S.samples(t).select(
        "doc_id",
        J(P.noise_input(ids, 16, 99999)).alias("every_block"),
        J(P.noise_input_by_block(ids, mask, 99999)).alias("by_change"),
    )


# --- order, limits, splits ----------------------------------------------------------------------------------

_HASH = "md5('42:' || doc_id)"


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_HASH}, doc_id) - 1 AS rank FROM documents")
def shuffle_rank(t):
    return L.rank_by_hash(t.documents, ["doc_id"])


@query(f"SELECT doc_id, source FROM documents ORDER BY {_HASH}, doc_id LIMIT 100")
def shuffled_head(t):
    df = t.documents.select("doc_id", "source")
    return L.shuffle_rows(df, ["doc_id"]).limit(100)


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50")
def first_rows(t):
    return L.first_n(t.documents.select("doc_id", "lang"), ["doc_id"], 50)


@query(
    f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_HASH}, doc_id) - 1 < ceil(0.05 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
FROM documents"""
)
def split_exact(t):
    return L.split_exact(t.documents.select("doc_id"), ["doc_id"])


@query(
    f"""SELECT doc_id, CASE WHEN ('0x' || {_HASH}[1:7])::BIGINT < ceil(0.05 * 268435456) THEN 'test' ELSE 'train' END AS split FROM documents"""
)
def split_by_hash(t):
    return L.split_by_hash(t.documents.select("doc_id"), ["doc_id"])


@query(
    "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 7"
)
def limit_per_group(t):
    return L.limit_per_group(t.documents.select("source", "doc_id"), "source", "doc_id", 7)


@query(
    """SELECT a.doc_id, a.lang FROM (SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 200) a WHERE a.lang = 'fr'"""
)
def limit_then_filter(t):
    return L.limit_then_filter(t.documents.select("doc_id", "lang"), ["doc_id"], 200, F.col("lang") == "fr")


@query("SELECT doc_id, lang FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 200")
def filter_then_limit(t):
    return L.filter_then_limit(t.documents.select("doc_id", "lang"), ["doc_id"], 200, F.col("lang") == "fr")


_SHARDS = f"""dealt AS (
  SELECT doc_id, pos % 3 AS rank, (pos // 3) // 16 AS batch_id FROM (
    SELECT doc_id, row_number() OVER (ORDER BY {_HASH}, doc_id) - 1 AS pos FROM documents)),
full_batches AS (SELECT rank, batch_id FROM dealt GROUP BY rank, batch_id HAVING count(*) = 16)"""


@query(f"WITH {_SHARDS} SELECT doc_id, rank, batch_id FROM dealt JOIN full_batches USING (rank, batch_id)")
def strided_shards(t):
    return L.strided_shards(t.documents, ["doc_id"], world=3, batch_size=16)


@query(f"WITH {_SHARDS} SELECT doc_id, rank, batch_id FROM dealt JOIN full_batches USING (rank, batch_id) WHERE batch_id >= 2")
def resume_batches(t):
    return L.resume_from(L.strided_shards(t.documents.select("doc_id"), ["doc_id"], 3, 16), "batch_id", 2)


@query("SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey) - 1 AS rank FROM orders")
def contiguous_shards(t):
    return L.contiguous_shards(t.orders, "o_orderkey", 7)


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS id FROM events")
def row_index(t):
    return L.rank_keys(t.events, [F.col("ts"), F.col("event_id")], ["event_id"], "id")


@query(
    f"""SELECT doc_id, source, length(text)::BIGINT AS n, row_number() OVER (PARTITION BY source ORDER BY {_HASH}, doc_id) - 1 AS rank FROM documents"""
)
def rank_within_source(t):
    ranks = L.rank_by_hash(t.documents, ["doc_id"], within=["source"])
    rows = t.documents.select("doc_id", "source", F.length("text").cast("bigint").alias("n"))
    return L.attach(rows, ranks, ["doc_id", "source"])
