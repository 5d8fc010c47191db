from pyspark.sql import functions as F

from chatprep.operators import leaderboard as B
from chatprep.plans.catalog import query
from chatprep.sources import results as RS

BASE = "plain run"
PREFIX = "Vendor-X"
BUNDLE = "Bundle"
_NAMES = [*B.BENCHMARKS, "other"]
_DRAFTS = {"N": "acme/Vendor-X-draft-N", "R": "vendor-x/acme//Bundle-R"}

METRICS_SQL = f"""raw AS (
  SELECT 'team/t' || l_suppkey AS target, (l_partkey % 8)::INT AS b_pos, (l_linenumber % 3)::INT AS r_pos, l_returnflag AS flag,
    (sum(round(l_extendedprice * 100)::BIGINT)::BIGINT // count(*)) / 100.0::DOUBLE AS thr,
    (sum(l_quantity::BIGINT)::BIGINT * 100 // count(*) * 10 + 3) / 1000.0::DOUBLE AS acc FROM lineitem GROUP BY 1, 2, 3, 4),
metrics AS (
  SELECT target, b_pos, r_pos, CASE flag WHEN 'A' THEN 2 WHEN 'N' THEN 0 ELSE 1 END AS m_pos, {_NAMES}[b_pos + 1] AS benchmark,
    1 AS batch_size, CASE WHEN r_pos = 0 THEN 0 ELSE 3 END AS steps, CASE WHEN r_pos = 0 THEN 0 ELSE 1 END AS topk, CASE WHEN r_pos = 0 THEN 0 ELSE 4 END AS num_draft_tokens,
    CASE flag WHEN 'A' THEN '{BASE}' WHEN 'N' THEN '{_DRAFTS["N"]}' ELSE '{_DRAFTS["R"]}' END AS name,
    CASE WHEN b_pos = 6 AND flag = 'N' THEN NULL WHEN b_pos = 5 AND flag = 'A' THEN 0 ELSE thr END AS throughput, acc AS accept_length
  FROM raw WHERE NOT (b_pos % 3 = 2 AND r_pos = 2 AND flag = 'A')),
based AS (
  SELECT m.*, b.throughput AS base_throughput, b.accept_length AS base_accept_length FROM metrics m LEFT JOIN (
    SELECT target, b_pos, r_pos, throughput, accept_length FROM metrics WHERE name = '{BASE}') b USING (target, b_pos, r_pos)),
labelled AS (
  SELECT *, CASE WHEN name = '{BASE}' THEN 'None' ELSE name END AS draft,
    CASE WHEN name = '{BASE}' THEN 'baseline' ELSE batch_size || '-' || steps || '-' || topk || '-' || num_draft_tokens END AS config FROM based),
entries AS (
  SELECT target, draft, config, benchmark, last(throughput ORDER BY b_pos, r_pos, m_pos) AS throughput, last(accept_length ORDER BY b_pos, r_pos, m_pos) AS accept_length,
    last(base_throughput ORDER BY b_pos, r_pos, m_pos) FILTER (WHERE base_accept_length IS NOT NULL) AS base_throughput,
    last(base_accept_length ORDER BY b_pos, r_pos, m_pos) FILTER (WHERE base_accept_length IS NOT NULL) AS base_accept_length
  FROM labelled GROUP BY 1, 2, 3, 4)"""


def documents(t):
    """A nested JSON document per supplier, made of its line items; the parts of one are
    as many as the constants above allow."""
    names = F.array(*[F.lit(n) for n in _NAMES])
    rows = (
        t.lineitem.groupBy(
            F.concat(F.lit("team/t"), F.col("l_suppkey").cast("string")).alias("target"),
            (F.col("l_partkey") % 8).cast("int").alias("b"),
            (F.col("l_linenumber") % 3).cast("int").alias("r"),
            F.col("l_returnflag").alias("flag"),
        )
        .agg(
            # Whole numbers until the last step, and no half to round, so that every engine
            # gets the same value.
            (F.floor(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / F.count("*")) / 100.0).alias("thr"),
            ((F.floor(F.sum(F.col("l_quantity").cast("bigint")) * 100 / F.count("*")) * 10 + 3) / 1000.0).alias("acc"),
        )
        .filter("NOT (b % 3 = 2 AND r = 2 AND flag = 'A')")
    )
    flag = F.col("flag")
    order = F.when(flag == "A", 2).when(flag == "N", 0).otherwise(1)
    name = F.when(flag == "A", BASE).when(flag == "N", _DRAFTS["N"]).otherwise(_DRAFTS["R"])
    thr = F.when((F.col("b") == 6) & (flag == "N"), None).when((F.col("b") == 5) & (flag == "A"), 0.0).otherwise(F.col("thr"))
    metric = F.struct(name.alias("Name"), thr.alias("output_throughput"), F.col("acc").alias("accept_length"))

    def ordered(key, value):
        return F.transform(F.sort_array(F.collect_list(F.struct(key.alias("k"), value.alias("v")))), lambda x: x["v"])

    per_result = rows.groupBy("target", "b", "r").agg(ordered(order, metric).alias("metrics"))
    zero = F.col("r") == 0
    result = F.struct(
        F.lit(1).alias("batch_size"),
        F.when(zero, 0).otherwise(3).alias("steps"),
        F.when(zero, 0).otherwise(1).alias("topk"),
        F.when(zero, 0).otherwise(4).alias("num_draft_tokens"),
        "metrics",
    )
    per_bench = per_result.groupBy("target", "b").agg(ordered(F.col("r"), result).alias("results"))
    part = F.struct(
        F.concat(F.lit("k"), F.col("b").cast("string")).alias("key"),
        F.struct(F.get(names, F.col("b")).alias("benchmark_name"), "results").alias("value"),
    )
    per_target = per_bench.groupBy("target").agg(F.map_from_entries(F.sort_array(F.collect_list(part))).alias("m"))
    whole = per_target.select(F.create_map("target", "m").alias("d"))
    return RS.parse_documents(whole.select(F.to_json("d").alias("value")))


def metrics(t):
    return B.flatten_documents(documents(t))


def entries(t):
    return B.merge_entries(B.label_entries(B.flatten_documents(documents(t), BASE), BASE))


_INTS = ("batch_size", "steps", "topk", "num_draft_tokens")
_INT_SQL = ", ".join(f"{c}::BIGINT AS {c}" for c in _INTS)


def longs(df):
    return df.withColumns({c: F.col(c).cast("bigint") for c in _INTS})


# Positions of what is there: a supplier may lack some benchmarks, results or metrics.
_PLACE = """(dense_rank() OVER (PARTITION BY target ORDER BY b_pos) - 1) || '.' || (dense_rank() OVER (PARTITION BY target, b_pos ORDER BY r_pos) - 1)
  || '.' || (row_number() OVER (PARTITION BY target, b_pos, r_pos ORDER BY m_pos) - 1)"""


@query(f"WITH {METRICS_SQL} SELECT target, benchmark, {_INT_SQL}, {_PLACE} AS place, name, throughput, accept_length FROM metrics")
def flattened_documents(t):
    return longs(metrics(t)).withColumn("place", F.concat_ws(".", "place.b_pos", "place.r_pos", "place.m_pos"))


@query(f"WITH {METRICS_SQL} SELECT target, benchmark, {_INT_SQL}, name, throughput, base_throughput, base_accept_length FROM based")
def attached_baselines(t):
    out = longs(B.attach_baseline(metrics(t), BASE))
    return out.select("target", "benchmark", *_INTS, "name", "throughput", "base_throughput", "base_accept_length")


@query(f"WITH {METRICS_SQL} SELECT target, benchmark, draft, config, count(*) AS n FROM labelled GROUP BY 1, 2, 3, 4")
def labelled_entries(t):
    out = B.label_entries(metrics(t), BASE)
    return out.groupBy("target", "benchmark", "draft", "config").agg(F.count("*").alias("n"))


@query(f"WITH {METRICS_SQL} SELECT * FROM entries")
def merged_entries(t):
    return entries(t)


@query(
    f"""WITH {METRICS_SQL} SELECT target, draft, config, string_agg(benchmark || '=' || accept_length, ',' ORDER BY benchmark) AS metrics,
  coalesce(string_agg(benchmark || '=' || base_accept_length, ',' ORDER BY benchmark), '') AS baseline FROM entries GROUP BY 1, 2, 3"""
)
def entry_maps(t):
    def flat(c):
        return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]["accept_length"])), ",")

    return B.as_maps(entries(t)).select("target", "draft", "config", flat("metrics").alias("metrics"), flat("baseline").alias("baseline"))


_RATIO = "nullif(throughput, 0) / nullif(base_throughput, 0)"


@query(
    f"""WITH {METRICS_SQL} SELECT target, draft, config, benchmark, round({_RATIO}, 2) AS speedup,
  CASE WHEN {_RATIO} IS NULL THEN '' WHEN {_RATIO} >= 2 THEN 'excellent' WHEN {_RATIO} >= 1.5 THEN 'good' WHEN {_RATIO} >= 1.1 THEN 'moderate' ELSE 'neutral' END AS class
FROM entries"""
)
def speedups(t):
    v, b = F.col("throughput"), F.col("base_throughput")
    return entries(t).select(
        "target", "draft", "config", "benchmark", B.speedup(v, b).alias("speedup"), B.speedup_class(v, b).alias("class")
    )


@query(f"WITH {METRICS_SQL} SELECT target, draft, config, round(avg({_RATIO}), 2) AS average_speedup FROM entries WHERE benchmark <> 'other' GROUP BY 1, 2, 3")
def average_speedups(t):
    return B.average_speedup(entries(t), B.BENCHMARKS)


def _pivot_sql(value: str, column: str) -> str:
    cols = ", ".join(f"coalesce(max({value}) FILTER (WHERE benchmark = '{b}'), 0)::DOUBLE AS {b}" for b in B.BENCHMARKS)
    return f"WITH {METRICS_SQL} SELECT target, draft, config, {cols} FROM entries WHERE benchmark <> 'other' AND {column} IS NOT NULL GROUP BY 1, 2, 3"


@query(_pivot_sql("round(throughput, 2)", "throughput"))
def throughput_table(t):
    return B.benchmark_table(entries(t))


@query(_pivot_sql("round(accept_length, 2)", "accept_length"))
def accept_length_table(t):
    return B.benchmark_table(entries(t), "accept_length")


@query(_pivot_sql("coalesce(round(throughput / nullif(base_throughput, 0), 2), 0)", "throughput"))
def speedup_table(t):
    return B.benchmark_table(entries(t), "speedup")


@query(f"WITH {METRICS_SQL} SELECT target, draft, config, coalesce(round(throughput / nullif(base_throughput, 0), 2), 0) AS value FROM entries WHERE benchmark = 'gsm8k' AND throughput IS NOT NULL")
def benchmark_series(t):
    return B.benchmark_series(entries(t), "gsm8k", "speedup")


@query(f"WITH {METRICS_SQL} SELECT target, draft, config, count(throughput) AS values FROM entries WHERE benchmark IN ('mtbench', 'gpqa') GROUP BY 1, 2, 3 HAVING count(throughput) > 0")
def entries_with_values(t):
    return B.with_any_value(entries(t), benchmarks=["mtbench", "gpqa"])


@query(f"WITH {METRICS_SQL} SELECT DISTINCT target, draft FROM entries")
def target_drafts(t):
    return B.drafts(entries(t))


@query(f"WITH {METRICS_SQL} SELECT DISTINCT target FROM entries")
def target_list(t):
    return B.targets(entries(t))


@query(f"WITH {METRICS_SQL} SELECT target, config, benchmark, throughput FROM entries WHERE draft = '{_DRAFTS['N']}'")
def entries_of_draft(t):
    return B.by_draft(entries(t), _DRAFTS["N"]).select("target", "config", "benchmark", "throughput")


@query(f"WITH {METRICS_SQL} SELECT target, count(DISTINCT draft) AS drafts, count(DISTINCT draft || '|' || config) AS configurations FROM entries GROUP BY 1")
def leaderboard_overview(t):
    return B.overview(entries(t))


@query(
    """SELECT p_brand AS target, bool_or(hw NOT IN ('', '-')) AS any_hardware FROM (
  SELECT p_brand, CASE WHEN p_size % 5 = 0 THEN '-' WHEN p_size > 20 OR p_brand < 'Brand#2' THEN '' ELSE p_type END AS hw FROM part) GROUP BY 1"""
)
def named_hardware(t):
    s = F.col("p_size")
    hw = F.when(s % 5 == 0, "-").when((s > 20) | (F.col("p_brand") < "Brand#2"), "").otherwise(F.col("p_type"))
    return B.any_hardware(t.part.select(F.col("p_brand").alias("target"), hw.alias("hardware")))


# --- model names, made of parts ------------------------------------------------------------------------------

_FORMS = ["'acme/Vendor-X-' || p_name", "'VENDOR-X/' || p_brand", "'vendor-x' || p_name", "'/Vendor-X'", "'acme//' || p_type || '/' || p_name", "'/' || p_brand || '-Bundle'", "'None'", "''"]
_NAME_SQL = f"names AS (SELECT p_partkey, CASE p_partkey % 8 {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(_FORMS))} END AS n FROM part)"
# Without look-ahead: a name that starts with the prefix and is not followed by - or /.
_STEP = "regexp_replace(regexp_replace(n, '(?i)(^|/)vendor-x-', '\\1', 'g'), '(?i)(^|/)vendor-x/', '\\1', 'g')"
_CLEAN = f"""steps AS (SELECT p_partkey, n, {_STEP} AS s FROM names),
tidy AS (SELECT p_partkey, n, regexp_replace(CASE WHEN s ILIKE 'vendor-x%' AND substr(s, 9, 1) NOT IN ('-', '/') THEN substr(s, 9) ELSE s END, '/+', '/', 'g') AS s FROM steps),
cleaned AS (SELECT p_partkey, n, CASE WHEN s = '' THEN n WHEN length(s) > 1 AND s LIKE '/%' THEN substr(s, 2) ELSE s END AS c FROM tidy)"""
_SHORT = "CASE WHEN n = '' THEN '-' WHEN string_split(c, '/')[-1] = '' THEN c ELSE string_split(c, '/')[-1] END"


@query(
    f"""WITH {_NAME_SQL}, {_CLEAN} SELECT p_partkey, c AS cleaned, {_SHORT} AS short,
  CASE WHEN n = '' THEN '-' WHEN n = 'None' THEN 'Baseline' WHEN contains(n, 'Bundle') THEN 'Bundle' ELSE {_SHORT} END AS label,
  CASE WHEN n IN ('', 'None') THEN 'baseline' WHEN contains(n, 'Bundle') THEN 'bundle' WHEN contains(lower(n), 'vendor') THEN 'vendor' ELSE 'default' END AS class
FROM cleaned"""
)
def model_names(t):
    forms = [F.expr(x) for x in _FORMS]
    k = F.col("p_partkey") % 8
    n = F.when(k == 0, forms[0])
    for i, x in enumerate(forms[1:], 1):
        n = n.when(k == i, x)
    df = t.part.select("p_partkey", n.alias("n"))
    n = F.col("n")
    return df.select(
        "p_partkey",
        B.clean_model_name(n, PREFIX).alias("cleaned"),
        B.short_name(n, PREFIX).alias("short"),
        B.draft_label(n, PREFIX, BUNDLE).alias("label"),
        B.draft_class(n, [(BUNDLE, "bundle", True), ("vendor", "vendor", False)]).alias("class"),
    )
