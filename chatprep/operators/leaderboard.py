"""Result analytics: baselines, speedups and benchmark tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.functions.arrays import let

# Column order of the tables, limits of the speedup classes.
BENCHMARKS = ["gsm8k", "math500", "mtbench", "humaneval", "livecodebench", "financeqa", "gpqa"]
CLASSES = ((2.0, "excellent"), (1.5, "good"), (1.1, "moderate"))
REST_CLASS = "neutral"
BASELINE_DRAFT, BASELINE_CONFIG = "None", "baseline"

CONFIG = ("batch_size", "steps", "topk", "num_draft_tokens")
VALUES = ("throughput", "accept_length")


def flatten_documents(documents: DataFrame, baseline_name: str | None = None, column: str = "document") -> DataFrame:
    """Nested documents to one row per metric, with its place in the document.

    With ``baseline_name`` every row also gets the values of the first metric of that
    name in the same result; they are taken from the result's own list, without a join.
    """
    rows = documents.select(F.posexplode(column).alias("t_pos", "target", "__b"))
    rows = rows.select("target", F.posexplode("__b").alias("b_pos", "key", "__r"))
    rows = rows.select(
        "target", "b_pos", F.col("__r.benchmark_name").alias("benchmark"), F.posexplode("__r.results").alias("r_pos", "r")
    )
    base = F.get(F.filter("r.metrics", lambda m: m["Name"] == F.lit(baseline_name)), F.lit(0))
    rows = rows.select(
        "target",
        "benchmark",
        "b_pos",
        "r_pos",
        *[F.col(f"r.{c}").alias(c) for c in CONFIG],
        *([base.alias("base")] if baseline_name is not None else []),
        F.posexplode("r.metrics").alias("m_pos", "m"),
    )
    flat = [
        "target",
        "benchmark",
        *CONFIG,
        F.struct("b_pos", "r_pos", "m_pos").alias("place"),
        F.col("m.Name").alias("name"),
        F.col("m.output_throughput").alias("throughput"),
        F.col("m.accept_length").alias("accept_length"),
    ]
    if baseline_name is not None:
        flat += [
            F.col("base.output_throughput").alias("base_throughput"),
            F.col("base.accept_length").alias("base_accept_length"),
        ]
    return rows.select(*flat)


def attach_baseline(metrics: DataFrame, baseline_name: str) -> DataFrame:
    """The same for a flat table of metrics: join each row with the first baseline of
    its result.  Baselines are reduced to one row per result before the join."""
    keys = ["target", "__b", "__r"]
    placed = metrics.withColumns({"__b": F.col("place.b_pos"), "__r": F.col("place.r_pos")})
    base = (
        placed.filter(F.col("name") == baseline_name)
        .groupBy(*keys)
        .agg(F.min_by(F.struct(*VALUES), F.col("place")).alias("__base"))
    )
    joined = placed.join(base, keys, "left")
    return joined.select(
        *metrics.columns, *[F.col(f"__base.{v}").alias(f"base_{v}") for v in VALUES]
    )


def label_entries(metrics: DataFrame, baseline_name: str) -> DataFrame:
    """Add ``draft`` and ``config``: baseline rows share one configuration."""
    is_base = F.col("name") == baseline_name
    parts = F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in CONFIG])
    return metrics.withColumns(
        {
            "draft": F.when(is_base, BASELINE_DRAFT).otherwise(F.col("name")),
            "config": F.when(is_base, BASELINE_CONFIG).otherwise(parts),
        }
    )


def merge_entries(labelled: DataFrame) -> DataFrame:
    """One row per (target, draft, config, benchmark): the last value in the document
    wins, for the baseline the last one that exists."""
    values, base = F.struct(*VALUES), F.struct(*[f"base_{v}" for v in VALUES])
    has_base = F.coalesce(*[F.col(f"base_{v}") for v in VALUES]).isNotNull()
    return (
        labelled.groupBy("target", "draft", "config", "benchmark")
        .agg(
            F.max_by(values, F.col("place")).alias("v"),
            F.max_by(F.when(has_base, base), F.when(has_base, F.col("place"))).alias("b"),
        )
        .select("target", "draft", "config", "benchmark", "v.*", *[f"b.base_{v}" for v in VALUES])
    )


def as_maps(entries: DataFrame) -> DataFrame:
    """One row per (target, draft, config) with maps by benchmark.

    Benchmarks are a short fixed list, so the collected groups are small.
    """
    item = F.struct(F.col("benchmark"), F.struct(*VALUES).alias("v"))
    base = F.struct(F.col("benchmark"), F.struct(*[F.col(f"base_{v}").alias(v) for v in VALUES]).alias("v"))
    has_base = F.coalesce(*[F.col(f"base_{v}") for v in VALUES]).isNotNull()
    return entries.groupBy("target", "draft", "config").agg(
        F.map_from_entries(F.sort_array(F.collect_list(item))).alias("metrics"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(has_base, base)))).alias("baseline"),
    )


# --- speedup ----------------------------------------------------------------------------------


def ratio(value: Column, base: Column) -> Column:
    """value / base; null when either is missing or zero."""
    return F.nullif(value, F.lit(0.0)) / F.nullif(base, F.lit(0.0))


def speedup(value: Column, base: Column) -> Column:
    return F.round(ratio(value, base), 2)


def speedup_class(value: Column, base: Column) -> Column:
    r = ratio(value, base)
    out = F.when(r.isNull(), F.lit(""))
    for limit, name in CLASSES:
        out = out.when(r >= limit, name)
    return out.otherwise(REST_CLASS)


def average_speedup(entries: DataFrame, benchmarks: Sequence[str] | None = None) -> DataFrame:
    """Mean of the unrounded speedups over benchmarks that have both values."""
    chosen = entries if benchmarks is None else entries.filter(F.col("benchmark").isin(list(benchmarks)))
    r = F.when(F.col("base_throughput") > 0, ratio(F.col("throughput"), F.col("base_throughput")))
    return chosen.groupBy("target", "draft", "config").agg(F.round(F.avg(r), 2).alias("average_speedup"))


# --- names ---------------------------------------------------------------------------------------


def clean_model_name(name: Column, prefix: str) -> Column:
    """A path-like model name without the vendor (any case) and without empty parts.

    Of each part the vendor and a hyphen go from its start; a part that is the vendor alone goes,
    unless it is the last; from the start of the name the vendor goes without a hyphen, too.  An
    empty result gives the name back.
    """
    vendor, size = F.lit(prefix.lower()), len(prefix)

    def after(part: Column, n: int) -> Column:
        return F.substring(part, F.lit(n + 1), F.length(part))

    def starts(part: Column, text: Column) -> Column:
        return F.startswith(F.lower(part), text)

    def tidy(parts: Column) -> Column:
        last = F.size(parts) - 1
        return F.filter(parts, lambda part, i: ((part != "") & (F.lower(part) != vendor)) | (i == last))

    def bare(parts: Column) -> Column:
        alone = F.size(parts) == 1

        def start(part: Column) -> Column:
            stuck = starts(part, vendor) & ~starts(part, F.concat(vendor, F.lit("-"))) & (alone | (F.length(part) > size))
            return F.when(stuck, after(part, size)).otherwise(part)

        return F.transform(parts, lambda part, i: F.when(i == 0, start(part)).otherwise(part))

    hyphen = F.concat(vendor, F.lit("-"))
    parts = F.transform(F.split(name, "/"), lambda part: F.when(starts(part, hyphen), after(part, size + 1)).otherwise(part))
    led = F.startswith(name, F.lit("/"))  # then no part stands at the start
    cleaned = let(parts, lambda ps: let(tidy(ps), lambda kept: F.when(led, kept).otherwise(bare(kept))))
    out = F.array_join(let(cleaned, tidy), "/")
    return F.when(out == "", name).otherwise(out)


def short_name(name: Column, prefix: str) -> Column:
    """Last path part of the cleaned name (the cleaned name when that is empty)."""
    cleaned = clean_model_name(name, prefix)
    last = F.element_at(F.split(cleaned, "/"), -1)
    return (
        F.when(F.coalesce(name, F.lit("")) == "", F.lit("-")).when(last == "", cleaned).otherwise(last)
    )


def draft_label(draft: Column, prefix: str, bundle: str | None = None) -> Column:
    """``Baseline`` for rows without a draft model, the bundle's name when the draft
    contains it, else the short name."""
    out = F.when(F.coalesce(draft, F.lit("")) == "", F.lit("-")).when(draft.isin("-", BASELINE_DRAFT), "Baseline")
    if bundle:
        out = out.when(F.contains(draft, F.lit(bundle)), bundle)
    return out.otherwise(short_name(draft, prefix))


def draft_class(draft: Column, rules: Sequence[tuple[str, str, bool]] = ()) -> Column:
    """Class by substring; a rule is ``(needle, class, case_matters)``, first hit wins."""
    out = F.when(F.coalesce(draft, F.lit("")).isin("", "-", BASELINE_DRAFT), "baseline")
    for needle, name, exact in rules:
        text = draft if exact else F.lower(draft)
        out = out.when(F.contains(text, F.lit(needle if exact else needle.lower())), name)
    return out.otherwise("default")


# --- tables -------------------------------------------------------------------------------------


def targets(entries: DataFrame) -> DataFrame:
    return entries.select("target").filter(F.col("target") != "").distinct()


def drafts(entries: DataFrame, target: str | None = None) -> DataFrame:
    rows = entries if target is None else entries.filter(F.col("target") == target)
    return rows.select("target", "draft").filter(F.col("draft") != "").distinct()


def by_draft(entries: DataFrame, draft: str | None) -> DataFrame:
    return entries if draft in (None, "all") else entries.filter(F.col("draft") == draft)


def shown_value(metric: str) -> Column:
    """Value of a cell: ``throughput``, ``accept_length`` or ``speedup``, 2 decimals."""
    if metric == "speedup":
        return F.coalesce(
            F.round(F.try_divide(F.col("throughput"), F.nullif("base_throughput", F.lit(0.0))), 2), F.lit(0.0)
        )
    return F.round(F.col(metric), 2)


def with_any_value(entries: DataFrame, metric: str = "throughput", benchmarks: Sequence[str] = BENCHMARKS) -> DataFrame:
    """(target, draft, config) with a value for at least one of the benchmarks."""
    column = "accept_length" if metric == "accept_length" else "throughput"
    return (
        entries.filter(F.col("benchmark").isin(list(benchmarks)))
        .groupBy("target", "draft", "config")
        .agg(F.count(column).alias("values"))
        .filter(F.col("values") > 0)
    )


def benchmark_table(entries: DataFrame, metric: str = "throughput", benchmarks: Sequence[str] = BENCHMARKS) -> DataFrame:
    """One row per (target, draft, config), one column per benchmark, missing as 0.

    The pivot values are given, so the table is one aggregation.
    """
    column = "accept_length" if metric == "accept_length" else "throughput"
    rows = entries.filter(F.col("benchmark").isin(list(benchmarks)) & F.col(column).isNotNull())
    wide = (
        rows.withColumn("__v", shown_value(metric))
        .groupBy("target", "draft", "config")
        .pivot("benchmark", list(benchmarks))
        .agg(F.max("__v"))
    )
    return wide.fillna(0.0, list(benchmarks))


def benchmark_series(entries: DataFrame, benchmark: str, metric: str = "throughput") -> DataFrame:
    """One benchmark's values by configuration."""
    column = "accept_length" if metric == "accept_length" else "throughput"
    rows = entries.filter((F.col("benchmark") == benchmark) & F.col(column).isNotNull())
    return rows.select("target", "draft", "config", shown_value(metric).alias("value"))


def overview(entries: DataFrame) -> DataFrame:
    """Number of draft models and of entries per target."""
    return entries.groupBy("target").agg(
        F.count_distinct("draft").alias("drafts"), F.count_distinct("draft", "config").alias("configurations")
    )


def any_hardware(entries: DataFrame, column: str = "hardware") -> DataFrame:
    """True per target when some row names its hardware."""
    named = F.coalesce(F.col(column), F.lit("-"))
    return entries.groupBy("target").agg(F.bool_or(~named.isin("", "-")).alias("any_hardware"))
