"""Mixing sources to target weights: how often each document is copied, by pivotal rounding.

A source's target is a share of all words by its weight, at most ``CAP`` times what the source
has; what is above is shared again among the others.  Target over size is the number of copies
that each of its documents should have, a fraction.  Its whole part is taken as it is.  The
remaining fractions become 0 or 1 by pivotal dependent rounding: two documents are paired and as
many words are moved from one to the other as make one of them whole (left out, or taken once
more), in one direction or the other at random, so that each keeps its expectation and both
together keep their words.  The document that stays fractional is paired with the next.

The pairing is a reduction tree.  Documents of a source are dealt by a hash to groups of about
``GROUP``; each group is rounded down to one fractional document, largest first, and the
fractional documents of ``GROUP`` neighbouring groups form a group of the next level, until a source
is one group.  About ``GROUP`` documents of each source wait for that last group, so that it holds
small ones too.  Its last document is rounded to the nearer side, not at random: a source's words
differ from its target by half of one document at most, usually a small one, and only where one
document is most of its source is that document's expectation not kept.  A level is a shuffle of the
fractional documents alone.

Rows with one doc_id, source and size are one entry with a count: together they are rounded to a
whole number of copies, dealt evenly to the rows.  Draws are md5 hashes of a seed, doc_id and size,
so a rerun gives the same mix, however the rows are partitioned.

Nulls: a null text has no words; a null source is a source of its own, the last one; a missing
doc_id is one more id.  Documents without words are taken 0 words.  Where no source has words, all
targets are 0.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.functions.arrays import let
from chatprep.functions.hashing import hex_number, seeded_key
from chatprep.llm.common import store
from chatprep.operators.sampling import rank_keys

SHARE = 1.5
CAP = 2
WEIGHTS = (5, 2, 1)
SEED = 42
GROUP = 64
BLOCK = 1 << 14  # rows of one entry that a task makes at once

_DIGITS = 13  # hex digits of a draw: 52 bits
_ITEM = ["doc_id", "size", "n_rows", "whole", "mass"]
_ITEM_TYPE = "doc_id: bigint, size: bigint, n_rows: bigint, whole: bigint, mass: double"


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; each becomes one character, and the rest goes."""
    marks = F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), r"[\x20\x09-\x0D]+", "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


# --- targets -------------------------------------------------------------------------------------


def entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size, n_rows``: equal rows are one entry."""
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        docs[source_col].cast("string").alias("source"),
        word_count(docs[text_col].cast("string")).alias("size"),
    )
    return rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n_rows"))


def targets(sources: DataFrame) -> DataFrame:
    """``sources`` (source, source_size, ...) with ``weight`` and ``target``, the words to take.

    Sources are numbered in the order of their code points, null last; weights repeat in that
    order.  Sharing what is above a cap again among the rest raises what one unit of weight gets;
    it ends when no further source reaches its cap.
    """
    ranked = rank_keys(sources, [F.col("source").isNull(), F.col("source")], sources.columns, "_place")
    place = (F.col("_place") % len(WEIGHTS)).cast("int")
    weighed = ranked.withColumn("weight", F.get(F.array(*map(F.lit, WEIGHTS)), place)).drop("_place")
    weighed = store(weighed, "weighed-sources")
    cap = CAP * F.col("source_size")
    totals = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted, unit, capped = SHARE * (totals[0] or 0), 0.0, -1
    rest, full = totals[1] or 0, 0
    while rest:
        unit = (wanted - full) / rest
        at_cap = cap <= unit * F.col("weight")
        n, full, rest = weighed.agg(
            F.count_if(at_cap), F.coalesce(F.sum(F.when(at_cap, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~at_cap, F.col("weight"))), F.lit(0))
        ).first()
        if n == capped:
            break
        capped = n
    return weighed.withColumn("target", F.least(cap.cast("double"), unit * F.col("weight")))


# --- rounding --------------------------------------------------------------------------------------


def _pair(state: Column, item: Column) -> Column:
    """Make one of two fractional documents whole: ``left`` stays, ``done`` gets the other one."""
    a, b = state["left"], item
    room_a, room_b = a["size"] - a["mass"], b["size"] - b["mass"]
    to_a, to_b = F.least(room_a, b["mass"]), F.least(a["mass"], room_b)

    def with_mass(x: Column, mass: Column) -> Column:
        return F.struct(*[(mass if c == "mass" else x[c]).alias(c) for c in _ITEM])

    def outcome(left: Column, mass: Column, done: Column, up: int) -> Column:
        made = F.struct(*[done[c].alias(c) for c in _ITEM[:3]], (done["whole"] + up).alias("copies"))
        return F.struct(with_mass(left, mass).alias("left"), made.alias("made"))

    # Where neither can give or take, both are whole already and the draw does not matter.
    chosen = F.when(
        b["draw"] * (to_a + to_b) < to_b,
        F.when(room_a <= b["mass"], outcome(b, b["mass"] - to_a, a, 1)).otherwise(outcome(a, a["mass"] + to_a, b, 0)),
    ).otherwise(F.when(a["mass"] <= room_b, outcome(b, b["mass"] + to_b, a, 0)).otherwise(outcome(a, a["mass"] - to_b, b, 1)))
    return let(chosen, lambda c: F.struct(c["left"].alias("left"), F.concat(state["done"], F.array(c["made"])).alias("done")))


def _round_groups(items: DataFrame, level: int) -> DataFrame:
    """Per source and group: the documents made whole (``done``) and the one that is left."""
    keys = ["source", "source_size", "target", "bucket"]
    draw = hex_number(seeded_key(f"{SEED}:{level}", F.col("doc_id"), F.col("size")), _DIGITS) / float(16**_DIGITS)
    listed = F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("first"), draw.alias("draw"), *_ITEM)))
    head = F.get("items", F.lit(0))
    start = F.struct(F.struct(*[head[c].alias(c) for c in _ITEM]).alias("left"), F.array().cast(f"array<struct<{_DONE_TYPE}>>").alias("done"))
    rounded = F.aggregate(F.slice("items", F.lit(2), F.greatest(F.size("items") - 1, F.lit(0))), start, _pair)
    return items.groupBy(*keys).agg(listed.alias("items")).select(*keys, rounded.alias("rounded"))


_DONE_TYPE = "doc_id: bigint, size: bigint, n_rows: bigint, copies: bigint"


def copies(dealt: DataFrame, most: int) -> DataFrame:
    """``doc_id, source, source_size, target, size, n_rows, copies`` of entries joined to their source.

    ``most`` is the number of entries of the largest source; with it the number of levels is known.
    """
    of = ["source", "source_size", "target"]
    wanted = F.when(F.col("source_size") > 0, F.col("n_rows") * (F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    items = dealt.withColumn("wanted", wanted).withColumn("whole", F.floor("wanted"))
    items = items.withColumn("mass", (F.col("wanted") - F.col("whole")) * F.col("size"))
    fractional = (F.col("mass") > 0) & (F.col("mass") < F.col("size"))
    groups = F.greatest(F.ceil(F.col("n_entries") / GROUP), F.lit(1))
    # One group more than needed: where there are several, its documents wait for the last level.
    bucket = hex_number(seeded_key(SEED, F.col("doc_id"), F.col("size")), _DIGITS) % (groups + F.when(groups > 1, 1).otherwise(0))
    items = items.withColumns({"fractional": fractional, "bucket": bucket.cast("long"), "waits": bucket == groups})
    items = store(items.select(*of, "bucket", "fractional", "waits", *_ITEM), "mix-items")
    made = [items.where("NOT fractional").select(*of, "doc_id", "size", "n_rows", F.col("whole").alias("copies"))]
    open_ = items.where("fractional AND NOT waits").select(*of, "bucket", *_ITEM)
    waiting = items.where("fractional AND waits").select(*of, F.lit(0).cast("long").alias("bucket"), *_ITEM)
    level, buckets = 0, max(1, math.ceil(most / GROUP))
    while True:
        rounded = store(_round_groups(open_ if buckets > 1 else open_.unionByName(waiting), level), f"rounded-{level}")
        made.append(rounded.select(*of, F.explode("rounded.done").alias("d")).select(*of, "d.*"))
        open_ = rounded.select(*of, F.floor(F.col("bucket") / GROUP).alias("bucket"), "rounded.left.*")
        if buckets == 1:
            break
        level, buckets = level + 1, math.ceil(buckets / GROUP)
    nearer = F.when(2 * F.col("mass") >= F.col("size"), 1).otherwise(0)
    made.append(open_.select(*of, "doc_id", "size", "n_rows", (F.col("whole") + nearer).alias("copies")))
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def rows_of(found: DataFrame) -> DataFrame:
    """One row per row of each entry: its copies are dealt evenly, the first rows get what is over."""
    small = found.where(F.col("n_rows") <= BLOCK).withColumn("from", F.lit(0).cast("long"))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_rows") - 1) / BLOCK)))
    large = found.where(F.col("n_rows") > BLOCK).withColumn("from", block).withColumn("from", F.col("from") * BLOCK).repartition("doc_id", "from")
    upto = F.least(F.col("from") + BLOCK, F.col("n_rows")) - 1
    each = small.unionByName(large).withColumn("row", F.explode(F.sequence(F.col("from"), upto)))
    base, over = F.floor(F.col("copies") / F.col("n_rows")), F.col("copies") % F.col("n_rows")
    mine = base + F.when(F.col("row") < over, 1).otherwise(0)
    return each.select("doc_id", "size", "source_size", "target", (mine * F.col("size")).alias("taken"), mine.alias("copies"), "source")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, source`` of every row."""
    found = store(entries(docs, id_col, text_col, source_col), "mix-entries")
    sums = [F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.count("*").alias("n_entries")]
    sources = targets(store(found.groupBy("source").agg(*sums), "mix-sources"))
    sources = store(sources.withColumnRenamed("source", "_source"), "mix-targets")
    most = sources.agg(F.max("n_entries")).first()[0] or 0
    # As many rows as sources: the planner sends them to all tasks only where the stored table is small.
    dealt = found.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "weight")
    return rows_of(copies(dealt, most))
