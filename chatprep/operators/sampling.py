"""Seeded order, limits, splits and shards.

Global ranks never sort in one task and never move a payload: keys alone are sorted by ranges,
as many and as large as Spark makes them, stored with their place in their range, and lifted by
the sizes of the earlier ranges.  That table has one row per range.  What else a row holds stays
where it is; :func:`attach` joins ranks to rows where that is wanted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatprep.functions.hashing import hex_number, seeded_key
from chatprep.session import scratch_folder
from chatprep.sources.files import keyed_stage

SEED = 42
HEX_DIGITS = 3  # 4096 buckets of keys, of which one is ranked to find the border of a split


def hash_order(seed: int | str, *keys: Column) -> list[Column]:
    """Sort columns of a seeded shuffle; the keys break hash ties."""
    return [seeded_key(seed, *keys), *keys]


def shuffle_rows(df: DataFrame, keys: Sequence[str], seed: int | str = SEED) -> DataFrame:
    """Rows in seeded random order (a range-partitioned sort)."""
    return df.orderBy(*hash_order(seed, *[F.col(k) for k in keys]))


def rank_keys(df: DataFrame, order: Sequence[Column], columns: Sequence[str], name: str = "rank", within: Sequence[str] = ()) -> DataFrame:
    """``within, columns, name``: the zero-based position of every key (per ``within`` group).

    ``order`` is a total order of the rows of a group.
    """
    within, columns = list(within), list(columns)
    by = {f"__o{i}": c for i, c in enumerate(order)}
    narrow = df.select(*[F.col(c) for c in dict.fromkeys([*within, *columns])], *[c.alias(n) for n, c in by.items()])
    ranges = [*within, *by]
    # A row's number holds its range above 33 bits and its place in it below.
    placed = narrow.repartitionByRange(*ranges).sortWithinPartitions(*ranges).drop(*by)
    placed = keyed_stage(placed.withColumn("__at", F.monotonically_increasing_id()), scratch_folder(df.sparkSession, "ranks"), {})
    part = F.shiftright("__at", 33).alias("__part")
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    base = placed.groupBy(part).agg(F.count("*").alias("__n"))
    base = base.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    place = F.col("__base") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = placed.withColumn("__part", part).join(F.broadcast(base), "__part").withColumn(name, place)
    if within:
        # Its size follows from the number of groups; the planner decides how it is joined.
        first = ranked.groupBy(*within).agg(F.min(name).alias("__first"))
        ranked = ranked.join(first, within).withColumn(name, F.col(name) - F.col("__first"))
    return ranked.select(*dict.fromkeys([*within, *columns, name]))


def attach(df: DataFrame, ranks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the columns of their key's rank: this moves whole rows, unless the ranks are few."""
    return df.join(ranks, list(keys))


def rank_by_hash(
    df: DataFrame, keys: Sequence[str], seed: int | str = SEED, name: str = "rank", within: Sequence[str] = ()
) -> DataFrame:
    """Keys with their position in the seeded shuffle (per ``within`` group)."""
    cols = [F.col(k) for k in keys]
    return rank_keys(df, hash_order(seed, *cols), keys, name, within)


def rank_by_key(df: DataFrame, key: str, name: str = "rank", within: Sequence[str] = ()) -> DataFrame:
    """Keys (unique within their group) with their position."""
    return rank_keys(df, [F.col(key)], [key], name, within)


def row_index(df: DataFrame, key: str, name: str = "id") -> DataFrame:
    """Keys with 0..n-1 in their order."""
    return rank_by_key(df, key, name)


def first_n(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows; the order is always explicit."""
    return df.orderBy(*order).limit(n)


def limit_per_group(df: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """The first ``n`` rows of every group by a unique key.

    Two steps, so that a group holding most of the rows is cut by many tasks
    before one task sees what is left.
    """
    salted = df.withColumn("__salt", F.pmod(F.hash(key), F.lit(64)))
    rough = Window.partitionBy(group, "__salt").orderBy(key)
    cut = salted.withColumn("__rn", F.row_number().over(rough)).filter(F.col("__rn") <= n).drop("__rn", "__salt")
    exact = Window.partitionBy(group).orderBy(key)
    return cut.withColumn("__rn", F.row_number().over(exact)).filter(F.col("__rn") <= n).drop("__rn")


def limit_then_filter(df: DataFrame, order: Sequence[str], n: int, valid: Column) -> DataFrame:
    """Take ``n`` rows first, then drop invalid ones (fewer than ``n`` may remain)."""
    return first_n(df, order, n).filter(valid)


def filter_then_limit(df: DataFrame, order: Sequence[str], n: int, valid: Column) -> DataFrame:
    return first_n(df.filter(valid), order, n)


def split_exact(
    df: DataFrame, keys: Sequence[str], test_share: float = 0.05, seed: int | str = SEED, name: str = "split"
) -> DataFrame:
    """Label rows train/test; the test part has exactly ``ceil(share * n)`` rows.

    The last test row in hash order is found from the keys alone: counts of hash buckets tell
    its bucket, and only that bucket is ranked.  Rows are then compared with it where they
    lie, so none of them moves.
    """
    named = df.select(*keys)
    hashed = named.withColumn("__h", seeded_key(seed, *[F.col(k) for k in keys]))
    hashed = hashed.withColumn("__b", hex_number(F.col("__h"), HEX_DIGITS))
    upto = Window.orderBy("__b")  # one row per bucket
    sizes = hashed.groupBy("__b").agg(F.count("*").alias("__n")).withColumns(
        {"__upto": F.sum("__n").over(upto), "__all": F.sum("__n").over(upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))}
    )
    wanted = F.ceil(F.lit(test_share) * F.col("__all"))
    border = sizes.filter((F.col("__upto") >= wanted) & (F.col("__upto") - F.col("__n") < wanted)).select(
        "__b", (wanted - F.col("__upto") + F.col("__n")).alias("__k")
    )
    place = F.row_number().over(Window.partitionBy("__b").orderBy("__h", *keys))
    last = hashed.join(F.broadcast(border), "__b").withColumn("__r", place).filter("__r = __k")
    limit = last.agg(F.max(F.struct("__h", *keys))).scalar()
    mine = F.struct(seeded_key(seed, *[F.col(k) for k in keys]).alias("__h"), *keys)
    return df.withColumn(name, F.when(mine <= limit, F.lit("test")).otherwise(F.lit("train")))


def split_by_hash(
    df: DataFrame, keys: Sequence[str], test_share: float = 0.05, seed: int | str = SEED, name: str = "split"
) -> DataFrame:
    """Label rows train/test by a hash threshold: no shuffle, share holds on average."""
    space = 16**7
    draw = hex_number(seeded_key(seed, *[F.col(k) for k in keys]))
    return df.withColumn(
        name, F.when(draw < F.lit(math.ceil(test_share * space)), F.lit("test")).otherwise(F.lit("train"))
    )


def strided_shards(
    df: DataFrame, keys: Sequence[str], world: int, batch_size: int, seed: int | str = SEED, drop_last: bool = True
) -> DataFrame:
    """Keys with ``rank`` and ``batch_id`` in shuffled order, stride ``world``.

    A rank's incomplete last batch is dropped.  Its size follows from the number
    of rows, so no second grouping is needed.
    """
    ranked = rank_by_hash(df, keys, seed, "__pos")
    total = F.lit(ranked.count())  # of a stored table
    dealt = ranked.withColumns(
        {"rank": F.col("__pos") % world, "__in_rank": F.floor(F.col("__pos") / world)}
    )
    rows = F.floor((total - F.col("rank") + (world - 1)) / world)
    dealt = dealt.withColumns(
        {"batch_id": F.floor(F.col("__in_rank") / batch_size), "__full": F.floor(rows / batch_size)}
    )
    if drop_last:
        dealt = dealt.filter(F.col("batch_id") < F.col("__full"))
    return dealt.drop("__pos", "__in_rank", "__full")


def contiguous_shards(df: DataFrame, key: str, world: int, name: str = "rank") -> DataFrame:
    """Keys in contiguous parts; the first ``n mod world`` parts get one more row."""
    ranked = rank_by_key(df, key, "__pos")
    size, extra = divmod(ranked.count(), world)  # of a stored table
    pos = F.col("__pos")
    head = extra * (size + 1)
    rank = F.when(pos < head, F.floor(pos / (size + 1))).otherwise(extra + F.floor((pos - head) / max(size, 1)))
    return ranked.withColumn(name, rank.cast("bigint")).drop("__pos")


def resume_from(df: DataFrame, batch_id: str, done: int) -> DataFrame:
    """Fast-forward: skip the batches that are already done."""
    return df.filter(F.col(batch_id) >= done)
