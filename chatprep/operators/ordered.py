"""Order-aware operators that never put an unbounded group into one task.

A window over ``(key, order)`` sends every row of a key to one task.  Here a key is
always cut into blocks of at most ``block`` consecutive order values.  A narrow copy of the
rows is summed up to one row per block, windows over these rows tell what came before each
block, and that goes into the rows as one more row, the head, with which a block begins.
Windows per ``(key, block)`` then see it like any other row: the table is read twice, and
the rows move once.

Rows whose order value is null come first.  Rows with the same order value are told apart
by the hash of their ``ties``; rows equal in that as well are repeats and count once.  Without
``ties`` a null or repeated order value is an error.  A null key is a key like any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chatprep.functions.hashing import hex_number

BLOCK = 4096
BLK, TIE, HEAD = "__block", "__tie", "__head"
_LOST = -(1 << 62)  # blocks of rows without an order value begin here


def in_blocks(df: DataFrame, order: str, ties: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """Rows with their block and tie; rows without an order value are spread over blocks by tie."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in ties]
    tie = F.md5(F.concat_ws("\u0001", *texts)) if ties else F.lit("")
    value = F.col(order).cast("bigint")
    number = F.when(value.isNotNull(), F.expr(f"(cast(`{order}` AS bigint) - pmod(cast(`{order}` AS bigint), {block}L)) div {block}L"))
    lost = F.lit(_LOST) + hex_number(F.col(TIE), 3) if ties else F.lit(_LOST)
    return df.withColumn(TIE, tie).withColumn(BLK, F.coalesce(number, lost).cast("bigint"))


def block_rows(keys: Sequence[str], order: str, heads: bool = False) -> WindowSpec:
    """The rows of a block in order, behind its head if there is one."""
    first = [F.col(HEAD).desc()] if heads else []
    return Window.partitionBy(*keys, BLK).orderBy(*first, F.col(order).asc_nulls_first(), TIE)


def once(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], heads: bool = False) -> DataFrame:
    """Every row once; without ties a null or repeated order value is an error."""
    rows = block_rows(keys, order, heads)
    tie, value = F.lag(TIE).over(rows), F.lag(order).over(rows)
    same = value.eqNullSafe(F.col(order))
    if ties:
        marked = df.withColumn("__again", F.coalesce(tie == F.col(TIE), F.lit(False)) & same)  # heads have no tie
    else:
        what = F.concat(F.lit(f"null or repeated {order} in a key: "), F.coalesce(F.col(order).cast("string"), F.lit("null")))
        bad = F.col(TIE).isNotNull() & (F.col(order).isNull() | (tie.isNotNull() & same))
        marked = df.withColumn("__again", F.when(bad, F.raise_error(what).cast("boolean")).otherwise(F.lit(False)))
    return marked.filter(~F.col("__again")).drop("__again")


def with_heads(df: DataFrame, heads: DataFrame) -> DataFrame:
    """The rows, and the heads of those blocks that have one."""
    return df.withColumn(HEAD, F.lit(False)).unionByName(heads.withColumn(HEAD, F.lit(True)), allowMissingColumns=True)


def earlier_blocks(keys: Sequence[str]) -> tuple[WindowSpec, WindowSpec]:
    """A key's blocks in order, and those before the current one."""
    blocks = Window.partitionBy(*keys).orderBy(BLK)
    return blocks, blocks.rowsBetween(Window.unboundedPreceding, -1)


def scan_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    lags: Mapping[str, str] | None = None,
    sums: Mapping[str, Column] | None = None,
    inclusive: bool = False,
    block: int = BLOCK,
    lasts: Mapping[str, str] | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Add look-back columns per key: preceding values and running totals.

    ``lags`` maps a new column to the column whose preceding value it takes, ``lasts``
    to the column whose last value before this row that is not null it takes,
    ``sums`` maps a new column to an expression that is summed over the earlier rows
    (over this row too when ``inclusive``; null counts as 0; bigint).  ``order``
    must be an integer column.
    """
    keys, lags, sums, lasts = list(keys), dict(lags or {}), dict(sums or {}), dict(lasts or {})
    lag, last, total = ({new: f"__{kind}_{new}" for new in of} for kind, of in (("lag", lags), ("last", lasts), ("sum", sums)))
    values = {lag[new]: F.col(c) for new, c in lags.items()} | {last[new]: F.col(c) for new, c in lasts.items()}
    values |= {total[new]: F.coalesce(e, F.lit(0)).cast("bigint") for new, e in sums.items()}
    placed = in_blocks(df, order, ties, block).withColumns(values)

    local = once(placed.select(*keys, order, BLK, TIE, *values), keys, order, ties)
    local = local.withColumn("__n", F.row_number().over(block_rows(keys, order)))
    blocks, earlier = earlier_blocks(keys)
    heads = (
        local.groupBy(*keys, BLK)
        .agg(
            *[F.max_by(c, "__n").alias(c) for c in lag.values()],
            *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__n"))).alias(c) for c in last.values()],
            *[F.sum(c).alias(c) for c in total.values()],
        )
        .withColumns(
            {c: F.lag(c).over(blocks) for c in lag.values()}
            | {c: F.last(c, ignorenulls=True).over(earlier) for c in last.values()}
            | {c: F.sum(c).over(earlier) for c in total.values()}
            | {"__seen": F.lag(F.lit(True)).over(blocks)}
        )
        .filter("__seen")
        .drop("__seen")
    )
    rows = block_rows(keys, order, heads=True)
    above = rows.rowsBetween(Window.unboundedPreceding, -1)
    upto = rows.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = once(with_heads(placed, heads), keys, order, ties, heads=True).withColumns(
        {new: F.lag(c).over(rows) for new, c in lag.items()}
        | {new: F.last(c, ignorenulls=True).over(above) for new, c in last.items()}
        | {new: F.coalesce(F.sum(c).over(upto), F.lit(0)).cast("bigint") for new, c in total.items()}
    )
    return out.filter(~F.col(HEAD)).drop(BLK, TIE, HEAD, *values)
