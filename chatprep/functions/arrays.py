"""Row-local array operators on token ids and masks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it as a variable.

    A column that is captured by a lambda may be inlined there and evaluated for
    every element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


SUM_CHUNK = 64
SUM_GROUP = 4
SUM_ROUNDS = 2


def prefix_sums(values: Column) -> Column:
    """Totals before each entry and, last, of all of them (bigint).

    An array that grows by one entry is copied each time, so entries are taken in groups of four
    first: the totals of the groups are summed up alike, and a group's entries follow from the total
    before it.  What is left after two rounds goes by chunks that grow.  More rounds would nest deeper:
    the analyzer takes a pass for each lambda inside another and for each type it has to adapt, and
    gives up after 100 for the whole expression.  Hence also the plain casts.
    """
    zero = F.lit(0).cast("bigint")

    def grown(part: Column, base: Column) -> Column:
        first = F.struct(base.alias("now"), F.array().cast("array<bigint>").alias("all"))

        def add(acc: Column, x: Column) -> Column:
            now = (acc["now"] + x).cast("bigint")
            return F.struct(now.alias("now"), F.concat(acc["all"], F.array(acc["now"])).alias("all"))

        return F.aggregate(part, first, add, lambda acc: acc["all"])

    def by_chunk(all_: Column) -> Column:
        """Totals before each entry."""
        starts = F.sequence(F.lit(1), F.greatest(F.size(all_), F.lit(1)), F.lit(SUM_CHUNK))

        def chunks(ps: Column) -> Column:
            totals = F.transform(ps, lambda p: F.aggregate(p, zero, lambda a, x: (a + x).cast("bigint")))
            return F.flatten(F.zip_with(ps, grown(totals, zero), grown))

        return let(F.transform(starts, lambda s: F.slice(all_, s, SUM_CHUNK)), chunks)

    def by_group(all_: Column, rounds: int) -> Column:
        """Totals before each entry, and some more behind them; ``all_`` is a variable."""
        if not rounds:
            return by_chunk(all_)
        firsts = F.sequence(F.lit(0), F.greatest(F.size(all_) - 1, F.lit(0)), F.lit(SUM_GROUP))

        def inside(first: Column) -> Column:
            """Totals in the group before each of its entries, and of the whole group."""
            sums = [zero]
            for k in range(SUM_GROUP):
                sums.append(sums[-1] + F.get(all_, first + k).cast("bigint"))  # null behind the end, where nothing is taken
            return F.array(*sums)

        def placed(groups: Column) -> Column:
            totals = F.transform(groups, lambda g: F.get(g, F.lit(SUM_GROUP)))
            bases = let(totals, lambda ts: by_group(ts, rounds - 1))
            return F.flatten(F.zip_with(groups, F.slice(bases, F.lit(1), F.size(groups)), added))

        def added(group: Column, base: Column) -> Column:
            return F.array(*[F.get(group, F.lit(k)) + base for k in range(SUM_GROUP)])

        return let(F.transform(firsts, inside), placed)

    def sums(all_: Column) -> Column:
        whole = F.aggregate(all_, zero, lambda a, x: a + x.cast("bigint"))
        return F.concat(F.slice(by_group(all_, SUM_ROUNDS), F.lit(1), F.size(all_)), F.array(whole))

    return let(values, sums)


def zero_ranges(values: Column, ranges: Column) -> Column:
    """The values with zeros in index ranges ``array<struct<start, end>>``, which are in order and disjoint."""

    def cleared(vs: Column, rs: Column) -> Column:
        n = F.size(vs)

        def part(r: Column, i: Column) -> Column:
            done = F.least(F.coalesce(F.when(i > 0, F.get(rs, i - 1)["end"]), F.lit(0)), n)
            lo = F.least(F.greatest(r["start"], done), n)
            hi = F.least(F.greatest(r["end"], lo), n)
            return F.concat(F.slice(vs, done + 1, lo - done), zeros(hi - lo))

        end = F.least(F.greatest(F.element_at(rs, -1)["end"], F.element_at(rs, -1)["start"]), n)
        return F.concat(F.flatten(F.transform(rs, part)), F.slice(vs, end + 1, n - end))

    return let(values, lambda vs: let(ranges, lambda rs: F.when(F.size(rs) > 0, cleared(vs, rs)).otherwise(vs)))


def zeros(n: Column) -> Column:
    return F.array_repeat(F.lit(0), F.greatest(n, F.lit(0)).cast("int"))


def ones(n: Column) -> Column:
    return F.array_repeat(F.lit(1), F.greatest(n, F.lit(0)).cast("int"))


def attention_mask(ids: Column) -> Column:
    """Ones for every token."""
    return ones(F.size(ids))


def truncate(values: Column, max_length: int) -> Column:
    return F.slice(values, 1, max_length)


def trim_mask(mask: Column, max_length: int) -> Column:
    """Loss mask cut to ``max_length`` whose last position is never supervised."""
    cut = truncate(mask, max_length)
    n = F.size(cut)
    return F.when(n > 0, F.concat(F.slice(cut, F.lit(1), n - 1), zeros(F.lit(1)))).otherwise(cut)


def supervised(mask: Column) -> Column:
    """Number of supervised positions."""
    return F.aggregate(mask, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def shift_left(values: Column, by: int = 1) -> Column:
    """Drop the first ``by`` entries and zero-fill the end."""
    n = F.size(values)
    kept = F.greatest(n - by, F.lit(0))
    return F.concat(F.slice(values, F.lit(by + 1), kept), zeros(n - kept))


def shift_right(values: Column, by: int = 1) -> Column:
    """Drop the last ``by`` entries and zero-fill the front."""
    n = F.size(values)
    kept = F.greatest(n - by, F.lit(0))
    return F.concat(zeros(n - kept), F.slice(values, F.lit(1), kept))


def pad_right(values: Column, length: Column) -> Column:
    """Zero-pad to ``length``; longer arrays are left alone."""
    return F.concat(values, zeros(length - F.size(values)))


def round_up(n: Column, multiple: int) -> Column:
    return (F.ceil(n / F.lit(multiple)) * multiple).cast("int")


def has_nan(values: Column) -> Column:
    """Whether an entry is NaN or null; a NaN that comes from pandas is null."""
    return F.coalesce(F.exists(values, lambda x: x.isNull() | F.isnan(x)), F.lit(False))
