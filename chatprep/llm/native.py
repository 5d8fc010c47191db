"""Column helpers for the operators that use DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHUNK = 256


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def running_sums(numbers: Column) -> Column:
    """Running sums of an array of integers, in chunks so that long arrays stay cheap."""

    def within(part: Column, base: Column) -> Column:
        start = F.struct(base.cast("long").alias("sum"), F.array().cast("array<bigint>").alias("all"))

        def add(total: Column, x: Column) -> Column:
            now = (total["sum"] + x).cast("long")
            return F.struct(now.alias("sum"), F.concat(total["all"], F.array(now)).alias("all"))

        return F.aggregate(part, start, add)["all"]

    def chunk(i: Column) -> Column:
        return F.slice(numbers, i * CHUNK + 1, CHUNK)

    count = F.ceil(F.size(numbers) / CHUNK).cast("int")
    index = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    totals = F.transform(index, lambda i: F.aggregate(chunk(i), F.lit(0).cast("long"), lambda a, x: a + x))
    bases = F.concat(F.array(F.lit(0).cast("long")), within(totals, F.lit(0)))
    return F.flatten(F.zip_with(index, F.slice(bases, 1, F.greatest(count, F.lit(1))), lambda i, b: within(chunk(i), b)))
