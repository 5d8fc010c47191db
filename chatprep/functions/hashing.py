"""Seeded, engine-independent randomness: every draw is an md5 of a stable key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(seed: int | str, *parts: Column) -> Column:
    """32 hex digits that depend on the seed and the given columns only."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hex_number(hex_text: Column, digits: int = 7) -> Column:
    """The leading hex digits as a number (7 digits: 28 bits)."""
    return F.conv(F.substring(hex_text, 1, digits), 16, 10).cast("bigint")


def seeded_bucket(seed: int | str, buckets: int, *parts: Column) -> Column:
    """A bucket in ``[0, buckets)``, reproducible on every engine."""
    return hex_number(seeded_key(seed, *parts)) % F.lit(buckets)


def content_id(*parts: Column) -> Column:
    """Record id: md5 of the concatenated texts."""
    return F.md5(F.concat(*parts))
