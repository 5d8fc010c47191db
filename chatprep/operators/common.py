"""Helpers for plans with costly row-local expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Add (or replace) columns that are computed exactly once per row.

    A plain projection may be merged into its consumers, and a filter on its result
    is pushed below it, so that a costly expression runs again for every use.
    Generated columns are neither merged nor pushed through.
    """
    kept = [c for c in df.columns if c not in columns]
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(made)))
