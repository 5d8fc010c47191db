"""Corpus statistics and training metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.functions.arrays import let
from chatprep.functions.text import word_count

EPS = 1e-6


# --- context length ------------------------------------------------------------------


def context_length(conversation: Column) -> Column:
    """White-space words over all messages; other content counts 0."""
    return F.aggregate(
        conversation,
        F.lit(0).cast("bigint"),
        lambda acc, m: acc + F.coalesce(word_count(m["content"]), F.lit(0)),
    )


def context_length_long(turns: DataFrame, key: str = "conv_id", text: str = "text") -> DataFrame:
    """Words per conversation of a message table."""
    return turns.groupBy(key).agg(F.sum(F.coalesce(word_count(F.col(text)), F.lit(0))).alias("context_length"))


def context_report(df: DataFrame, length: str = "context_length", status: str = "status") -> DataFrame:
    """Count, shortest, longest and mean over successes, and the error count."""
    ok = F.col(status) == "success"
    value = F.when(ok, F.col(length))
    return df.agg(
        F.count(value).alias("successes"),
        F.min(value).cast("bigint").alias("shortest"),
        F.max(value).cast("bigint").alias("longest"),
        F.avg(value).alias("average"),
        F.coalesce(F.sum((~ok).cast("bigint")), F.lit(0)).alias("errors"),
        F.count("*").alias("processed"),
    )


# --- accuracy and loss per position ------------------------------------------------------


def position_accuracy(df: DataFrame, by: Sequence[str], correct: Column, position_mask: Column, loss_mask: Column) -> DataFrame:
    """Correct trainable positions over supervised positions, per group."""
    hits = F.sum(correct.cast("bigint") * position_mask)
    return df.groupBy(*by).agg(
        (hits / F.greatest(F.sum(loss_mask), F.lit(EPS))).cast("double").alias("accuracy")
    )


def block_accuracy(df: DataFrame, by: Sequence[str], correct: Column, weight: Column) -> DataFrame:
    """Correct labels over evaluated labels (the anchor has weight 0)."""
    hit = F.sum((correct & (weight > 0.5)).cast("bigint"))
    return df.groupBy(*by).agg((hit / (F.sum(weight) + F.lit(EPS))).cast("double").alias("accuracy"))


def block_loss(df: DataFrame, by: Sequence[str], loss: Column, weight: Column) -> DataFrame:
    """Weighted mean of per-token losses."""
    return df.groupBy(*by).agg(
        (F.sum(loss * weight) / (F.sum(weight) + F.lit(EPS))).cast("double").alias("loss")
    )


def log_softmax(logits: Column) -> Column:
    """Row-local, stabilised by the maximum."""

    def shifted(xs: Column, top: Column) -> Column:
        total = F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - top))
        return let(F.log(total), lambda t: F.transform(xs, lambda x: x.cast("double") - top - t))

    return let(logits, lambda xs: let(F.array_max(xs).cast("double"), lambda top: shifted(xs, top)))


def softmax(logits: Column) -> Column:
    return F.transform(log_softmax(logits), F.exp)


def soft_target_loss(logits: Column, target: Column, position_mask: Column) -> Column:
    """Cross entropy of one position against soft targets; 0 when masked out."""
    products = F.zip_with(target, log_softmax(logits), lambda p, q: p * q)
    total = F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
    return -total * position_mask


def position_loss(df: DataFrame, logits: str, target: str, position_mask: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean soft-target loss over all positions, masked ones included as 0."""
    value = soft_target_loss(F.col(logits), F.col(target), F.col(position_mask))
    return df.groupBy(*by).agg(F.avg(value).alias("loss"))


def weighted_total(df: DataFrame, by: Sequence[str], position: str, loss: str, accumulation: int = 1) -> DataFrame:
    """Sum over positions of ``0.8 ** position * loss``, per accumulation step."""
    value = F.sum(F.pow(F.lit(0.8), F.col(position)) * F.col(loss)) / accumulation
    return df.groupBy(*by).agg(value.alias("total_loss"))


def mean_over(df: DataFrame, by: Sequence[str], *metrics: str) -> DataFrame:
    """Plain mean per group: over ranks, or over positions of a step."""
    return df.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])


def mean_of_batches(df: DataFrame, by: Sequence[str], batch: str, metric: str) -> DataFrame:
    """Mean of batch means: every minibatch weighs the same."""
    inner = df.groupBy(*by, batch).agg(F.avg(metric).alias(metric))
    return inner.groupBy(*by).agg(F.avg(metric).alias(metric))


def every(df: DataFrame, step: str, interval: int, accumulation: int = 1) -> DataFrame:
    """Steps that are logged: every ``interval * accumulation``."""
    return df.filter(F.col(step) % (interval * accumulation) == 0)
