"""The reduced draft vocabulary: frequencies, top-N, coverage and both mappings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def supervised_tokens(df: DataFrame, ids: str = "input_ids", mask: str = "loss_mask") -> DataFrame:
    """One row per supervised token."""
    pairs = F.zip_with(ids, mask, lambda t, m: F.when(m == 1, t))
    return df.select(F.explode(F.filter(pairs, lambda t: t.isNotNull())).alias("token"))


def frequency(tokens: DataFrame, token: str = "token") -> DataFrame:
    """Count per token; frequent tokens are combined before the shuffle."""
    return tokens.groupBy(token).agg(F.count("*").alias("n"))


def pad_frequency(freq: DataFrame, draft_size: int, token: str = "token") -> DataFrame:
    """Add the smallest unused ids below ``draft_size`` with count 0 until there are
    ``draft_size`` tokens.  Nothing is added when there are enough."""
    spark = freq.sparkSession
    have = freq.agg(F.count("*")).scalar()
    ids = spark.range(draft_size).select(F.col("id").cast(freq.schema[token].dataType).alias(token))
    missing = ids.join(freq.filter(F.col(token) < draft_size), token, "left_anti")
    # At most draft_size rows: a window without partitions is bounded here.
    numbered = missing.withColumn("__i", F.row_number().over(Window.orderBy(token)))
    extra = numbered.filter(F.col("__i") <= F.lit(draft_size) - have).select(token, F.lit(0).cast("bigint").alias("n"))
    return freq.select(token, "n").unionByName(extra)


def top_tokens(freq: DataFrame, draft_size: int, token: str = "token") -> DataFrame:
    """The ``draft_size`` most frequent tokens; ties go to the smaller token."""
    return freq.orderBy(F.desc("n"), F.asc(token)).limit(draft_size)


def coverage(freq: DataFrame, draft_size: int, token: str = "token") -> DataFrame:
    """Share of supervised tokens that the draft vocabulary covers; 0 when there are none.

    The covered mass depends on the counts alone, so the frequencies are read once and
    reduced to "how many tokens occur n times".  That table has at most
    ``sqrt(2 * total)`` rows, which is what the unpartitioned window sees.
    """
    counts = freq.groupBy("n").agg(F.count(token).alias("tokens"))
    above = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    room = F.lit(draft_size) - F.coalesce(F.sum("tokens").over(above), F.lit(0))
    used = counts.withColumn("used", F.greatest(F.least(F.col("tokens"), room), F.lit(0)))

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    sums = used.agg(
        total(F.col("used")).alias("draft_tokens"),
        total(F.col("tokens")).alias("distinct_tokens"),
        total(F.col("used") * F.col("n")).alias("covered"),
        total(F.col("tokens") * F.col("n")).alias("total"),
    )
    share = F.try_divide(F.col("covered").cast("double"), F.col("total").cast("double"))
    return sums.withColumn("coverage", F.coalesce(share, F.lit(0.0)))


def draft_to_target(top: DataFrame, token: str = "token_id") -> DataFrame:
    """``(draft_id, token_id, d2t_offset)``; draft ids follow the token order.

    ``top`` holds at most the draft size, so the window is bounded.
    """
    draft = F.row_number().over(Window.orderBy(token)) - 1
    return top.select(
        draft.alias("draft_id"),
        F.col(token).alias("token_id"),
    ).withColumn("d2t_offset", F.col("token_id") - F.col("draft_id"))


BITMAP_BITS = 32768  # ids of one bitmap of the engine


def draft_words(top: DataFrame, token: str = "token_id") -> Column:
    """The draft set as a literal of 64-bit words, from the engine's bitmap aggregate.

    Its size follows from the target vocabulary: 4 KB for 32768 ids.
    """
    after = F.col(token).cast("bigint") + 1  # the bitmap functions count from one
    maps = top.groupBy(F.bitmap_bucket_number(after).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(after)).alias("bits"))
    found = {r.bucket: bytes(r.bits) for r in maps.collect()}
    raw = b"".join(found.get(i, bytes(BITMAP_BITS // 8)) for i in range(1, max(found, default=0) + 1))
    return F.lit(np.frombuffer(raw, "<i8")) if raw else F.array().cast("array<bigint>")


def in_draft(ids: Column, words: Column) -> Column:
    """Whether an id is in the set of ``draft_words``."""
    word = F.get(words, F.shiftright(ids, 6).cast("int"))
    bit = F.getbit(word, F.pmod(ids, F.lit(64)).cast("int"))
    return F.coalesce(bit == 1, F.lit(False))


def target_to_draft(spark: SparkSession, top: DataFrame, target_size: int, token: str = "token_id") -> DataFrame:
    """``(token_id, in_draft)`` for every id of the target vocabulary."""
    ids = spark.range(target_size).select(F.col("id").alias("token_id"))
    return ids.withColumn("in_draft", in_draft(F.col("token_id"), draft_words(top, token)))


def position_mask(df: DataFrame, words: Column, token: str = "token_id", mask: str = "loss_mask") -> DataFrame:
    """Trainable positions: supervised and predicted token is in the draft vocabulary.

    Long form, one row per position; ``words`` is the set of ``draft_words``.
    """
    return df.withColumn("position_mask", F.when(in_draft(F.col(token), words), F.col(mask)).otherwise(0).cast("int"))


def position_masks(ids: Column, mask: Column, words: Column) -> Column:
    """The same for whole samples: arrays of ids and of their 0/1 mask."""
    return F.zip_with(ids, mask, lambda i, m: F.when(in_draft(i, words), m).otherwise(0).cast("int"))


def kept_share(masked: DataFrame, mask: str = "loss_mask") -> DataFrame:
    return masked.agg(
        F.sum(mask).cast("bigint").alias("supervised"),
        F.sum("position_mask").cast("bigint").alias("trainable"),
        F.coalesce(F.try_divide(F.sum("position_mask"), F.sum(mask)), F.lit(0.0)).cast("double").alias("share"),
    )


def learn_vocabulary(freq: DataFrame, size: int, token: str = "token") -> DataFrame:
    """``(token, token_id)``: id 0.. by count, then token; at most ``size`` rows."""
    best = top_tokens(freq, size, token)
    order = Window.orderBy(F.desc("n"), F.asc(token))
    return best.select(token, (F.row_number().over(order) - 1).cast("int").alias("token_id"), "n")


