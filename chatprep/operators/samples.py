"""Training samples from token ids and masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatprep.functions.arrays import (
    let,
    ones,
    pad_right,
    round_up,
    shift_left,
    supervised,
    trim_mask,
    truncate,
    zeros,
)
from chatprep.operators.common import pin

IDS, MASK = "input_ids", "loss_mask"


def offline_trim(df: DataFrame, max_length: int, ids: str = IDS, mask: str = MASK) -> DataFrame:
    """Cut to ``max_length``; the last position is never supervised."""
    return df.withColumns(
        {
            ids: truncate(F.col(ids), max_length),
            mask: trim_mask(F.col(mask), max_length),
            "attention_mask": ones(F.least(F.size(ids), F.lit(max_length))),
        }
    )


def enough_supervision(df: DataFrame, block_size: int, mask: str = MASK) -> DataFrame:
    """Keep samples with at least two blocks of supervised tokens."""
    return df.filter(supervised(F.col(mask)) >= 2 * block_size)


def supervision_report(df: DataFrame, block_size: int, mask: str = MASK) -> DataFrame:
    """Rows before and after the filter, in one pass."""
    keep = supervised(F.col(mask)) >= 2 * block_size
    return df.agg(
        F.count("*").alias("rows_before"),
        F.coalesce(F.sum(keep.cast("bigint")), F.lit(0)).alias("rows_after"),
    )


def step_views(df: DataFrame, steps: int = 7, ids: str = IDS, mask: str = MASK) -> DataFrame:
    """One row per unroll step: inputs are ``step + 1`` ahead, targets ``step + 2``,
    masks ``step``; the end is zero-filled.  Arrays stay arrays."""
    out = df.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    i = F.col("step")

    def ahead(col: str, by: Column) -> Column:
        n = F.size(col)
        kept = F.greatest(n - by, F.lit(0))
        return F.concat(F.slice(F.col(col), by + 1, kept), zeros(n - kept))

    return out.withColumns(
        {"step_input": ahead(ids, i + 1), "step_target": ahead(ids, i + 2), "step_mask": ahead(mask, i)}
    )


def sequence_shards(
    df: DataFrame,
    shards: int,
    overlap: int,
    max_length: int,
    ring: int = 1,
    ids: str = IDS,
    mask: str = MASK,
) -> DataFrame:
    """Cut every sample into ``shards`` overlapping pieces, zero-padded to one size.

    ``chunk = ceil(min(len, max) / shards)``; a piece is ``chunk + overlap`` long.
    Position ids are the contiguous range of the piece's ring group.
    """
    ulysses = max(1, shards // ring)
    cut = df.withColumns(
        {"__ids": truncate(F.col(ids), max_length), "__mask": trim_mask(F.col(mask), max_length)}
    )
    out = cut.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    n = F.size("__ids")
    chunk = F.ceil(n / shards).cast("int")
    out = out.withColumns({"chunk": chunk, "__local": chunk + overlap, "__from": F.col("shard") * chunk})
    local, start = F.col("__local"), F.col("__from")
    valid = F.greatest(F.least(start + local, n) - start, F.lit(0))

    def piece(col: str) -> Column:
        return pad_right(F.slice(F.col(col), start + 1, valid), local)

    group = F.floor(F.col("shard") / ulysses)
    first = (group * F.col("chunk") * ulysses).cast("int")
    width = F.col("chunk") * ulysses
    return out.withColumns(
        {
            "shard_ids": piece("__ids"),
            "shard_mask": piece("__mask"),
            "shard_attention": F.concat(ones(valid), zeros(local - valid)),
            "position_ids": F.when(width > 0, F.sequence(first, first + width - 1)).otherwise(
                F.array().cast("array<int>")
            ),
        }
    ).drop("__ids", "__mask", "__local", "__from")


def pad_batches(
    df: DataFrame,
    batch: Sequence[str],
    columns: Sequence[str],
    multiple: int = 1,
    position_ids: str | None = None,
    ulysses: int = 1,
) -> DataFrame:
    """Right-pad every array to its batch's longest, rounded up to ``multiple``.

    A batch is as small as the caller's batch size, so it is a bounded window: one
    shuffle by batch, and the arrays are computed once.
    """
    batch = list(batch)
    longest = F.max(F.size(columns[0])).over(Window.partitionBy(*batch))
    sized = df.withColumn("__max", longest)
    width = round_up(F.col("__max"), multiple)
    padded = sized.withColumns(
        {c: pad_right(F.col(c), width) for c in columns} | {"padded_length": width}
    )
    if position_ids:
        padded = padded.withColumn(position_ids, pad_right(F.col(position_ids), width * ulysses))
    return padded.drop("__max")


# --- block training -----------------------------------------------------------------


def anchors(df: DataFrame, key: str, block_size: int, num_anchors: int, seed: int | str = 42, mask: str = MASK) -> DataFrame:
    """Up to ``min(num_anchors, valid - 1)`` random supervised positions per sample.

    A valid position leaves room for a block.  The draw sorts a position's seeded
    hash inside the row: samples are bounded by their own length, nothing shuffles.
    """

    def draw(valid: Column, lead: Column) -> Column:
        # Hash and position as one text, which sorts faster than a struct; hashes have 32 digits.
        drawn = F.sort_array(F.transform(valid, lambda p: F.concat(F.md5(F.concat(lead, p.cast("string"))), p.cast("string"))))
        count = F.greatest(F.least(F.lit(num_anchors), F.size(valid) - 1), F.lit(0))
        return F.sort_array(F.transform(F.slice(drawn, F.lit(1), count), lambda x: F.substring(x, 33, 10).cast("int")))

    def positions(m: Column) -> Column:
        last = F.least(F.greatest(F.size(m) - block_size, F.lit(0)), F.size(m) - 1)
        return F.filter(F.sequence(F.lit(0), last), lambda p: F.get(m, p) == 1)

    lead = F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.lit(""))  # as in seeded_key
    picked = let(
        F.col(mask), lambda m: let(lead, lambda head: let(positions(m), lambda valid: draw(valid, head)))
    )
    empty = F.array().cast("array<int>")
    return pin(df, anchors=F.when(F.size(mask) > 0, picked).otherwise(empty))


def require_anchors(df: DataFrame, column: str = "anchors") -> DataFrame:
    """Fail when a sample has too few supervised positions for a single block."""
    check = F.when(
        F.size(column) > 0, F.lit(True)
    ).otherwise(F.raise_error(F.lit("too few supervised positions for a block")).cast("boolean"))
    return df.filter(check)


def decay(k: Column, gamma: float | None) -> Column:
    """Loss weight by position in the block: 1 for the first prediction."""
    if not gamma or gamma <= 0:
        return F.lit(1.0)
    return F.exp(-F.greatest(k - 1, F.lit(0)) / F.lit(float(gamma)))


def blocks(
    df: DataFrame,
    key: str,
    block_size: int,
    gamma: float | None = None,
    ids: str = IDS,
    mask: str = MASK,
    anchor_column: str = "anchors",
) -> DataFrame:
    """One row per (sample, block, k): the label and its weight.

    A label beyond the end is invalid (weight 0); k = 0 is the anchor itself.  Only the
    small entries are made into rows, the sample's arrays are not copied into them.
    """
    size = F.size(ids)

    def entry(block: Column, anchor: Column, k: Column) -> Column:
        at = anchor + k
        inside = at < size
        return F.struct(
            block.alias("block"),
            anchor.alias("anchor"),
            k.alias("k"),
            F.get(F.col(ids), F.least(at, size - 1)).alias("label_id"),
            inside.alias("valid"),
            F.when(inside & (k > 0), F.get(F.col(mask), at)).otherwise(0).cast("int").alias("eval_weight"),
        )

    def block_entries(anchor: Column, block: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(block_size - 1)), lambda k: entry(block, anchor, k))

    out = df.select(key, F.inline(F.flatten(F.transform(anchor_column, block_entries))))
    return out.withColumn("loss_weight", (F.col("eval_weight") * decay(F.col("k"), gamma)).cast("double"))


def noise_input(ids: Column, block_size: int, mask_id: int) -> Column:
    """Only the first token of each block is real."""
    return F.transform(ids, lambda x, i: F.when(i % block_size == 0, x).otherwise(mask_id))


def noise_input_by_block(ids: Column, block_ids: Column, mask_id: int) -> Column:
    """Same, where a block starts whenever the block id changes."""
    return let(
        block_ids,
        lambda b: F.transform(
            ids,
            lambda x, i: F.when((i == 0) | (F.get(b, i) != F.get(b, i - 1)), x).otherwise(mask_id),
        ),
    )


__all__ = [
    "anchors",
    "blocks",
    "decay",
    "enough_supervision",
    "noise_input",
    "noise_input_by_block",
    "offline_trim",
    "pad_batches",
    "require_anchors",
    "sequence_shards",
    "shift_left",
    "step_views",
    "supervision_report",
]
