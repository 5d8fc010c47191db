"""Masks of long token tables: tokens move in packs, not as rows.

Consecutive tokens of a key and a block of positions become one pack of differences, some bytes
instead of a row each.  Spans go to every block whose tokens they can meet, so that packs and spans
of a block meet in one shuffle, and a block's tokens are sought among its spans by halving.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

BITS = 13  # a block has 2 ** 13 positions
LEVELS = (13, 19, 25, 31, 62)  # blocks of tokens that are longer than that, for overlaps
FAR = 1 << 62
ROWS = 1 << 18  # tokens sent back at once
_KINDS = [np.dtype(x) for x in ("<i1", "<i2", "<i4", "<i8")]


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers in as few bytes each as they all fit in."""
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    kind = next(k for k, x in enumerate(_KINDS) if np.iinfo(x).min <= low and high <= np.iinfo(x).max)
    return bytes([kind]) + values.astype(_KINDS[kind]).tobytes()


def pack(i: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """Steps of ``i``, gaps between tokens and lengths, of which most are small."""
    before = np.concatenate([np.zeros(1, np.int64), end[:-1]])
    parts = [_squeezed(x) for x in (np.diff(i, prepend=0), start - before, end - start)]
    return len(i).to_bytes(4, "little") + b"".join(parts)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, at, parts = int.from_bytes(packed[:4], "little"), 4, []
    for _ in range(3):
        kind = _KINDS[packed[at]]
        parts.append(np.frombuffer(packed, kind, n, at + 1).astype(np.int64))
        at += 1 + n * kind.itemsize
    steps, gaps, lengths = parts
    end = np.cumsum(gaps + lengths)
    return np.cumsum(steps), end - lengths, end


def _differs(column: pa.Array) -> np.ndarray:
    """Where an entry is another than the one before (nulls are equal)."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    unequal = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return unequal | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))


def _packer(groups: int):
    """Arrow batches of ``groups`` group columns, i, start and end to one row per run of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last run goes on in the next batch
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
            if not table.num_rows:
                continue
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns[:groups]]
            new = np.logical_or.reduce([_differs(c) for c in columns])
            firsts = np.concatenate([[0], np.flatnonzero(new) + 1])
            held = table.slice(int(firsts[-1]))
            if len(firsts) > 1:
                yield packed(table.slice(0, int(firsts[-1])), firsts)
        if held is not None and held.num_rows:
            yield packed(held, np.array([0, held.num_rows]))

    def packed(table: pa.Table, borders: np.ndarray) -> pa.RecordBatch:
        i, start, end = (c.to_numpy() for c in table.columns[groups:])
        packs = [pack(i[a:b], start[a:b], end[a:b]) for a, b in zip(borders[:-1], borders[1:])]
        firsts = table.take(pa.array(borders[:-1])).combine_chunks()
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in firsts.columns[:groups]]
        return pa.RecordBatch.from_arrays([*columns, pa.array(packs, pa.binary())], names=[*table.column_names[:groups], "__pack"])

    return run


def _hits(how: str, packs: list[bytes], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block's tokens, equal ones once, and whether each meets a span."""
    parts = [unpack(p) for p in packs]
    i, a, b = (np.concatenate(x) for x in zip(*parts))
    at = b if how == "overlap" else a
    if not (np.diff(i) > 0).all():  # rows that stand twice
        order = np.lexsort((i, at))
        fresh = np.concatenate([[True], (np.diff(i[order]) != 0) | (np.diff(at[order]) != 0)])
        i, a, b = (x[order][fresh] for x in (i, a, b))
    order = np.lexsort((ends, starts))
    starts, ends = starts[order], np.concatenate([ends[order], [-FAR - 1]])  # no span in time: the last entry
    found = np.searchsorted(starts, b - 1 if how == "overlap" else a, "right") - 1
    close = ends[found]
    return i, {"prefix": a < close, "containment": b <= close, "overlap": a <= close}[how] & (found >= 0)


def _sweeper(how: str, keys: int, number: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, places, masks, size = [], [], [], 0
            for row in range(batch.num_rows):
                packs, starts, ends = (batch.column(keys + k)[row].values for k in range(3))
                i, hit = _hits(how, packs.to_pylist(), starts.to_numpy(zero_copy_only=False), ends.to_numpy(zero_copy_only=False))
                groups.append(np.full(len(i), row))
                places.append(i)
                masks.append(hit)
                size += len(i)
                if size >= ROWS or row == batch.num_rows - 1:
                    own = pa.array(np.concatenate(groups))
                    columns = [batch.column(k).take(own) for k in range(keys)]
                    columns += [pa.array(np.concatenate(places)).cast(number), pa.array(np.concatenate(masks).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:keys], "i", "mask"])
                    groups, places, masks, size = [], [], [], 0

    return run


def masked_rows(token_rows: DataFrame, span_rows: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """``keys, i, mask`` of all token rows (``keys, i, start, end``); see ``spans.offset_mask_rows``."""
    if how not in ("prefix", "containment", "overlap"):
        raise ValueError(f"unknown mapping {how!r}")
    late, keys = how == "overlap", list(keys)

    def long(name: str, lost: int) -> Column:
        return F.coalesce(F.col(name).cast("bigint"), F.lit(lost).cast("bigint"))

    # A token without an offset meets no span.
    tokens = token_rows.filter("i IS NOT NULL").select(
        *keys, F.col("i").cast("bigint").alias("i"), long("start", FAR if late else -FAR).alias("start"), long("end", -FAR if late else FAR).alias("end")
    )
    # A token is no longer than its block, so that it ends in it or in the next one.
    level = F.lit(0)
    for k in range(1, len(LEVELS) if late else 1):
        level = F.when(F.col("end") - F.col("start") > F.lit(1 << LEVELS[k - 1]), k).otherwise(level)
    bits = F.get(F.array(*[F.lit(x) for x in LEVELS]), level) if late else F.lit(BITS)
    tokens = tokens.withColumns({"__level": level.cast("int"), "__block": F.call_function("shiftright", F.col("start"), bits)})
    kinds = {f.name: f for f in token_rows.schema.fields}
    group = [*[StructField(k, kinds[k].dataType) for k in keys], StructField("__level", IntegerType()), StructField("__block", LongType())]
    ordered = tokens.select(*keys, "__level", "__block", "i", "start", "end")
    packs = ordered.mapInArrow(_packer(len(group)), StructType([*group, StructField("__pack", BinaryType())]))

    reach = span_rows.filter("start IS NOT NULL AND end IS NOT NULL").select(*keys, F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))

    def blocks(k: int, size: int) -> Column:
        first = F.shiftright("start", size) - (1 if late else 0)
        numbers = F.sequence(first, F.greatest(F.shiftright("end", size), first))
        return F.transform(numbers, lambda b: F.struct(F.lit(k).alias("__level"), b.alias("__block")))

    ways = [blocks(k, size) for k, size in enumerate(LEVELS if late else LEVELS[:1])]
    reach = reach.select(*keys, F.inline(F.concat(*ways)), F.lit(None).cast("binary").alias("__pack"), "start", "end")
    rows = packs.withColumns({"start": F.lit(None).cast("bigint"), "end": F.lit(None).cast("bigint")}).unionByName(reach)
    spans = F.collect_list(F.when(F.col("__pack").isNull(), F.struct("start", "end")))
    met = rows.groupBy(*keys, "__level", "__block").agg(F.collect_list("__pack").alias("__packs"), spans.alias("__spans")).filter(F.size("__packs") > 0)
    met = met.select(*keys, "__packs", F.col("__spans.start").alias("__starts"), F.col("__spans.end").alias("__ends"))
    out = StructType([*[StructField(k, kinds[k].dataType) for k in keys], StructField("i", kinds["i"].dataType), StructField("mask", IntegerType())])
    return met.mapInArrow(_sweeper(how, len(keys), to_arrow_type(kinds["i"].dataType)), out)
