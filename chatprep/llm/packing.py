"""Best-fit packing of token pieces into sequences, planned on the histogram of lengths.

1. ``pieces`` tokenises whole texts, adds the end id and cuts what is longer than a sequence.
2. ``plan`` takes the histogram (at most ``capacity`` rows) and enumerates patterns of two to
   four lengths that fill a sequence.  Non-negative least squares fits how often each pattern
   repeats; the counts are rounded down to what is there, and what is left over is packed best-fit
   decreasing, also by counts, into new sequences and the last gaps of the patterns.
3. ``assign`` ranks the pieces of each length and looks their place up in the plan.  The plan is
   a list of runs whose number depends on ``capacity`` alone, so it can be broadcast.

Nulls: a null text is an empty document (its end id alone), a null doc_id is kept.  Ties in
length go by doc_id and piece; repeated rows are documents of their own.  An empty table gives no
rows.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatprep.llm.common import configure, documents, groups, lists, store
from chatprep.llm.wordids import WordIds

ROWS_PER_BUCKET = 1_000_000  # of the buckets in which pieces of one length are ranked
BUCKETS = 64  # at least
GRID = 8  # lengths tried as second and third partner
ROUNDS = 150  # of the least-squares fit
FULL = 0.99  # a pattern must fill so much of a sequence
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """Pieces of at most ``capacity`` ids; with their ids where ``keep_ids`` is set."""
    configure(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordIds.of(tokenizer)
        for batch in batches:
            for low, high, data, borders in groups(batch.column("text")):
                ids, ends = ids_of.encode(data, borders, end_id)
                sizes = np.diff(ends)
                parts = -(-sizes // capacity)
                of = np.repeat(np.arange(high - low), parts)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(sizes[of] - start, capacity)
                begin = ends[of] + start
                raw = ids.astype("<u4")
                sums = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                columns = {
                    "doc_id": batch.column("doc_id")[low:high].take(pa.array(of)),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(sums, pa.int64()),
                }
                if keep_ids:
                    columns["ids"] = lists(ids.astype(np.int64), np.append(begin, len(ids)), pa.int64())
                yield pa.RecordBatch.from_pydict(columns)

    schema = PIECE_SCHEMA + (", ids array<bigint>" if keep_ids else "")
    return documents(docs, id_col, text_col).mapInArrow(make, schema)


@dataclass
class Plan:
    """Runs of pieces: those of ``length`` with ranks from ``rank`` on go to sequences from ``first``
    on, ``copies`` to each, starting at ``offset``.  Sorted by length and rank."""

    length: np.ndarray
    rank: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    copies: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.searchsorted(self.length << 44 | self.rank, length << 44 | rank, "right") - 1
        i = rank - self.rank[run]
        return self.first[run] + i // self.copies[run], self.offset[run] + i % self.copies[run] * length


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of up to four lengths (as indices, -1 for none) that nearly fill a sequence.

    For each largest length and each choice of partners from a grid of lengths, the last partner
    is the longest that still fits.
    """
    n = len(lengths)
    grid = np.unique(np.linspace(0, n - 1, GRID).round().astype(np.int64))
    a = np.arange(n)
    found = []
    for chosen in [np.full((n, 0), 0), *(np.full((n, 1), g) for g in grid), *(np.full((n, 2), 0) + [g, k] for g in grid for k in grid if g <= k)]:
        left = capacity - lengths[a] - (lengths[chosen].sum(1) if chosen.shape[1] else 0)
        for back in range(2):
            last = np.searchsorted(lengths, left, "right") - 1 - back
            ok = (last >= 0) & (left > 0) & (left - lengths[np.maximum(last, 0)] <= capacity * (1 - FULL))
            rows = np.sort(np.column_stack([a[ok], chosen[ok], last[ok]]), axis=1)[:, ::-1]
            found.append(np.pad(rows, ((0, 0), (0, 4 - rows.shape[1])), constant_values=-1))
    return np.unique(np.concatenate(found), axis=0)


def fit(table: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 with A x near ``counts`` in squares; A counts lengths per pattern.

    Multiplicative steps keep x from becoming negative and need only sparse products.
    """
    held = table >= 0
    row, col = np.nonzero(held)[0], table[held]
    target = counts.astype(float)

    def gather(y: np.ndarray) -> np.ndarray:
        return np.bincount(row, y[col], len(table))

    x = gather(target) / np.maximum(gather(np.bincount(col, minlength=len(counts)).astype(float)), 1)
    wanted = gather(target)
    for _ in range(ROUNDS):
        x *= wanted / np.maximum(gather(np.bincount(col, x[row], len(counts))), 1e-9)
    return x


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Places for all pieces of a histogram ``length: count``."""
    lengths = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    taken = np.zeros(len(lengths), np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    spaces: list[int] = []  # sorted free sizes, each with a list of runs of alike sequences
    open_: dict[int, list[tuple[int, int]]] = {}
    used = 0

    def put(i: int, n: int, first: int, offset: int, copies: int) -> None:
        runs.append((int(lengths[i]), int(taken[i]), first, offset, copies))
        taken[i] += n
        left[i] -= n

    def leave(first: int, n: int, space: int) -> None:
        if n and space:
            if space not in open_:
                insort(spaces, space)
            open_.setdefault(space, []).append((first, n))

    if len(lengths):
        table = patterns(lengths, capacity)
        repeats = np.floor(fit(table, left)).astype(np.int64)
        size = np.where(table >= 0, lengths[table], 0).sum(1)
        for k in np.lexsort((-repeats, capacity - size)).tolist():
            members = [i for i in table[k].tolist() if i >= 0]
            n = min([int(repeats[k]), *(int(left[i]) // members.count(i) for i in set(members))])
            if n > 0:
                offset = 0
                for i in members:
                    put(i, n, used, offset, 1)
                    offset += int(lengths[i])
                leave(used, n, capacity - offset)
                used += n
    for i in range(len(lengths) - 1, -1, -1):
        length = int(lengths[i])
        while (n := int(left[i])) > 0:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, there = open_[space].pop()
                if not open_[space]:
                    del open_[space], spaces[at]
            else:
                space, first, there = capacity, used, -(-n // (capacity // length))
                used += there
            copies = space // length
            whole = min(there, n // copies)
            if whole:
                put(i, whole * copies, first, capacity - space, copies)
                leave(first, whole, space - copies * length)
            rest = int(left[i]) if whole < there and left[i] < copies else 0
            if rest:
                put(i, rest, first + whole, capacity - space, rest)
                leave(first + whole, 1, space - rest * length)
            leave(first + whole + bool(rest), there - whole - bool(rest), space)
    made = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return Plan(*(made[:, c].copy() for c in range(5)), used)


def bucketed(cut: DataFrame, buckets: int) -> DataFrame:
    """Pieces with ``_bucket``; rows that share all columns differ in their place in the stored table."""
    place_of = ("doc_id", "piece", "_metadata.file_name", "_metadata.row_index")
    return cut.withColumn("_bucket", F.pmod(F.xxhash64(*place_of), F.lit(buckets)).cast("int"))


def assign(cut: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces that is stored in files."""
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    made = cut.sparkSession.sparkContext.broadcast(plan(histogram, capacity))
    buckets = max(BUCKETS, sum(histogram.values()) // ROWS_PER_BUCKET)
    parts = bucketed(cut, buckets)
    sizes = parts.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select(
        "length", "_bucket", (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before")
    )
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = parts.withColumn("_rank", F.row_number().over(within)).join(before, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_rank") - 1 + F.col("_before")).select(*cut.columns, "_rank")
    schema = ranked.drop("_rank").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = made.value.place(
                batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64),
                batch.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64),
            )
            kept = [batch.column(c) for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [f.name for f in schema]
            )

    return ranked.mapInArrow(place, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, **columns: str) -> DataFrame:
    """Pack whole documents: one row per piece with its sequence and its place there."""
    return assign(store(pieces(docs, tokenizer, end_id, capacity, **columns), "pieces"), capacity)
