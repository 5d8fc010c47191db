"""Vectors as short codes: product quantisation in whole numbers, with exact limb-split products.

Components become ``floor(256 * x)``; a vector is cut into 16 equal consecutive parts, and each
part is replaced by the number of the nearest entry of the codebook of its place.  Squared
distances need the products of all parts with all entries.  Those are matrix products in float64
(BLAS) of limbs: whole numbers are broken into limbs so short that no sum of products reaches
2^53, every product matrix is therefore exact, and the matrices are shifted and added in int64.
The nearest entry is the first smallest distance, so ties go to the lower index.

The work is four scans: the vectors of the smallest ids, two rounds of sums per entry, and the
codes.  A task keeps one table of sums, whatever it reads; Spark adds the tables up, and the
driver sees one number per component of the codebooks, never a vector beyond their first entries.

Nulls: a null vector, or one with a null, NaN or infinite component, is dropped.  A vector
without an id is coded like any other, and names an entry only when fewer than 64 ids are there
(the missing id counts as one more, the last).  Null labels form one group.  An id that stands
more than once names one entry, with its smallest vector (compared component by component); each
of its rows is coded.  Vectors of different lengths have codebooks of their own, at most
``MAX_LENGTHS`` of them; empty vectors have code 0 everywhere and error 0.  A length that 16 does
not divide, and a component so large that distances would leave 64 bits, end the job with an
error that says so.  A table without vectors gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatprep.llm.common import configure, store

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
MAX_LENGTHS = 16

Books = dict[int, np.ndarray]  # vector length: entries by part, entry, position


# --- exact products --------------------------------------------------------------------------


def limb_bits(width: int) -> int:
    """Bits of a limb for which ``width`` products of two limbs stay below 2^53."""
    return (53 - max(width, 1).bit_length()) // 2


def limbs(numbers: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float matrices whose sum, the i-th times ``2 ** (bits * i)``, is ``numbers``.

    All but the last are in [0, 2^bits), the last is in [-2^bits, 2^bits).
    """
    out = []
    while numbers.size and (numbers.max() >= 1 << bits or numbers.min() < -(1 << bits)):
        out.append((numbers & ((1 << bits) - 1)).astype(np.float64))
        numbers = numbers >> bits
    return [*out, numbers.astype(np.float64)]


def products(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """``x @ entries.T`` of int64 matrices, exact wherever the result fits 64 bits."""
    bits = limb_bits(x.shape[1])
    total = np.zeros((len(x), len(entries)), np.int64)
    right = [b.T for b in limbs(entries, bits)]
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(right):
            total += (a @ b).astype(np.int64) << (bits * (i + j))
    return total


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the first nearest entry, and the squared distance to it."""
    apart = (entries * entries).sum(1) - 2 * products(x, entries)
    code = apart.argmin(1)
    return code, apart[np.arange(len(x)), code] + (x * x).sum(1)


# --- vectors in batches ------------------------------------------------------------------------


def matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Whole-number vectors of a batch by length: the length, the row numbers, the int64 matrix."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = column.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - sizes])
    for length in np.unique(sizes[good]).tolist():
        if length % PARTS:
            raise ValueError(f"a vector of {length} components can't be cut into {PARTS} equal parts")
        rows = np.flatnonzero(good & (sizes == length))
        at = (ends - sizes)[rows][:, None] + np.arange(length)
        scaled = np.floor(SCALE * flat[at]) if length else np.zeros((len(rows), 0))
        largest = math.isqrt((1 << 61) // max(length, 1))
        if scaled.size and np.abs(scaled).max() > largest:
            raise ValueError(f"components beyond {largest // SCALE} have distances of more than 64 bits at {length} components")
        yield length, rows, scaled.astype(np.int64)


def _parts(x: np.ndarray) -> np.ndarray:
    """By part, row, position."""
    return np.ascontiguousarray(x.reshape(len(x), PARTS, x.shape[1] // PARTS).transpose(1, 0, 2))


def _first_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors of a task's smallest ids: one vector per id, ``ENTRIES`` ids per length."""
    held: dict[int, np.ndarray] = {}  # rows (id is missing, id, components), in order
    for batch in batches:
        ids = batch.column("vec_id")
        missing = ids.is_null().to_numpy(zero_copy_only=False)
        number = pc.fill_null(ids, 0).to_numpy()
        for length, rows, x in matrices(batch.column("vector")):
            named = np.column_stack([missing[rows].astype(np.int64), number[rows], x])
            before = held.get(length)
            if before is not None and len(before) == ENTRIES:
                none, last = before[-1, :2].tolist()
                named = named[(named[:, 0] < none) | ((named[:, 0] == none) & (named[:, 1] <= last))]
            if len(named):
                both = named if before is None else np.concatenate([before, named])
                order = np.unique(both, axis=0)
                new = np.ones(len(order), bool)
                new[1:] = (order[1:, :2] != order[:-1, :2]).any(1)
                held[length] = order[new][:ENTRIES]
    for length, rows in held.items():
        yield pa.RecordBatch.from_pydict(
            {
                "length": pa.array(np.full(len(rows), length, np.int32)),
                "missing": pa.array(rows[:, 0] == 1),
                "vec_id": pa.array(rows[:, 1]),
                "vector": pa.array(list(rows[:, 2:]), pa.list_(pa.int64())),
            }
        )


def _sums(books: Books):
    """Counts and component sums of the parts next to each entry, one table per task.

    The table of a length is a row of numbers: for each part and entry the count, then the sums.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for length, _, x in matrices(batch.column("vector")):
                book = books[length]
                _, entries, width = book.shape
                table = held.setdefault(length, np.zeros((PARTS, entries, width + 1), np.int64))
                for part, of in enumerate(_parts(x)):
                    code, _ = nearest(of, book[part])
                    table[part, :, 0] += np.bincount(code, minlength=entries)
                    order = np.argsort(code, kind="stable")
                    found, begin = np.unique(code[order], return_index=True)
                    if width:
                        table[part, found, 1:] += np.add.reduceat(of[order], begin, axis=0)
        for length, table in held.items():
            slot = np.flatnonzero(table)
            yield pa.RecordBatch.from_pydict(
                {"length": pa.array(np.full(len(slot), length, np.int32)), "slot": pa.array(slot), "total": pa.array(table.ravel()[slot])}
            )

    return make


def _codes(books: Books):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, rows, x in matrices(batch.column("vector")):
                code, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
                for part, of in enumerate(_parts(x)):
                    code[:, part], far = nearest(of, books[length][part])
                    error += far
                text = code.tobytes().hex()
                take = pa.array(rows)
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": batch.column("vec_id").take(take),
                        "label": batch.column("label").take(take),
                        "length": pa.array(np.full(len(rows), length, np.int32)),
                        "code": pa.array([text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], pa.string()),
                        "error": pa.array(error),
                    }
                )

    return make


# --- codebooks ---------------------------------------------------------------------------------


def first_books(vectors: DataFrame) -> Books:
    """The first codebooks: the parts of the vectors of the smallest ids, per vector length."""
    schema = "length int, missing boolean, vec_id long, vector array<long>"
    found = store(vectors.mapInArrow(_first_entries, schema), "first-vectors")
    lengths = [r.length for r in found.select("length").distinct().limit(MAX_LENGTHS + 1).collect()]
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} different lengths")
    books = {}
    for length in sorted(lengths):
        one = found.where(F.col("length") == length).groupBy("missing", "vec_id").agg(F.min("vector").alias("vector"))
        rows = one.orderBy("missing", "vec_id").limit(ENTRIES).collect()
        x = np.array([r.vector for r in rows], np.int64).reshape(len(rows), length)
        books[length] = _parts(x)
    return books


def improve(vectors: DataFrame, books: Books) -> Books:
    """One round: every entry becomes the floored mean of the parts nearest to it; unused ones stay."""
    sums = vectors.mapInArrow(_sums(books), "length int, slot long, total long")
    rows = sums.groupBy("length", "slot").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect()
    tables = {length: np.zeros((*book.shape[:2], book.shape[2] + 1), object) for length, book in books.items()}
    for r in rows:
        tables[r.length].ravel()[r.slot] = int(r.total)
    out = {}
    for length, book in books.items():
        n, total = tables[length][:, :, :1], tables[length][:, :, 1:]
        used = (n > 0).astype(bool)
        out[length] = np.where(used, total // np.where(used, n, 1), book).astype(np.int64)
    return out


def digest(book: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def learn(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> Books:
    """Codebooks of a table of vectors, by vector length."""
    rows = _named(vectors, id_col, vector_col)
    books = first_books(rows)
    for _ in range(ROUNDS if books else 0):
        books = improve(rows, books)
    return books


def encode(vectors: DataFrame, books: Books, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, label, length, code, error`` of all whole vectors, with given codebooks."""
    rows = _named(vectors, id_col, vector_col, label_col)
    kind = rows.schema["label"].dataType
    schema = T.StructType(
        [
            T.StructField("vec_id", T.LongType()),
            T.StructField("label", kind),
            T.StructField("length", T.IntegerType()),
            T.StructField("code", T.StringType()),
            T.StructField("error", T.LongType()),
        ]
    )
    return rows.mapInArrow(_codes(books), schema) if books else vectors.sparkSession.createDataFrame([], schema)


def decode(code: str, book: np.ndarray) -> np.ndarray:
    """The whole-number vector that a code stands for."""
    return np.concatenate([book[part][entry] for part, entry in enumerate(bytes.fromhex(code))])


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256, label`` of all whole vectors."""
    books = learn(vectors, id_col, vector_col)
    coded = store(encode(vectors, books, id_col, vector_col, label_col), "vector-codes")
    label = F.col("label").alias("_label")
    totals = store(coded.groupBy(label).agg(F.sum("error").alias("label_error")), "label-errors")
    shas = F.lit(None).cast("string")
    for length, book in books.items():
        shas = F.when(F.col("length") == length, F.lit(digest(book))).otherwise(shas)
    # As many rows as labels: the planner sends them to all tasks only where the stored table is small.
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.select("vec_id", "code", "error", "label_error", shas.alias("codebooks_sha256"), "label")


def _named(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None = None) -> DataFrame:
    configure(vectors.sparkSession)
    label = [vectors[label_col].alias("label")] if label_col else []
    return vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias("vector"), *label)


def _book_sql(name: str, old: str) -> str:
    """The entries after one round, from the parts and the entries before it."""
    return f"""
{name}_a AS MATERIALIZED (
  SELECT r, part, arg_min(entry, d * 64 + entry) AS entry
  FROM (SELECT r, p.part, b.entry, sum((p.v - b.v) * (p.v - b.v))::HUGEINT AS d FROM p JOIN {old} b ON b.part = p.part AND b.pos = p.pos GROUP BY ALL)
  GROUP BY r, part),
{name}_s AS (
  SELECT p.part, a.entry, p.pos, sum(p.v)::HUGEINT AS s, count(*)::HUGEINT AS n
  FROM p JOIN {name}_a a ON a.r = p.r AND a.part = p.part GROUP BY ALL),
{name} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce((s - ((s % n) + n) % n) // n, b.v)::BIGINT AS v
  FROM {old} b LEFT JOIN {name}_s s ON s.part = b.part AND s.entry = b.entry AND s.pos = b.pos),"""


SQL = f"""
WITH x AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS MATERIALIZED (
  SELECT r, i // (len(x) // 16) AS part, i % (len(x) // 16) AS pos, x[i + 1] AS v FROM x, unnest(range(len(x))) AS t(i)),
firsts AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS entry, min(x) AS x FROM x GROUP BY vec_id ORDER BY vec_id NULLS LAST LIMIT 64),
b0 AS MATERIALIZED (
  SELECT i // (len(x) // 16) AS part, entry, i % (len(x) // 16) AS pos, x[i + 1] AS v FROM firsts, unnest(range(len(x))) AS t(i)),
{_book_sql("b1", "b0")}
{_book_sql("b2", "b1")}
best AS (
  SELECT r, part, min(d * 64 + entry) AS best
  FROM (SELECT r, p.part, b.entry, sum((p.v - b.v) * (p.v - b.v))::HUGEINT AS d FROM p JOIN b2 b ON b.part = p.part AND b.pos = p.pos GROUP BY ALL)
  GROUP BY r, part),
coded AS (
  SELECT r, string_agg(printf('%02x', (best % 64)::INTEGER), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error
  FROM best GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b2) AS codebooks_sha256, label
FROM x JOIN coded USING (r)
"""
