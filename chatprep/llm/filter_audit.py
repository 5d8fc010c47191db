"""How filters of a corpus interact: what each removes in every order, and what it alone removes.

Five filters are judged once per document.  A document then is a 32-bit word: bit S is set when it
survives the subset S of the filters, that is, fails none of them.  How many documents survive each
subset is a positional popcount of those words, taken with carry-save adders over whole batches
(three words become a word of sums and a word of carries), per part and kind of label.  Every
figure of every order is a difference of two or three of these 32 counts, so no order is ever run.

Filters (words are runs of characters other than ASCII white space, case matters; a failing
document is removed): A fewer than 200 words; B fewer than half of the words distinct; C more than
2% of the characters in A-Z; D any of ``#$%&*|``; E the text of a smaller doc_id, table-wide,
whether that document is removed or not.

Texts move nowhere: one scan turns each document into a row of six numbers, equal rows are counted
before the shuffle, and a text's smallest doc_id is a minimum over (128-bit digest, doc_id).
Whether a document has it is looked up by digest and doc_id together, so that no group of copies
meets in one task.

Nulls: a null text is empty (it fails A only, and E as a copy of other empty texts); a null source
is the part ``""``, as an empty source is.  A row without a doc_id has no label, is no smaller
document for others and does not fail E.  Repeated rows count each, and do not fail E by each other
(their doc_ids are equal).  A doc_id is good or toxic if any of its labels says so; null labels say
nothing.  An empty table has no parts and gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.llm.common import configure, groups, store
from chatprep.llm.textscan import BLACK, keys, per_document, words

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT = 50  # per cent
MAX_UPPER = 2  # per cent
SYMBOLS = "#$%&*|"
ALL = (1 << len(FILTERS)) - 1
SUBSETS = ALL + 1
MAX_PARTS = 4096  # parts whose counts a task holds before it passes them on

_SALT = np.uint64(0xC2B2AE3D27D4EB4F)
_UPPER, _SYMBOL, _START = np.zeros(256, bool), np.zeros(256, bool), np.ones(256, bool)
_UPPER[65:91] = True
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_START[128:192] = False  # bytes that go on with a character
#: By failed filters: the word of all subsets that a document with these failures survives.
SURVIVES = np.array([sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], np.uint32)


# --- judging texts -----------------------------------------------------------------------------


def failures(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Filters A to D that each document of a byte array fails, as bits 0 to 3."""
    n = len(borders) - 1

    def count(kind: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(kind[data])])[borders])

    starts, ends = words(data, borders, BLACK)
    n_words = np.diff(per_document(starts, borders))
    of = np.repeat(np.arange(n), n_words)
    key = keys(data, starts, ends) + (of.astype(np.uint64) + np.uint64(1)) * _SALT
    distinct = np.bincount(of[np.unique(key, return_index=True)[1]], minlength=n)
    bad = [
        n_words < MIN_WORDS,
        100 * distinct < MIN_DISTINCT * n_words,
        100 * count(_UPPER) > MAX_UPPER * count(_START),
        count(_SYMBOL) > 0,
    ]
    return sum(b.astype(np.int32) << i for i, b in enumerate(bad))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, borders in groups(batch.column("text")):
            digests = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(borders[:-1], borders[1:], strict=True)]
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id")[low:high],
                    batch.column("part")[low:high],
                    pa.array(halves[:, 0]),
                    pa.array(halves[:, 1]),
                    pa.array(failures(data, borders), pa.int32()),
                ],
                ["doc_id", "part", "text_a", "text_b", "failed"],
            )


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``doc_id, part, failed, n``: which filters (bits) documents fail, equal rows counted."""
    configure(docs.sparkSession)
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )
    facts = rows.mapInArrow(_judge, "doc_id long, part string, text_a long, text_b long, failed int")
    facts = store(facts.groupBy(*facts.columns).agg(F.count("*").alias("n")), "facts")
    text = ["text_a", "text_b"]
    firsts = facts.groupBy(*text).agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    failed = F.col("failed") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)
    return facts.join(firsts, [*text, "doc_id"], "left").select("doc_id", "part", "text_a", failed.alias("failed"), "n")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``judged`` with ``good`` and ``toxic``."""
    said = labels.select(labels["doc_id"].cast("long").alias("doc_id"), (labels["quality"] == 1).alias("good"), (labels["toxic"] == 1).alias("toxic"))
    said = said.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    # Rows without a doc_id match nothing; a second key keeps them from one task.
    said = said.withColumn("_deal", F.lit(0))
    deal = F.when(F.col("doc_id").isNull(), F.pmod("text_a", F.lit(1 << 12)).cast("int")).otherwise(0)
    dealt = rows.withColumn("_deal", deal).join(said, ["doc_id", "_deal"], "left")
    no = F.lit(False)
    return dealt.select("part", "failed", "n", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


# --- counting survivors ------------------------------------------------------------------------


def positional_counts(bits: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often each of the 32 bits is set in all words, each word taken ``times`` over.

    Carry-save adders: of three words of one weight, the bits of their sum stay at that weight and
    the carries go on to twice that weight.  A word that counts n times enters at the weights of
    the binary digits of n.  Only the last one or two words of a weight are looked at bit by bit.
    """
    total = np.zeros(32, np.int64)
    carried, weight = np.zeros(0, np.uint32), 0
    while len(carried) or times.any():
        here = np.concatenate([carried, bits[(times & 1).astype(bool)]])
        times = times >> 1
        carries = []
        while len(here) >= 3:
            third = len(here) // 3
            a, b, c = here[: 3 * third].reshape(3, third)
            half = a ^ b
            carries.append((a & b) | (half & c))
            here = np.concatenate([half ^ c, here[3 * third :]])
        for word in here:
            total += ((word >> np.arange(32, dtype=np.uint32)) & np.uint32(1)).astype(np.int64) << weight
        carried = np.concatenate(carries) if carries else np.zeros(0, np.uint32)
        weight += 1
    return total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}  # by part: survivors of each subset, by good + 2 * toxic

    def out() -> pa.RecordBatch:
        n = np.array(list(held.values()))
        columns = (n.sum(1), n[:, 1] + n[:, 3], n[:, 2] + n[:, 3])
        return pa.RecordBatch.from_pydict(
            {"part": pa.array(np.repeat(list(held), SUBSETS)), "subset": pa.array(np.tile(np.arange(SUBSETS, dtype=np.int32), len(held)))}
            | {name: pa.array(c.ravel()) for name, c in zip(("n", "good", "toxic"), columns, strict=True)}
        )

    for batch in batches:
        part = batch.column("part").dictionary_encode()
        failed, n, good, toxic = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("failed", "n", "good", "toxic"))
        group = part.indices.to_numpy().astype(np.int64) * 4 + good + 2 * toxic
        order = np.argsort(group, kind="stable")
        found, begin = np.unique(group[order], return_index=True)
        for g, low, high in zip(found.tolist(), begin, [*begin[1:], len(order)], strict=True):
            rows = order[low:high]
            table = held.setdefault(part.dictionary[g // 4].as_py(), np.zeros((4, SUBSETS), np.int64))
            table[g % 4] += positional_counts(SURVIVES[failed[rows]], n[rows])
        if len(held) > MAX_PARTS:
            yield out()
            held.clear()
    if held:
        yield out()


def survivors(rows: DataFrame) -> DataFrame:
    """``part, subset, n, good, toxic``: documents that survive each subset of the filters."""
    counted = rows.mapInArrow(_count, "part string, subset int, n long, good long, toxic long")
    return counted.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


# --- orders --------------------------------------------------------------------------------------


def _shapley(n: Column, filter_: int) -> Column:
    """What a filter removes, summed over all orders: for each set before it, as many orders as begin so."""
    total, bit = F.lit(0).cast("long"), 1 << filter_
    for before in (s for s in range(SUBSETS) if not s & bit):
        size = before.bit_count()
        orders = factorial(size) * factorial(len(FILTERS) - 1 - size)
        total = total + orders * (n[before] - n[before | bit])
    return total


def interactions(counts: DataFrame) -> DataFrame:
    """All figures of all steps of all orders, per part, from the counts of ``survivors``."""
    columns = ("n", "good", "toxic")
    sets = F.array_sort(F.collect_list(F.struct("subset", *columns)))
    parts = counts.groupBy("part").agg(sets.alias("sets")).select("part", *[F.col(f"sets.{c}").alias(c) for c in columns])
    parts = parts.withColumn("shares", F.array(*[_shapley(F.col("n"), i) for i in range(len(FILTERS))]))
    orders = F.lit(["".join(p) for p in permutations(FILTERS)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.lit(list(range(1, len(FILTERS) + 1)))))
    place = [F.instr("filter_order", letter) for letter in FILTERS]
    before = sum((F.when(p < F.col("step"), 1 << i).otherwise(0) for i, p in enumerate(place)), F.lit(0))
    index = F.coalesce(*[F.when(p == F.col("step"), i) for i, p in enumerate(place)])
    steps = steps.withColumns({"before": before, "index": index}).withColumn("bit", F.expr("shiftleft(1, index)"))
    after = F.col("before") + F.col("bit")

    def lost(c: str) -> Column:
        return F.get(c, F.col("before")) - F.get(c, after)

    failing = F.get("n", F.lit(0)) - F.get("n", F.col("bit"))
    return steps.select(
        "part",
        "filter_order",
        "step",
        F.get("n", after).alias("kept"),
        lost("n").alias("removed"),
        (failing - lost("n")).alias("redundant"),
        (F.get("n", ALL - F.col("bit")) - F.get("n", F.lit(ALL))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("shares", F.col("index")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step, with the counts named in ``interactions``."""
    return interactions(survivors(with_labels(judged(docs), labels)))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (
  SELECT part,
    CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AND doc_id IS NOT NULL AS good,
    doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AND doc_id IS NOT NULL AS toxic
  FROM w),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step::INTEGER AS step, filter_order[step] AS x, filter_order[:step - 1] AS earlier FROM o, range(1, 6) r(step)),
j AS (SELECT g.*, s.*, contains(fails, x) AS hit, length(translate(fails, earlier, '')) < length(fails) AS gone FROM g, s),
r AS (
  SELECT part, filter_order, step, any_value(x) AS x,
    sum(n) FILTER (NOT gone AND NOT hit) AS kept, sum(n) FILTER (hit AND NOT gone) AS removed,
    sum(n) FILTER (hit AND gone) AS redundant, sum(n) FILTER (fails = x) AS unique_fails,
    sum(good) FILTER (hit AND NOT gone) AS good_lost, sum(toxic) FILTER (hit AND NOT gone) AS toxic_lost
  FROM j GROUP BY part, filter_order, step)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, x), 0)::BIGINT AS shapley
FROM r
"""
