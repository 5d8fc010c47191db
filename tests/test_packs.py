"""Masks over rows in packs, tokenizer slices and running sums against plain loops."""

import random
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatprep.functions import arrays as A
from chatprep.operators import packs as K
from chatprep.operators import spans as P
from chatprep.operators import tokens as T


def test_encodings_of_a_batch_are_sent_back_in_slices():
    texts = ["a" * 300, None, "", "b" * 900, "c" * 10, "d"]
    slices = list(T.text_slices(pa.array(texts), 1000))
    assert [x for s in slices for x in s] == [t or "" for t in texts]
    assert [len(s) for s in slices] == [4, 2]


def test_packs_are_small_and_come_back():
    rng = random.Random(3)
    end = np.array(list(accumulate(rng.randint(1, 9) for _ in range(5000))))
    start, i = np.concatenate([[0], end[:-1]]), np.arange(5000)
    packed = K.pack(i, start, end)
    assert len(packed) < 4 * 5000  # a row of these takes 100 bytes and more
    assert all((a == b).all() for a, b in zip(K.unpack(packed), (i, start, end)))
    odd = [np.array(x) for x in ([5, 1], [-K.FAR, 7], [K.FAR, 3])]
    assert all((a == b).all() for a, b in zip(K.unpack(K.pack(*odd)), odd))


def meets(how, a, b, spans):
    before = [(s, e) for s, e in spans if (s < b if how == "overlap" else s <= a)]
    return bool(before) and {"prefix": a < before[-1][1], "containment": b <= before[-1][1], "overlap": a <= before[-1][1]}[how]


@pytest.mark.parametrize("how", ["prefix", "containment", "overlap"])
def test_rows_over_many_blocks(spark, how):
    """Long keys, tokens longer than a block, repeated rows, a null key, offsets that are null."""
    rng = random.Random(how)
    tokens, spans, want = [], [], {}
    for key in (None, "a", "b"):
        borders = sorted(rng.sample(range(90_000), 24))
        own = list(zip(borders[::2], borders[1::2]))
        spans += [(key, s, e) for s, e in own] * 2
        at = 0
        for i in range(600):
            size = rng.choice([1, 5, 300, 20_000 if i % 150 == 9 else 2])
            a, b = at, at + size
            at = b + rng.choice([0, 0, 7])
            tokens += [(key, i, a, b)] * rng.choice([1, 1, 2])
            want[key, i] = int(meets(how, a, b, own))
        tokens.append((key, 600, None, None))
        want[key, 600] = 0
    rng.shuffle(tokens)
    rows = spark.createDataFrame(tokens, "k string, i int, start int, end int").repartition(3)
    held = spark.createDataFrame(spans, "k string, start int, end int")
    masked = P.offset_mask_rows(rows, held, ["k"], how)
    plan = masked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # rows move once, as packs
    got = masked.collect()
    assert len(got) == len(want) and {(r.k, r.i): r["mask"] for r in got} == want


@pytest.mark.parametrize("how", ["prefix", "containment", "overlap"])
def test_offset_masks_with_ascending_offsets(spark, how):
    """Halving over tokens gives what a plain loop does, with and without ascending offsets."""
    rng = random.Random(how)
    rows = []
    for key in range(40):
        borders = sorted(rng.sample(range(300), 2 * rng.randint(0, 6)))
        ends = sorted(rng.sample(range(1, 300), rng.choice([0, 1, 40])))
        starts = [0, *ends[:-1]] if ends else []
        if key % 4 == 0:
            both = list(zip(starts, ends))
            rng.shuffle(both)
            starts, ends = [a for a, _ in both], [b for _, b in both]
        rows.append((key, starts, ends, list(zip(borders[::2], borders[1::2]))))
    df = spark.createDataFrame(rows, "k int, starts array<int>, ends array<int>, spans array<struct<start:int,end:int>>")
    got = {r.k: r.m for r in df.select("k", P.offset_mask(F.col("starts"), F.col("ends"), F.col("spans"), how).alias("m")).collect()}
    assert got == {k: [int(meets(how, a, b, sp)) for a, b in zip(s, e)] for k, s, e, sp in rows}


def test_prefix_sums_and_zero_ranges(spark):
    rng = random.Random(5)
    rows = [([rng.randint(0, 9) for _ in range(n)],) for n in (0, 1, 3, 4, 5, 16, 17, 255, 256, 257, 1025, 70_000)]
    df = spark.createDataFrame(rows, "v array<int>")
    for r in df.select("v", A.prefix_sums(F.col("v")).alias("s")).collect():
        assert r.s == [0, *accumulate(r.v)]
    ranges = F.expr("array(struct(1 AS start, 3 AS end), struct(4 AS start, 4 AS end), struct(5 AS start, 9 AS end))")
    for r in df.select("v", A.zero_ranges(F.col("v"), ranges).alias("z")).collect():
        assert r.z == [0 if i in (1, 2, 5, 6, 7, 8) else x for i, x in enumerate(r.v)]


def test_batch_hashes_are_those_of_the_column(spark):
    df = spark.createDataFrame([(["a", "é", "a"],), ([],), (None,), (["b"],)], "w array<string>")
    for r in df.select(T.hashed_ids("w").alias("one"), T.hashed_ids_batch("w").alias("all")).collect():
        assert r.one == r["all"]
