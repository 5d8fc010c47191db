"""The walk of the trie inside one task, over batches as Spark sends them."""

import random

import pyarrow as pa
import pytest

from chatprep.llm import simhash

COLUMNS = {"id": pa.int64(), "layout": pa.int32(), "depth": pa.int32(), "a": pa.int64(), "b": pa.int64(), "spent": pa.int32(), "side": pa.int32(), "bits": pa.int64()}


@pytest.mark.parametrize("size", [1, 7, 50, 1000])
def test_a_partition_of_several_slabs(monkeypatch, size):
    monkeypatch.setattr(simhash, "SLAB", 50)
    made = random.Random(size)
    prints = set()
    for _ in range(40):
        base = made.getrandbits(64)
        prints |= {base} | {base ^ 1 << made.randrange(43) ^ 1 << made.randrange(43) for _ in range(8)}
    node = lambda x: x >> 64 - simhash.WIDTHS[0]
    rows = [(x - (x >> 63 << 64), 0, simhash.WIDTHS[0], node(x), node(x), 0, 0, x - (x >> 63 << 64)) for x in sorted(prints)]
    batches = [
        pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size]), COLUMNS.values())], names=list(COLUMNS))
        for i in range(0, len(rows), size)
    ]
    got = [(x["a"], x["b"]) for b in simhash._walk(iter(batches)) for x in b.to_pylist()]
    want = {(p[0], q[0]) for p in rows for q in rows if p[0] > q[0] and p[3] == q[3] and ((p[0] ^ q[0]) & (1 << 64) - 1).bit_count() <= 2}
    assert len(rows) > 3 * simhash.SLAB and len(want) > 300
    assert len(got) == len(set(got)) and set(got) == want
