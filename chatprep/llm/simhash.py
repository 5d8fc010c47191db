"""Near-duplicates by SimHash, with a self-join of the binary trie of all fingerprints.

Fingerprints within two bits of each other agree in at least one of three bit blocks.  The trie
is therefore laid out three times, each time with another block as its first levels: there both
nodes of a pair are the same node (no budget spent), below it node pairs are walked together, the
bits in which their paths differ add up, and a pair is dropped when more than the budget differs.
A link is reported by the first layout that can find it, so none is reported twice.

Only distinct fingerprints enter the trie.  A node with many fingerprints is split before it
reaches a task: the first levels below it are walked as DataFrame rows, one per node pair, until
every pair is small.  Links are joined to components by alternating large and small stars, with
each round stored in the shared folder.

Links are between fingerprints, whoever carries them; ids name components only at the end.

Nulls: a null text has no words and fingerprint zero.  Rows without a doc_id carry links like any
other but never name a component; one in which no row has a doc_id has the name null.  Repeated
rows and equal texts share a fingerprint.  Texts that share a doc_id are judged each by itself, and
the doc_id may name a component of each.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatprep.llm.common import configure, documents, store

BUDGET = 2
SHINGLE = 3
TURNS = (0, 21, 42)  # left turns that bring block 0, 1 or 2 to the top
WIDTHS = (21, 21, 22)
STEP = 6  # bits by which a large node is split at once
NODE_LIMIT = 1 << 14  # fingerprints of a node pair that one task walks
LEAF = 16  # comparisons at which a walk ends in comparing all bits
SLAB = 1 << 18  # rows walked side by side


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """``doc_id, fingerprint`` (64 bits as a long) of whole texts; with ``key_col`` also ``row_key``."""
    configure(docs.sparkSession)
    key = ["row_key"] if key_col else []

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "fingerprint": pa.array(np.array(found, np.uint64).view(np.int64))}
                | {c: batch.column(c) for c in key}
            )

    return documents(docs, id_col, text_col, key_col).mapInArrow(make, "doc_id long, fingerprint long" + ", row_key string" * len(key))


def fingerprint(text: bytes) -> int:
    """Bits that more than half of the hashes of all word shingles (repeats included) have."""
    parts = text.lower().split()  # both know ASCII only
    if not parts:
        return 0
    text = b" ".join(parts)
    if len(parts) < SHINGLE:
        return xxhash.xxh64_intdigest(text, 42)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes).tolist()
    ends, digest = ends[SHINGLE - 1 :].tolist(), xxhash.xxh64_intdigest
    ones, step = np.zeros(64, np.int64), 1 << 15
    for i in range(0, len(ends), step):
        hashes = [digest(text[a:b], 42) for a, b in zip(starts[i : i + step], ends[i : i + step], strict=False)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(ends), bitorder="little").view("<u8")[0])


def _turned(turn: int) -> F.Column:
    value = F.col("fingerprint")
    if not turn:
        return value
    return F.shiftleft(value, turn).bitwiseOR(F.shiftrightunsigned(value, 64 - turn))


def links(classes: DataFrame) -> DataFrame:
    """Pairs ``a > b`` of ids whose fingerprints differ in one or two bits.

    ``classes`` has one row ``(fingerprint, id)`` per distinct fingerprint, ids are unique.
    """
    layouts = F.array(
        *[
            F.struct(
                F.lit(j).alias("layout"),
                F.lit(WIDTHS[j]).alias("depth"),
                F.shiftrightunsigned(_turned(TURNS[j]), 64 - WIDTHS[j]).alias("a"),
                F.shiftrightunsigned(_turned(TURNS[j]), 64 - WIDTHS[j]).alias("b"),
                F.lit(0).alias("spent"),
                F.lit(0).alias("side"),
                _turned(TURNS[j]).alias("bits"),
            )
            for j in range(3)
        ]
    )
    rows = classes.select("id", F.inline(layouts))
    pair = ["layout", "depth", "a", "b"]
    ready = None
    while True:
        large = store(rows.groupBy(*pair).count().where(F.col("count") > NODE_LIMIT).select(*pair), "nodes")
        if large.isEmpty():
            ready = rows if ready is None else ready.unionByName(rows)
            break
        small = rows.join(large, pair, "left_anti")
        ready = small if ready is None else ready.unionByName(small)
        rows = store(_descend(rows.join(large, pair, "left_semi")), "node-pairs")
    walked = ready.repartition(*pair).sortWithinPartitions(*pair, "side", "bits")
    return walked.mapInArrow(_walk, "a long, b long")


def _descend(rows: DataFrame) -> DataFrame:
    """Replace node pairs by the pairs of their children that stay within the budget."""
    step = F.least(F.lit(STEP), 64 - F.col("depth"))
    child = F.expr(f"shiftrightunsigned(bits, 64 - depth - least({STEP}, 64 - depth)) & (shiftleft(1L, least({STEP}, 64 - depth)) - 1)")
    flips = [m for m in range(1 << STEP) if m.bit_count() <= BUDGET]
    opened = rows.select(
        "*", step.alias("step"), child.alias("mine"), F.explode(F.array(*[F.lit(m).cast("long") for m in flips])).alias("flip")
    )
    other = F.col("mine").bitwiseXOR(F.col("flip"))
    same = F.col("a") == F.col("b")
    left = F.when(same, F.least("mine", other)).when(F.col("side") == 0, F.col("mine")).otherwise(other)
    right = F.when(same, F.greatest("mine", other)).when(F.col("side") == 0, other).otherwise(F.col("mine"))
    return (
        opened.where(F.expr(f"spent + bit_count(flip) <= {BUDGET} AND flip < shiftleft(1L, step)"))
        .select(
            "id",
            "layout",
            (F.col("depth") + F.col("step")).alias("depth"),
            F.expr("shiftleft(a, step)").bitwiseOR(left).alias("a"),
            F.expr("shiftleft(b, step)").bitwiseOR(right).alias("b"),
            (F.col("spent") + F.bit_count("flip")).alias("spent"),
            F.when(same, F.when(F.col("mine") == left, 0).otherwise(1)).otherwise(F.col("side")).alias("side"),
            "bits",
        )
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk the node pairs of a partition; its rows come sorted by pair, side and bits."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= SLAB:
            table = _arrays(held)
            last = int(_starts(table)[-1])  # the last pair may go on in the next batch
            if last:
                yield from _walk_slab({k: v[:last] for k, v in table.items()})
                held = pa.Table.from_batches(held).slice(last).to_batches()  # with the types of the batches to come
    if held:
        yield from _walk_slab(_arrays(held))


def _arrays(held: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches([b.select(["id", "layout", "depth", "a", "b", "spent", "side", "bits"]) for b in held])
    return {c: table[c].to_numpy().astype(np.int64) for c in table.column_names}


def _starts(t: dict[str, np.ndarray]) -> np.ndarray:
    new = np.ones(len(t["id"]), bool)
    new[1:] = np.any([t[c][1:] != t[c][:-1] for c in ("layout", "depth", "a", "b")], axis=0)
    return np.flatnonzero(new)


def _walk_slab(t: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    bits, n = t["bits"].view(np.uint64), len(t["id"])
    begin = _starts(t)
    end = np.append(begin[1:], n)
    right = np.concatenate([[0], np.cumsum(t["side"])])
    middle = end - (right[end] - right[begin])
    own = t["a"][begin] == t["b"][begin]
    # Node pairs as ranges of the sorted rows: [la, ha) with [lb, hb); own: a node with itself.
    pairs = np.column_stack([begin, np.where(own, end, middle), np.where(own, begin, middle), end, t["spent"][begin], own])
    depth = t["depth"][begin]
    found_a, found_b = [], []
    for level in range(int(depth.min()), 65):
        waiting = pairs[depth > level]
        pairs, later = pairs[depth <= level], depth[depth > level]
        small = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= LEAF
        if small.any():
            x, y = _compare(pairs[small], bits)
            found_a.append(x)
            found_b.append(y)
        pairs = pairs[~small]
        if level == 64 or not len(pairs) + len(waiting):
            break
        ones = np.concatenate([[0], np.cumsum(bits >> np.uint64(63 - level) & np.uint64(1)).astype(np.int64)])
        la, ha, lb, hb, spent, own = pairs.T
        ma, mb = ha - (ones[ha] - ones[la]), hb - (ones[hb] - ones[lb])
        over = spent + 1
        pairs = np.concatenate(
            [
                np.column_stack([la, ma, lb, mb, spent, own]),
                np.column_stack([ma, ha, mb, hb, spent, own]),
                np.column_stack([la, ma, mb, hb, over, 0 * own]),
                np.column_stack([ma, ha, lb, mb, over, 0 * own])[own == 0],
            ]
        )
        full = (pairs[:, 1] > pairs[:, 0]) & (pairs[:, 3] > pairs[:, 2]) & (pairs[:, 4] <= BUDGET)
        full &= (pairs[:, 5] == 0) | (pairs[:, 1] - pairs[:, 0] > 1)
        pairs = np.concatenate([pairs[full], waiting])
        depth = np.concatenate([np.full(int(full.sum()), level + 1), later])
    if found_a:
        x, y = np.concatenate(found_a), np.concatenate(found_b)
        differ = bits[x] ^ bits[y]
        layout = t["layout"][x]
        keep = np.bitwise_count(differ) <= BUDGET
        for j in (1, 2):  # an earlier layout finds those that agree in its block
            for earlier in range(j):
                place = np.uint64((TURNS[j] - TURNS[earlier] - WIDTHS[earlier]) % 64)
                block = differ >> place & np.uint64((1 << WIDTHS[earlier]) - 1)
                keep &= (layout != j) | (block != 0)
        p, q = t["id"][x[keep]], t["id"][y[keep]]
        keep = p != q
        yield pa.RecordBatch.from_pydict(
            {"a": pa.array(np.maximum(p, q)[keep], pa.int64()), "b": pa.array(np.minimum(p, q)[keep], pa.int64())}
        )


def _compare(pairs: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the members of small node pairs that are within the budget."""
    la, ha, lb, hb, _, own = pairs.T
    width = hb - lb
    n = (ha - la) * width
    of = np.repeat(np.arange(len(pairs)), n)
    i = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    x, y = la[of] + i // width[of], lb[of] + i % width[of]
    keep = ((own[of] == 0) | (x < y)) & (np.bitwise_count(bits[x] ^ bits[y]) <= BUDGET)
    return x[keep], y[keep]


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: for each node of the edges ``(a, b)`` the smallest node it reaches."""
    edges = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = store(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(least, "a").select(F.inline(ends))
        edges = store(small.where("a <> b").distinct(), "small-star")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node either is a root or has exactly one edge, to a root."""
    ends = F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("leaf")), F.struct(F.col("b").alias("node"), F.lit(0).alias("leaf")))
    seen = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("leaf").alias("n"), F.min("leaf").alias("root"))
    return seen.where("n > 1 OR (n = 1 AND root = 0)").isEmpty()


def _roots(made: DataFrame, first: F.Column) -> DataFrame:
    """``fingerprint, root`` and ``first``, the least ``first`` of all rows in the component.

    Fingerprints are the nodes: ids take no part in links, so none can join or clash with another.
    """
    classes = store(made.groupBy("fingerprint").agg(F.min(first).alias("first")), "classes")
    roots = components(links(classes.select("fingerprint", F.col("fingerprint").alias("id"))))
    named = classes.join(roots, classes["fingerprint"] == roots["node"], "left")
    return named.select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "first")


def first_keys(docs: DataFrame, key_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row_key`` of one row per component of texts: that of the smallest id (none comes last), then of the smallest key."""
    made = store(fingerprints(docs, id_col, text_col, key_col), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    return _roots(made, order).groupBy("root").agg(F.min("first").alias("first")).select("first.row_key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's ``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the smallest doc_id reached."""
    made = store(fingerprints(docs, id_col, text_col), "fingerprints")
    named = store(_roots(made, F.col("doc_id")), "roots")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("fingerprint", "component_id")
    return made.join(named, "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )
