"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` cuts the training table into segments of whole documents and stores, per
segment, the positions of every term (a document-partitioned index, written once, searched any
number of times).  ``search`` takes the windows of a benchmark, finds for each the rarest of its
terms in the segment, and intersects the offset-adjusted position lists of the other terms,
rarest first.  ``matches`` gives exact phrases; ``near`` gives documents in which all terms of a
window stand within a given distance.

The benchmark is read in blocks of at most ``BLOCK_WORDS`` words (8 MB of term keys); every block
goes over all segments, so neither side is ever held whole.  Terms are 64-bit keys of their bytes.

Nulls: null texts have no words; null document ids are kept; benchmark rows without an id count
as an item with an empty id.  Items without words give no window.  Repeated documents are judged
row by row, repeated items count once per item_id.  Empty tables give no hits or no rows.  Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatprep.llm.common import configure, groups, lists, store
from chatprep.llm.textscan import LOWER, WORD, keys, per_document, words

WINDOW = 13
SEGMENT_BYTES = 2 << 20  # text of a segment; a longer document is one alone
BLOCK_WORDS = 1 << 20
PIECE_WORDS = 1 << 14  # a longer item is cut into overlapping pieces
BATCH_PAIRS = 1 << 20  # candidate places compared at once
INDEX_SCHEMA = (
    "segment string, row_ids array<bigint>, doc_ids array<bigint>, doc_words array<bigint>, "
    "terms binary, term_starts binary, positions binary"
)
HIT_SCHEMA = "segment string, row int, starts array<int>, ends array<int>, items array<string>"


def _terms(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[data]
    starts, ends = words(data, borders, WORD)
    return keys(data, starts, ends), per_document(starts, borders)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", string_ids: bool = False) -> DataFrame:
    """Store the postings of a table: positions of all terms, by segment; ids are longs or strings."""
    configure(docs.sparkSession)
    kind = pa.string() if string_ids else pa.int64()
    rows = docs.select(docs[id_col].cast("string" if string_ids else "long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, borders in groups(batch.column("text"), SEGMENT_BYTES):
                terms, first = _terms(data, borders)
                order = np.argsort(terms, kind="stable").astype(np.int32)
                found, starts = np.unique(terms[order], return_index=True)
                n = high - low
                yield pa.RecordBatch.from_pydict(
                    {
                        "segment": pa.array([""]),
                        "row_ids": pa.array([np.arange(n)], pa.list_(pa.int64())),
                        "doc_ids": pa.array([batch.column("doc_id")[low:high].to_pylist()], pa.list_(kind)),
                        "doc_words": pa.array([np.diff(first)], pa.list_(pa.int64())),
                        "terms": pa.array([found.tobytes()], pa.binary()),
                        "term_starts": pa.array([np.append(starts, len(terms)).astype(np.int32).tobytes()], pa.binary()),
                        "positions": pa.array([order.tobytes()], pa.binary()),
                    }
                )

    # A random name is drawn once, before the index is written, and read from the files after.
    schema = INDEX_SCHEMA.replace("doc_ids array<bigint>", "doc_ids array<string>") if string_ids else INDEX_SCHEMA
    named = rows.mapInArrow(make, schema).withColumn("segment", F.expr("uuid()"))
    return store(named, "postings")


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Items as term keys, cut into pieces and numbered by block; stored."""
    configure(benchmark.sparkSession)
    items = benchmark.select(
        F.coalesce(benchmark[id_col].cast("string"), F.lit("")).alias("item"),
        benchmark[text_col].cast("string").alias("text"),
    )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, borders in groups(batch.column("text")):
                terms, first = _terms(data, borders)
                names, out = batch.column("item")[low:high].to_pylist(), {"item": [], "n": [], "terms": []}
                for i, name in enumerate(names):
                    mine = terms[first[i] : first[i + 1]]
                    for a in range(0, max(len(mine) - WINDOW + 1, min(len(mine), 1)), PIECE_WORDS):
                        piece = mine[a : a + PIECE_WORDS + WINDOW - 1]
                        out["item"].append(name)
                        out["n"].append(len(piece))
                        out["terms"].append(piece.tobytes())
                yield pa.RecordBatch.from_pydict(out, schema=_PIECES)

    # Equal pieces are one: they would all fall into one block, and repeats change no result.
    pieces = store(items.mapInArrow(make, "item string, n long, terms binary").distinct(), "benchmark")
    # Number the blocks from totals of hash buckets, so that no window sees the whole benchmark.
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    count = -(-total * 2 // BLOCK_WORDS)  # half full on average
    return pieces.withColumn("block", F.pmod(F.xxhash64("item", "terms"), F.lit(max(count, 1)))), count


_PIECES = pa.schema([("item", pa.string()), ("n", pa.int64()), ("terms", pa.binary())])


class Windows:
    """The distinct windows of one block, by length, with the items that have them.

    A window is a place in the block's terms: what is broadcast is the terms once, not once per window.
    """

    def __init__(self, pieces: list[tuple[str, bytes]]) -> None:
        self.items = sorted({item for item, _ in pieces})
        number = {item: i for i, item in enumerate(self.items)}
        by_length: dict[int, tuple[list, list, list]] = {}
        for item, raw in pieces:
            terms = np.frombuffer(raw, np.uint64)
            length = min(WINDOW, len(terms))
            flat, places, owners = by_length.setdefault(length, ([], [], []))
            places.append(np.arange(len(terms) - length + 1) + sum(map(len, flat)))
            flat.append(terms)
            owners.append(np.full(len(places[-1]), number[item], np.int32))
        self.groups = []
        for length, (flat, places, owners) in sorted(by_length.items()):
            flat, place, owner = (np.concatenate(x) for x in (flat, places, owners))
            windows = np.lib.stride_tricks.sliding_window_view(flat, length)[place]
            _, first, back = np.unique(windows, axis=0, return_index=True, return_inverse=True)
            back = back.ravel()
            order = np.argsort(back, kind="stable")
            edges = np.searchsorted(back[order], np.arange(len(first) + 1))
            self.groups.append((length, flat, place[first], owner[order], edges))


def search(index: DataFrame, windows: Windows) -> DataFrame:
    """Hits of one block: per document with a hit, its merged word ranges and items."""
    shared = index.sparkSession.sparkContext.broadcast(windows)  # bounded by BLOCK_WORDS

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                one = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                yield from _search_segment(one, shared.value)

    return index.select("segment", "doc_words", "terms", "term_starts", "positions").mapInArrow(make, HIT_SCHEMA)


def _phrases(code: np.ndarray, size: np.ndarray, starts: np.ndarray, postings: np.ndarray, positions: np.ndarray):
    """Places (window, first word) of windows given by term numbers; ``size`` are list lengths.

    ``postings`` are ``term << 32 | position``, ascending: a term stands at a place when the
    pair is in it.
    """
    order = np.argsort(size, axis=1, kind="stable")  # rarest term first
    rare = order[:, 0]
    row = np.arange(len(code))
    lengths = size[row, rare]
    edges = np.cumsum(lengths)
    low = 0
    while low < len(code):
        high = max(low + 1, int(np.searchsorted(edges, (edges[low - 1] if low else 0) + BATCH_PAIRS, "right")))
        part = row[low:high]
        n = lengths[part]
        at = np.repeat(part, n)
        shift = np.repeat(starts[code[part, rare[part]]] - (np.cumsum(n) - n), n)
        place = positions[shift + np.arange(len(at))].astype(np.int64) - rare[at]
        keep = place >= 0
        at, place = at[keep], place[keep]
        for step in range(1, code.shape[1]):
            if not len(at):
                break
            offset = order[at, step]
            wanted = code[at, offset] << 32 | place + offset
            found = np.minimum(np.searchsorted(postings, wanted), len(postings) - 1)
            keep = postings[found] == wanted
            at, place = at[keep], place[keep]
        if len(at):
            yield at, place
        low = high


def _search_segment(one: dict, windows: Windows) -> Iterator[pa.RecordBatch]:
    terms = np.frombuffer(one["terms"], np.uint64)
    starts = np.frombuffer(one["term_starts"], np.int32).astype(np.int64)
    positions = np.frombuffer(one["positions"], np.int32)
    if not len(terms):
        return
    first = np.concatenate([[0], np.cumsum(one["doc_words"])]).astype(np.int64)
    sizes = np.diff(starts)
    postings = None
    places, lengths, found_items = [], [], []
    for length, flat, begins, owners, edges in windows.groups:
        code = np.minimum(np.searchsorted(terms, flat), len(terms) - 1)
        absent = np.concatenate([[0], np.cumsum(terms[code] != flat)])
        there = np.flatnonzero(absent[begins + length] == absent[begins])
        if not len(there):
            continue
        if postings is None:
            postings = np.repeat(np.arange(len(terms)), sizes) << 32 | positions
        code = code[begins[there][:, None] + np.arange(length)]
        hit_windows = []
        for at, place in _phrases(code, sizes[code], starts, postings, positions):
            doc = np.searchsorted(first, place, "right") - 1
            same = place + length <= first[doc + 1]
            at, place, doc = there[at[same]], place[same], doc[same]
            places.append(place)
            lengths.append(np.full(len(place), length))
            hit_windows.append(np.unique(doc << 32 | at))
        # A window that a document holds often is looked up once, however many items have it.
        held = np.unique(np.concatenate(hit_windows)) if hit_windows else np.zeros(0, np.int64)
        for a in range(0, len(held), BATCH_PAIRS):
            doc, at = held[a : a + BATCH_PAIRS] >> 32, held[a : a + BATCH_PAIRS] & 0xFFFFFFFF
            n = edges[at + 1] - edges[at]
            item = owners[np.repeat(edges[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            found_items.append(np.unique(np.repeat(doc, n) << 32 | item))
    if not places or not sum(map(len, places)):
        return
    place, length = np.concatenate(places), np.concatenate(lengths)
    pairs = np.unique(np.concatenate(found_items))
    edge = np.zeros(int(first[-1]) + 1, np.int32)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + length, -1)
    hit = np.cumsum(edge[:-1]) > 0
    begin, end = words(hit.astype(np.uint8), first, np.array([False, True]))
    row = np.unique(pairs >> 32)
    doc = np.searchsorted(first, begin, "right") - 1
    cut = np.append(np.searchsorted(doc, row), len(begin))
    yield pa.RecordBatch.from_pydict(
        {
            "segment": pa.array([one["segment"]] * len(row)),
            "row": pa.array(row, pa.int32()),
            "starts": lists(begin - first[doc], cut, pa.int32()),
            "ends": lists(end - first[doc], cut, pa.int32()),
            "items": lists(
                [windows.items[i] for i in (pairs & 0xFFFFFFFF).tolist()],
                np.append(np.searchsorted(pairs >> 32, row), len(pairs)),
                pa.string(),
            ),
        }
    )


def matches(index: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit`` and ``items`` (strings, sorted).

    A word counts once however many windows cover it, in whatever blocks they are.
    """
    pieces, count = _blocks(benchmark, id_col, text_col)
    hits = None
    for block in range(count):
        mine = pieces.where(F.col("block") == block).select("item", "terms").collect()  # one block
        windows = Windows([(r.item, bytes(r.terms)) for r in mine])
        found = search(index, windows)
        hits = found if hits is None else hits.unionByName(found)
    documents = index.select(
        "segment", F.inline(F.arrays_zip(F.col("row_ids").alias("row"), "doc_ids", "doc_words"))
    ).toDF("segment", "row", "doc_id", "n_words")
    if hits is None:
        empty = F.array().cast("array<string>")
        return documents.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), empty.alias("items"))
    # One group has a row per block at most.
    ranges = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))))
    merged = (
        hits.groupBy("segment", "row")
        .agg(ranges.alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        .withColumn("n_hit", F.aggregate("ranges", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), _covered)["n"])
    )
    return (
        documents.join(merged.drop("ranges"), ["segment", "row"], "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )


def _covered(total, one):
    past = F.greatest(one["starts"], total["end"])
    return F.struct(
        F.greatest(one["ends"], total["end"]).alias("end"),
        (total["n"] + F.greatest(one["ends"] - past, F.lit(0))).cast("long").alias("n"),
    )


def near(index: DataFrame, terms: list[str], distance: int) -> DataFrame:
    """``doc_id, n_places``: occurrences of the rarest term with all other terms within ``distance`` words."""
    raw = [t.encode().lower() for t in dict.fromkeys(terms)]
    flat = np.frombuffer(b"".join(raw), np.uint8)
    borders = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    wanted = keys(flat, borders[:-1], borders[1:])
    string_ids = index.schema["doc_ids"].dataType.elementType.simpleString() == "string"
    kind, named = (pa.string(), "string") if string_ids else (pa.int64(), "long")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                one = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                held = np.frombuffer(one["terms"], np.uint64)
                code = np.searchsorted(held, wanted)
                if not len(held) or (code == len(held)).any() or (held[code] != wanted).any():
                    continue
                starts = np.frombuffer(one["term_starts"], np.int32)
                positions = np.frombuffer(one["positions"], np.int32)
                found = sorted((positions[starts[c] : starts[c + 1]] for c in code), key=len)
                first = np.concatenate([[0], np.cumsum(one["doc_words"])])
                place = found[0]
                doc = np.searchsorted(first, place, "right") - 1
                keep = np.ones(len(place), bool)
                for other in found[1:]:
                    low = np.maximum(place - distance, first[doc])
                    high = np.minimum(place + distance, first[doc + 1] - 1)
                    keep &= np.searchsorted(other, high, "right") > np.searchsorted(other, low)
                row, n = np.unique(doc[keep], return_counts=True)
                ids = pa.array([one["doc_ids"][r] for r in row.tolist()], kind)
                yield pa.RecordBatch.from_pydict({"doc_id": ids, "n_places": pa.array(n, pa.int64())})

    return index.select("doc_ids", "doc_words", "terms", "term_starts", "positions").mapInArrow(
        make, f"doc_id {named}, n_places long"
    )


def contamination(found: DataFrame) -> DataFrame:
    """The digest of ``matches``: hit words of at least a twentieth make a document contaminated."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
