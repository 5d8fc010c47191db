"""Language identification by nearest centroids of TF-IDF vectors of byte trigrams.

Texts are lowered in A-Z, and ASCII other than letters counts as a space; trigrams are hashed to
``WIDTH`` buckets.  Weights are log(1 + count) times the inverse document frequency, at length
one.  Each language has several centroids (spherical k-means, farthest points first); a text gets
the language of the centroid with the largest cosine, which is the score.  A text farther from
that centroid than nearly all training texts of the language is marked ``rejected``.

Document frequencies and counts of languages come from all learnable rows; only the clustering
uses a bounded sample, the ids of the smallest hashes per language, each with one text.  Marking far
texts as rejected does not change the prediction.

A null text, or one without a letter, is ``und`` with score 0 and rejected; so is every text when
nothing can be learnt.  Rows without an id are not learnt from.  Repeated rows are judged alike;
ties go to the language that sorts first.  An empty table gives no rows.  Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatprep.llm.common import configure, groups, place, reach, store
from chatprep.llm.learning import held_out

WIDTH = 4096
SAMPLE, PER_LANGUAGE = 2000, 500  # rows for clustering: in all, and of one language at most
CENTROIDS, ITERATIONS = 4, 12
INSIDE, MARGIN = 0.995, 0.05  # share of training texts within the radius, and what is added to it
ROWS = 64  # documents whose dense vectors are held at once

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Trigram counts ``(low, high, rows x WIDTH)`` of a text column, a few documents at a time."""
    space, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    padded = pc.binary_join_element_wise(space, pc.fill_null(column.cast(pa.large_string()), ""), space, nothing)
    for low, high, data, borders in groups(padded):
        text = _FOLD[data].astype(np.uint32)
        code = text[:-2] | text[1:-1] << 8 | text[2:] << 16
        bucket = (code * np.uint32(2654435761)) >> np.uint32(20)
        for a in range(0, high - low, ROWS):
            b = min(a + ROWS, high - low)
            first, last = borders[a], borders[b] - 2
            of = np.repeat(np.arange(b - a), np.diff(borders[a : b + 1]))[: last - first]
            hold = code[first:last] != 0x202020
            hold[borders[a + 1 : b] - first - 1] = hold[borders[a + 1 : b] - first - 2] = False  # across documents
            cell = (of * WIDTH + bucket[first:last])[hold]
            yield low + a, low + b, np.bincount(cell, minlength=(b - a) * WIDTH).reshape(b - a, WIDTH)


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    made = np.log1p(found.astype(np.float32)) * idf
    return made / np.maximum(np.sqrt((made * made).sum(1, keepdims=True)), 1e-9)


def cluster(rows: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` centroids of unit rows; starts from the mean, then from the farthest rows."""
    chosen = [rows.mean(0)]
    nearest = rows @ chosen[0] / max(float(np.linalg.norm(chosen[0])), 1e-9)
    for _ in range(1, min(k, len(rows))):
        chosen.append(rows[int(nearest.argmin())])
        nearest = np.maximum(nearest, rows @ chosen[-1])
    centroids = np.stack(chosen)
    for _ in range(ITERATIONS):
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-9)
        mine = (rows @ centroids.T).argmax(1)
        centroids = np.stack([rows[mine == c].mean(0) if (mine == c).any() else centroids[c] for c in range(len(centroids))])
    return (centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-9)).astype(np.float32)


class Model:
    def __init__(self, idf: np.ndarray, sample: list[tuple[str, np.ndarray]]) -> None:
        self.idf = idf
        self.languages = sorted({lang for lang, _ in sample})
        parts, of, self.radius = [], [], []
        for i, lang in enumerate(self.languages):
            rows = vectors(np.stack([v for name, v in sample if name == lang]), idf)
            made = cluster(rows, CENTROIDS)
            self.radius.append(float(np.quantile(1 - (rows @ made.T).max(1), INSIDE)) + MARGIN)
            parts.append(made)
            of += [i] * len(made)
        self.centroids = np.concatenate(parts) if parts else np.zeros((0, WIDTH), np.float32)
        self.of = np.array(of, int)

    def nearest(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosine = vectors(found, self.idf) @ self.centroids.T
        best = cosine.argmax(1)
        return self.of[best], np.clip(cosine[np.arange(len(best)), best], 0, 1)


HELD = 128  # sampled vectors a task holds before it passes them on


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of all texts of a task, and the trigram counts of sampled ones.

    A sampled doc_id and language is passed on once, with the text of the smallest hash, or once per
    ``HELD`` others; so a repeated one stays small.
    """
    seen, rows = np.zeros(WIDTH, np.int64), 0
    held: dict[tuple[int, str], tuple[int, bytes]] = {}

    def sampled() -> pa.RecordBatch:
        names, found = list(held), list(held.values())
        nothing = pa.nulls(len(names), pa.int64())
        return pa.RecordBatch.from_pydict(
            {
                "bucket": nothing,
                "n": nothing,
                "doc_id": pa.array([i for i, _ in names], pa.int64()),
                "lang": pa.array([x for _, x in names], pa.string()),
                "hash": pa.array([h for h, _ in found], pa.int64()),
                "vector": pa.array([v for _, v in found], pa.binary()),
            }
        )

    for batch in batches:
        taken = batch.column("sampled").to_numpy(zero_copy_only=False)
        for low, high, found in counts(batch.column("text")):
            seen += (found > 0).sum(0)
            rows += high - low
            for i in np.flatnonzero(taken[low:high]).tolist():
                name, here = (batch.column("doc_id")[low + i].as_py(), batch.column("lang")[low + i].as_py()), batch.column("hash")[low + i].as_py()
                if name not in held or here < held[name][0]:
                    held[name] = here, found[i].astype("<f4").tobytes()
            if len(held) >= HELD:
                yield sampled()
                held.clear()
    if held:
        yield sampled()
    none = [pa.nulls(WIDTH + 1, t) for t in (pa.int64(), pa.string(), pa.int64(), pa.binary())]
    counted = [pa.array(np.append(np.arange(WIDTH), -1)), pa.array(np.append(seen, rows))]
    yield pa.RecordBatch.from_arrays([*counted, *none], ["bucket", "n", "doc_id", "lang", "hash", "vector"])


def learn(docs: DataFrame) -> Model:
    """Fit on rows ``(doc_id, text, lang)`` that aren't held out; texts are read once."""
    known = docs.where(F.col("lang").isNotNull() & ~held_out())
    ids = store(known.select("doc_id", "lang").distinct(), "language-ids")
    sizes = store(ids.groupBy("lang").agg(F.count("*").alias("_n")), "language-sizes")
    each = max(1, min(PER_LANGUAGE, SAMPLE // max(sizes.count(), 1)))
    # Ids that cannot be among the first of their language are left out before any are ranked.
    near = ids.join(sizes, "lang").where(place("doc_id") < reach(each, F.col("_n")))
    order = Window.partitionBy("lang").orderBy(place("doc_id"), "doc_id")
    chosen = near.select("doc_id", "lang").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= each)
    # At most SAMPLE rows, or one per language: the planner decides how they meet the texts.
    chosen = store(chosen.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")), "language-sample")
    texts = known.where(F.col("text").isNotNull())
    texts = texts.join(chosen, (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")), "left")
    texts = texts.select("doc_id", "lang", "text", F.xxhash64("text").alias("hash"), F.col("_id").isNotNull().alias("sampled"))
    schema = "bucket long, n long, doc_id long, lang string, hash long, vector binary"
    found = store(texts.mapInArrow(_learn, schema), "language-counts")
    sums = found.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = {r.bucket: r.n for r in sums.collect()}  # WIDTH + 1 rows
    n = total.pop(-1, 0)
    idf = np.log((1 + n) / (1 + np.array([total.get(b, 0) for b in range(WIDTH)], float))) + 1
    first = F.min(F.struct("hash", "vector"))["vector"].alias("vector")
    rows = found.where("vector IS NOT NULL").groupBy("lang", "doc_id").agg(first).collect()
    rows.sort(key=lambda r: (r.lang, r.doc_id))
    return Model(idf.astype(np.float32), [(r.lang, np.frombuffer(r.vector, "<f4")) for r in rows])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every row."""
    configure(docs.sparkSession)
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        docs[text_col].cast("string").alias("text"),
        docs[lang_col].cast("string").alias("lang"),
    )
    shared = docs.sparkSession.sparkContext.broadcast(learn(rows))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for low, high, found in counts(batch.column("text")):
                texts = batch.column("text")[low:high]
                if model.languages:
                    best, score = model.nearest(found)
                    names = [model.languages[i] for i in best.tolist()]
                    far = 1 - score > np.array(model.radius)[best]
                else:
                    names, score, far = ["und"] * (high - low), np.zeros(high - low), np.ones(high - low, bool)
                for i, text in enumerate(texts.to_pylist()):
                    if text is None or not any(map(str.isalpha, text)):
                        names[i], score[i], far[i] = "und", 0.0, True
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id")[low:high],
                        "lang_pred": pa.array(names, pa.string()),
                        "score": pa.array(score.astype(float)),
                        "rejected": pa.array(far),
                    }
                )

    judged = rows.select("doc_id", "text").mapInArrow(make, "doc_id long, lang_pred string, score double, rejected boolean")
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
