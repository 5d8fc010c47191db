"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into quantile bins and has a table of one number per bin; some pairs of
features have a table over coarser bins.  Training goes round the tables in turn, and adds to
each a small share of a shallow tree (two splits of one feature, or one split of each of two)
fitted to what all tables together still miss.  The pairs are those whose best such tree explains
most after the single features are done.  A score is the sum of one entry per table.

A null or empty text is scored from its zero counts.  Repeated rows score alike.  Without labels,
or with labels of one kind only, the score is the smoothed share of label 1.  An empty table gives no
rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatprep.llm.common import configure, groups, store
from chatprep.llm.docstats import FEATURES, measure, statistics
from chatprep.llm.learning import bin_borders, held_out, labelled, sample

BINS, PAIR_BINS, PAIRS = 64, 12, 8
ROUNDS, PAIR_ROUNDS, RATE, SMOOTH, LEAST = 150, 60, 0.15, 1.0, 10
THRESHOLD = 0.3


@dataclass
class Additive:
    """``base`` plus a table per feature plus a table per pair of features."""

    base: float
    borders: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        for f, (cuts, table) in enumerate(zip(self.borders, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, rows[:, f], "right")]
        for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
            i = np.searchsorted(self.coarse[f], rows[:, f], "right")
            total += table[i, np.searchsorted(self.coarse[g], rows[:, g], "right")]
        return 1 / (1 + np.exp(-total))


def _value(g, h):
    return g / (h + SMOOTH)


def _line(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The best tree of two splits over a row of bins, as one value per bin."""
    edges = [0, len(g)]
    for _ in range(2):
        best = (1e-9, None)
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a < 2:
                continue
            gl, hl, nl = g[a:b].cumsum(), h[a:b].cumsum(), n[a:b].cumsum()
            gain = gl**2 / (hl + SMOOTH) + (gl[-1] - gl) ** 2 / (hl[-1] - hl + SMOOTH) - gl[-1] ** 2 / (hl[-1] + SMOOTH)
            gain[(nl < LEAST) | (nl[-1] - nl < LEAST)] = -1
            k = int(gain[:-1].argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), a + k + 1)
        if best[1] is None:
            break
        edges = sorted([*edges, best[1]])
    out = np.empty(len(g))
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = _value(g[a:b].sum(), h[a:b].sum())
    return out


def _square(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree of one split of each of two features, and its gain over none."""
    sums = [np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (g, h)]

    def corners(s):
        a, right, down, all_ = s[1:-1, 1:-1], s[1:-1, -1:], s[-1:, 1:-1], s[-1, -1]
        return np.stack([a, right - a, down - a, all_ - right - down + a])

    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    gs, hs = corners(sums[0]), corners(sums[1])
    gain = (gs**2 / (hs + SMOOTH)).sum(0) - sums[0][-1, -1] ** 2 / (sums[1][-1, -1] + SMOOTH)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    v, out = _value(gs[:, i, j], hs[:, i, j]), np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


def train(rows: np.ndarray, label: np.ndarray) -> Additive:
    share = (label.sum() + 0.5) / (len(label) + 1)
    model = Additive(float(np.log(share / (1 - share))))
    if not len(label) or not 0 < label.sum() < len(label):
        return model
    count = rows.shape[1]
    model.borders = [bin_borders(rows[:, f], BINS) for f in range(count)]
    model.coarse = [bin_borders(rows[:, f], PAIR_BINS) for f in range(count)]
    at = [np.searchsorted(b, rows[:, f], "right") for f, b in enumerate(model.borders)]
    near = [np.searchsorted(b, rows[:, f], "right") for f, b in enumerate(model.coarse)]
    sizes = [np.bincount(a, minlength=len(b) + 1) for a, b in zip(at, model.borders, strict=True)]
    model.tables = [np.zeros(len(b) + 1) for b in model.borders]
    total = np.full(len(rows), model.base)

    def missed() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return label - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(count):
            slope, curve = missed()
            n = len(model.tables[f])
            step = RATE * _line(np.bincount(at[f], slope, n), np.bincount(at[f], curve, n), sizes[f])
            model.tables[f] += step
            total += step[at[f]]

    def tree(f: int, g: int, slope: np.ndarray, curve: np.ndarray) -> tuple[float, np.ndarray]:
        shape = (len(model.coarse[f]) + 1, len(model.coarse[g]) + 1)
        cell, n = near[f] * shape[1] + near[g], shape[0] * shape[1]
        return _square(np.bincount(cell, slope, n).reshape(shape), np.bincount(cell, curve, n).reshape(shape))

    slope, curve = missed()
    worth = {pair: tree(*pair, slope, curve)[0] for pair in combinations(range(count), 2)}
    model.pairs = sorted(worth, key=lambda p: (-worth[p], p))[:PAIRS]
    model.pair_tables = [np.zeros((len(model.coarse[f]) + 1, len(model.coarse[g]) + 1)) for f, g in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (f, g) in enumerate(model.pairs):
            step = RATE * tree(f, g, *missed())[1]
            model.pair_tables[k] += step
            total += step[near[f], near[g]]
    return model


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows predicted to be good, with all their columns: scored and filtered where they lie, nothing is joined.

    Before that only the texts of the sample are looked at, to fit the model.
    """
    configure(docs.sparkSession)
    chosen = sample(labels)  # at most MAX_TRAIN rows
    sampled = docs.join(F.broadcast(chosen.select(F.col("doc_id").alias("_id"))), docs[id_col].cast("long") == F.col("_id"), "left_semi")
    model = train(*labelled(statistics(sampled, id_col, text_col).select("doc_id", "features"), chosen))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [np.zeros(0, bool)]
            for _, _, data, borders in groups(batch.column(place)):
                good.append(shared.value.score(measure(data, borders)[1]) >= THRESHOLD)
            yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(make, docs.schema)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; learnt from rows that aren't held out."""
    stats = store(statistics(docs, id_col, text_col).select("doc_id", "features"), "features")
    shared = docs.sparkSession.sparkContext.broadcast(train(*labelled(stats, sample(labels))))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("features").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(shared.value.score(rows), pa.float64())], ["doc_id", "score"]
            )

    scored = stats.mapInArrow(make, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
