"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints.

Trees grow on quantile bins of the statistics and are flattened into arrays (feature, border,
children, value), so that all documents of a batch go down all trees level by level in numpy.
Where a constraint is set, a split whose children would order the wrong way is not taken and the
children inherit the middle as a bound, so the score can only move one way in that feature.

The learned verdict comes after the fixed rules; ``kept`` needs both.  Nulls and empty texts have
zero words and fail the fixed rules.  Repeated rows are judged alike; without any label, or with
labels of one kind only, the score is the share of label 1 (one half without labels).  An empty
table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatprep.llm.common import store
from chatprep.llm.docstats import COUNTS, FEATURES, statistics
from chatprep.llm.learning import bin_borders, labelled, sample

TREES, DEPTH, RATE, BINS, SMOOTH, LEAST = 60, 3, 0.15, 32, 1.0, 20
THRESHOLD = 0.3
# Signs of the effect on the score that the trees must keep to.
MONOTONE = {"repeat_share": -1, "symbols_per_word": -1, "dup_line_share": -1, "distinct_share": 1, "shouts_per_word": -1}


@dataclass
class Trees:
    """All trees in one set of arrays; a leaf is its own child."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    border: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        at_row = np.arange(len(rows))
        for root in self.roots.tolist():
            node = np.full(len(rows), root)
            for _ in range(DEPTH):
                down = rows[at_row, self.feature[node]] < self.border[node]
                node = np.where(down, self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def train(rows: np.ndarray, label: np.ndarray, signs: np.ndarray) -> Trees:
    share = (label.sum() + 0.5) / (len(label) + 1)
    base = float(np.log(share / (1 - share)))
    nodes: list[list] = []
    roots: list[int] = []
    if len(label) and 0 < label.sum() < len(label):
        borders = [bin_borders(rows[:, f], BINS) for f in range(rows.shape[1])]
        binned = np.column_stack([np.searchsorted(b, rows[:, f], "right") for f, b in enumerate(borders)])
        total = np.full(len(rows), base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-total))
            roots.append(len(nodes))
            _grow(nodes, binned, borders, label - p, p * (1 - p), np.arange(len(rows)), total, signs, -np.inf, np.inf, DEPTH)
    table = list(zip(*nodes, strict=True)) if nodes else [[]] * 5
    return Trees(base, np.array(roots, int), *(np.array(c, t) for c, t in zip(table, (int, float, int, int, float), strict=True)))


def _grow(nodes, binned, borders, slope, curve, rows, total, signs, low, high, depth) -> int:
    """Grow a node over ``rows``; its leaf values stay within ``low`` and ``high``."""
    here = len(nodes)
    value = float(np.clip(slope[rows].sum() / (curve[rows].sum() + SMOOTH), low, high))
    nodes.append([0, -np.inf, here, here, RATE * value])
    best = (1e-6, None)
    for f, cuts in enumerate(borders) if depth else ():
        if not len(cuts):
            continue
        at = binned[rows, f]
        g, h, n = (np.bincount(at, w, len(cuts) + 1).cumsum() for w in (slope[rows], curve[rows], None))
        gl, hl, nl = g[:-1], h[:-1], n[:-1]
        gr, hr, nr = g[-1] - gl, h[-1] - hl, n[-1] - nl
        vl, vr = np.clip(gl / (hl + SMOOTH), low, high), np.clip(gr / (hr + SMOOTH), low, high)
        gain = _worth(gl, hl, vl) + _worth(gr, hr, vr) - _worth(g[-1], h[-1], value)
        gain[(nl < LEAST) | (nr < LEAST) | (signs[f] * (vr - vl) < 0)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), (f, k, float(vl[k]), float(vr[k])))
    if best[1] is None:
        total[rows] += RATE * value
        return here
    f, k, vl, vr = best[1]
    left = binned[rows, f] <= k
    middle = (vl + vr) / 2
    bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(signs[f])]
    children = [
        _grow(nodes, binned, borders, slope, curve, part, total, signs, *bound, depth - 1)
        for part, bound in zip((rows[left], rows[~left]), bounds, strict=True)
    ]
    nodes[here] = [f, borders[f][k], *children, 0.0]
    return here


def _worth(g, h, value):
    """How much a leaf value lowers the loss, to second order."""
    return 2 * g * value - (h + SMOOTH) * value**2


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, fixed rules, learned ``score`` and ``kept`` for every row."""
    stats = store(statistics(docs, id_col, text_col), "statistics")
    rows, label = labelled(stats, sample(labels))
    trees = train(rows, label, np.array([MONOTONE.get(f, 0) for f in FEATURES]))
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("features").flatten().to_numpy().reshape(-1, len(FEATURES))
            score = pa.array(shared.value.score(rows), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", *COUNTS)), score], ["doc_id", *COUNTS, "score"]
            )

    scored = stats.mapInArrow(make, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= THRESHOLD))
