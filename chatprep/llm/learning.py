"""Labelled samples and quality measures for the models that are trained here."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.llm.common import first_rows, store

MAX_TRAIN = 20_000  # labelled rows a quality model is fitted on, those of the smallest hashes of doc_id
FOLDS = 5


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model may learn from; rows without an id are held out as well."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def sample(labels: DataFrame, label: str = "quality") -> DataFrame:
    """``doc_id, _label`` of at most ``MAX_TRAIN`` learnable labels (0 or 1), each once; stored."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_label"))
    known = known.where(F.col("_label").isin(0, 1) & ~held_out()).distinct()
    return store(first_rows(known, "doc_id", MAX_TRAIN), "label-sample")


def labelled(features: DataFrame, chosen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of a ``sample``.

    A doc_id and label that stand more than once are one row: that of the least features.  So
    repeats neither grow what the driver gets nor weigh on the fit.
    """
    taken = features.join(chosen, "doc_id").groupBy("doc_id", "_label").agg(F.min("features").alias("features")).collect()
    taken.sort(key=lambda r: (r.doc_id, r._label, r.features))
    width = len(taken[0].features) if taken else 0
    return np.array([r.features for r in taken], float).reshape(len(taken), width), np.array([r._label for r in taken], float)


def bin_borders(column: np.ndarray, bins: int) -> np.ndarray:
    """Borders between quantile bins of a feature, at most ``bins - 1``."""
    cuts = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) if len(column) else np.zeros(0)
    return cuts.astype(float)


def auc(score: np.ndarray, label: np.ndarray) -> float:
    """Chance that a row with label 1 scores above one with label 0; ties count half."""
    _, back, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[back]
    good = label == 1
    return float((rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / max(good.sum() * (~good).sum(), 1))
