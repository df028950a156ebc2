"""Held-out folds and calibration shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_fold(id_col: str, folds: int, fold: int) -> Column:
    """crc32(id as text) mod folds is fold; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(True))


def known_labels(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label): one row per labelled id; repeated labels of an id are averaged."""
    found = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    return found.groupBy(F.col(id_col).alias("doc_id")).agg(F.avg(F.col(label_col).cast("double")).alias("label"))


def isotonic(values: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Non-decreasing means by pooling adjacent violators; values ascend."""
    blocks: list[list[float]] = []
    for label, weight in zip(labels.tolist(), weights.tolist()):
        blocks.append([label * weight, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.concatenate([[s / w] * int(n) for s, w, n in blocks]) if blocks else np.zeros(0)
