"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight for each hashed feature, shared by all grades, and ordered thresholds: P(grade <= k) is the logistic function
of threshold k minus the document's sum of weights. It gives the expected grade and the probability of reaching a grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_place, slices
from .features import BITS, descend, labelled_sample, quality_features, sums


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _cuts(p: np.ndarray, k: int) -> np.ndarray:
    """Thresholds of parameters: the first one, then logarithms of the gaps."""
    return p[0] + np.concatenate([[0], np.cumsum(np.exp(p[1:k]))])


def ordinal_gradient(p: np.ndarray, k: int, grade: np.ndarray, owner: np.ndarray, feature: np.ndarray, shrink: float) -> np.ndarray:
    """Of the mean negative log likelihood plus shrink / 2 times the squared weights.

    p: k parameters of the thresholds (see _cuts), then a weight for each feature. Document i has the features `feature[owner == i]`.
    """
    n, w, theta = len(grade), p[k:], _cuts(p, k)
    f = np.bincount(owner, w[feature], n)
    edges = np.concatenate([[-np.inf], theta, [np.inf]])
    upper, lower = edges[grade + 1] - f, edges[grade] - f
    cu, cl = _sigmoid(upper), _sigmoid(lower)
    prob = np.maximum(cu - cl, 1e-12)
    du, dl = cu * (1 - cu), cl * (1 - cl)
    gf = (du - dl) / prob / n  # of the loss, by f
    gt = np.zeros(k + 2)
    np.add.at(gt, grade + 1, -du / prob / n)
    np.add.at(gt, grade, dl / prob / n)
    gt = gt[1:-1]
    after = np.cumsum(gt[::-1])[::-1]
    return np.concatenate([[after[0]], after[1:] * np.exp(p[1:k]), np.bincount(feature, gf[owner], len(w)) + shrink * w])


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def tails(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of each document."""
        return _sigmoid(sums(self.weights, x, at)[:, None] - self.thresholds)

    @staticmethod
    def fit(x: np.ndarray, at: np.ndarray, grade: np.ndarray, n_grades: int, rounds: int = 120, rate: float = 0.05, shrink: float = 2e-3, min_docs: int = 8) -> OrdinalModel:
        """Maximum likelihood with an L2 penalty; features of fewer than min_docs documents have no weight. Without rows, or with one grade only, all grades are equally likely or nearly certain."""
        dims, n = 1 << BITS, len(grade)
        if n == 0:
            return OrdinalModel(np.zeros(dims), np.log((np.arange(1, n_grades)) / (n_grades - np.arange(1, n_grades))))
        below = np.array([(np.sum(grade < k) + 0.5) / (n + 1) for k in range(1, n_grades)])
        first = np.log(below / (1 - below))
        gaps = np.log(np.maximum(np.diff(first), 1e-2))
        owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(at))
        often = np.bincount(x, minlength=dims)[x] >= min_docs
        used, xi = np.unique(x[often], return_inverse=True)
        owner, xi, k = owner[often], xi.astype(np.int32), n_grades - 1
        del often

        p = descend(lambda p: ordinal_gradient(p, k, grade, owner, xi, shrink), np.concatenate([[first[0]], gaps, np.zeros(len(used))]), rounds, rate)
        weights = np.zeros(dims)
        weights[used] = p[k:]
        return OrdinalModel(weights, _cuts(p, k))


def quality_scores(df: DataFrame, ratings: DataFrame, n_grades: int, accept: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", least: float = 0.5, sample: int = 8000) -> DataFrame:
    """All rows and columns of df with expected_grade, tail_probability (of reaching grade `accept`) and kept (it is `least` at least).

    ratings has id_col and grade_col (whole numbers from 0 to n_grades - 1). The model is fitted on about `sample` rated
    documents; every document is scored over its whole text, however long. A null text counts as empty and is scored by its shape;
    equal texts get equal scores, repeated rows and ids are scored one by one, and an empty table gives an empty result.
    Ratings with a null id or grade don't take part; a document rated twice takes part twice. Without ratings all
    grades are equally likely. Columns of df with the names of the new ones are replaced.
    """
    new = ("expected_grade", "tail_probability", "kept")
    names = [c for c in df.columns if c not in new]
    plain, places, fields = by_place(df, names)
    text_place = places[names.index(text_col)]
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rated = ratings.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{grade_col}`").cast("int").alias("grade")).filter(F.col("grade").between(0, n_grades - 1))
    x, at, grade = labelled_sample(docs, rated, "grade", sample, quality_features)
    model = df.sparkSession.sparkContext.broadcast(OrdinalModel.fit(x, at, grade.astype(np.int64), n_grades))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offsets in slices(batches, text_place):
            tails = model.value.tails(*quality_features(data, offsets))
            tail = tails[:, accept - 1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= least)], [*places, *new])

    return plain.mapInArrow(run, f"{fields}, expected_grade double, tail_probability double, kept boolean").toDF(*names, *new)
