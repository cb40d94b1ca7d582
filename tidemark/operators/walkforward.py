"""Walk-forward evaluation: logistic fits for all folds at once, forecasts before outcomes, scores by fold.

A fold trains on all rows before its day. Each Newton step is one pass over the training rows for all folds together: a task adds up gradients and
Hessians of every fold that a row belongs to, and only these sums, some p * (p + 1) numbers for each fold, are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Steps


def fit_folds(rows: DataFrame, features: Sequence[str], days: Sequence[date], label: str = "label", day: str = "event_day", ridge: float = 1e-3, most_steps: int = 25, tolerance: float = 1e-10, steps: Steps | None = None) -> DataFrame:
    """(fold, from_day, feature, weight): for each day in `days` the logistic weights of rows before it, without intercept, with a penalty of ridge / 2 times their squares.

    The likelihood is a sum over rows, so the penalty weighs less as rows grow. Rows without a day, label or feature take no part; a fold without rows has zero weights.
    A step that would raise the loss doesn't occur for a penalised logistic fit near its optimum; fits stop when no weight moves by more than the tolerance.
    """
    spark = rows.sparkSession
    steps = steps or Steps(spark, "walkforward")
    cuts, p = sorted(set(days)), len(features)
    x = rows.select(F.datediff(day, F.lit("1970-01-01").cast("date")).alias("day"), F.col(label).cast("double").alias("y"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]).dropna()
    x = steps.write(x.filter(F.col("day") < F.lit((max(cuts) - date(1970, 1, 1)).days))) if cuts else x
    first = np.array([(c - date(1970, 1, 1)).days for c in cuts], np.int64)
    beta = np.zeros((len(cuts), p))

    def sums(batches: Iterator[pa.RecordBatch], beta: np.ndarray) -> Iterator[pa.RecordBatch]:
        grad, hess = np.zeros((len(first), p)), np.zeros((len(first), p, p))
        for b in batches:
            d, y = b.column("day").to_numpy(), b.column("y").to_numpy()
            m = np.column_stack([b.column(f"x{i}").to_numpy() for i in range(p)])
            order = np.argsort(d, kind="stable")
            d, y, m = d[order], y[order], m[order]
            for f, n in enumerate(np.searchsorted(d, first)):
                if n:
                    q = 1 / (1 + np.exp(-np.clip(m[:n] @ beta[f], -500, 500)))
                    grad[f] += m[:n].T @ (y[:n] - q)
                    hess[f] += (m[:n] * (q * (1 - q))[:, None]).T @ m[:n]
        flat = np.concatenate([grad, hess.reshape(len(first), -1)], axis=1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "value"])

    for _ in range(most_steps if cuts else 0):
        found = x.mapInArrow(lambda batches, beta=beta: sums(batches, beta), "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()  # folds * p * (p + 1) numbers
        flat = np.zeros(len(cuts) * p * (p + 1))
        flat[found.column("at").to_numpy()] = found.column("value").to_numpy()
        flat = flat.reshape(len(cuts), -1)
        grad, hess = flat[:, :p] - ridge * beta, flat[:, p:].reshape(-1, p, p) + ridge * np.eye(p)
        move = np.linalg.solve(hess, grad[:, :, None])[:, :, 0]
        beta = beta + move
        if np.abs(move).max(initial=0) < tolerance:
            break
    out = [(f, c, name, float(beta[f, i])) for f, c in enumerate(cuts) for i, name in enumerate(features)]
    return spark.createDataFrame(out, "fold int, from_day date, feature string, weight double")


def forecasts(rows: DataFrame, weights: DataFrame, features: Sequence[str], key: str = "contest_id", day: str = "event_day") -> DataFrame:
    """(key, day, fold, probability): each row by the fit of the last fold that starts on its day or before. No label is read; rows before the first fold have no forecast.

    A row's fold is the number of first days up to its own; then weights are joined by fold.
    """
    folds = weights.groupBy("fold", "from_day").pivot("feature", list(features)).agg(F.first("weight"))
    starts = F.array(*[F.lit(r.from_day) for r in weights.select("from_day").distinct().collect()]).cast("array<date>")
    fold = F.size(F.filter(starts, lambda s: s <= F.col(day))) - 1
    w = folds.select("fold", *[F.col(f).alias(f"_w_{f}") for f in features])
    score = sum((F.col(f) * F.col(f"_w_{f}") for f in features), F.lit(0.0))
    dealt = rows.select(key, day, *features, fold.alias("fold")).filter("fold >= 0")
    return dealt.join(w, "fold").select(key, day, "fold", (1 / (1 + F.exp(-score))).alias("probability"))


def scored(made: DataFrame, outcomes: DataFrame, key: str = "contest_id", label: str = "label") -> DataFrame:
    """(fold, forecasts, settled, log_loss, brier, accuracy) by fold: written forecasts met by the outcomes that there are."""
    both = made.join(outcomes.select(key, F.col(label).cast("double").alias("y")), key, "left")
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("probability")))
    there = F.col("y").isNotNull()
    return both.groupBy("fold").agg(
        F.count(F.lit(1)).alias("forecasts"),
        F.count("y").alias("settled"),
        F.avg(F.when(there, -(F.col("y") * F.ln(p) + (1 - F.col("y")) * F.ln(1 - p)))).alias("log_loss"),
        F.avg(F.when(there, (F.col("probability") - F.col("y")) ** 2)).alias("brier"),
        F.avg(F.when(there, ((F.col("probability") >= 0.5) == (F.col("y") == 1)).cast("double"))).alias("accuracy"),
    )
