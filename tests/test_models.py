import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F
from tidemark.operators import evaluate, models


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(0)
    out = []
    for i in range(600):
        x, z = rng.gauss(0, 1), rng.gauss(0, 1)
        y = int(rng.random() < 1 / (1 + math.exp(-(2 * x - 0.5 * z))))
        out.append((i, dt.date(2020, 1, 1) + dt.timedelta(days=i // 6), x if i % 50 else None, z, "ab"[i % 2] if i % 40 else None, y if i % 30 else None))
    return spark.createDataFrame(out, "contest_id int, event_day date, x_diff double, z_diff double, kind string, label int").cache()


def test_preprocessor_uses_interpolated_medians_and_population_deviation(spark):
    df = spark.createDataFrame([(1.0, "u"), (2.0, "v"), (3.0, "v"), (10.0, None), (None, "v")], "x_diff double, kind string")
    p = models.Preprocessor(["x_diff"], ["kind"]).fit(df)
    assert p.fill == {"x_diff": 2.5} and p.mode == {"kind": "v"}
    values = [1.0, 2.0, 3.0, 10.0, 2.5]
    mean = sum(values) / 5
    assert p.scale["x_diff"] == pytest.approx((mean, math.sqrt(sum((v - mean) ** 2 for v in values) / 5)))


@pytest.mark.parametrize("kind", ["logistic", "boosted"])
def test_models_learn(rows, kind):
    m = models.fit(rows, kind, ["x_diff", "z_diff"], ["kind"], c=10.0)
    got = evaluate.metrics(m.score(rows)).first()
    assert got.n == 580 and got.auc > 0.85 and got.log_loss < 0.6


def test_calibration_and_symmetry(rows):
    m = models.fit_calibrated(rows, "logistic", ["x_diff", "z_diff"])
    assert m.calibration is not None and m.calibration[0] > 0
    both = models.score_both_ways(m, rows)
    assert both.filter("probability is null or probability < 0 or probability > 1").count() == 0
    assert evaluate.metrics(both).first().auc > 0.85


def test_ensemble_weights_follow_losses(rows):
    e = models.fit_ensemble(rows, ["logistic", "boosted"], ["x_diff", "z_diff"])
    assert set(e.weights) == {"logistic", "boosted"} and all(w > 0 for w in e.weights.values())
    assert evaluate.metrics(e.score(rows)).first().auc > 0.85


def test_safe_features(rows):
    df = rows.withColumn("result_diff", F.lit(1.0)).withColumn("name_diff", F.lit("x"))
    assert models.safe_features(df) == ["x_diff", "z_diff"]
