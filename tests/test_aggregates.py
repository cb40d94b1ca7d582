import datetime as dt

from pyspark.sql import functions as F
from tidemark.operators import aggregates, compare
from tidemark.operators.capture import import_classes, retain_newest


def test_pooled_ratios_leave_rows_out_and_count_them(spark):
    df = spark.createDataFrame([("a", 3.0, 4.0), ("a", None, 9.0), ("a", 1.0, -1.0), ("b", None, None)], "k string, n double, d double")
    got = {r.k: (r.value, r.eligible, r.missing) for r in aggregates.pooled_ratios(df, ["k"], [("m", "n", "d", 2.0)]).collect()}
    assert got == {"a": (1.5, 1, 2), "b": (None, 0, 1)}


def test_weighted_mean(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0), (9.0, 0.0), (None, 2.0), (4.0, None)], "v double, w double")
    assert df.agg(aggregates.weighted_mean(F.col("v"), F.col("w")).alias("x")).first().x == 2.5


def test_method_mix_is_all_or_nothing(spark):
    d = lambda i: dt.date(2020, 1, i)
    df = spark.createDataFrame([(1, d(1), 1, 1, "KO"), (1, d(2), 2, 1, None), (1, d(3), 3, 0, "SUB"), (2, d(1), 4, 1, "KO"), (2, d(2), 5, 0, "DEC"), (2, d(3), 6, 1, "x")], "entity_id int, event_day date, contest_id int, won int, method string")
    got = {r.contest_id: (r.knockout_share, r.finish_loss_rate) for r in aggregates.method_mix(df).collect()}
    assert got == {1: (None, None), 2: (1.0, None), 3: (None, None), 4: (None, None), 5: (1.0, None), 6: (1.0, 0.0)}


def test_hash_sample_is_stable(spark):
    df = spark.range(100)
    a, b = ({r.id for r in aggregates.hash_sample(df.repartition(n), "id", 10).collect()} for n in (1, 7))
    assert a == b and len(a) == 10


def test_observations_keep_the_order_of_rules(spark):
    df = spark.createDataFrame([(1, 5)], "contest_id int, x int")
    rules = [("r1", F.col("x") > 9, "no"), ("r2", F.col("x") > 1, "b"), ("r3", F.col("x") > 2, "c"), ("r4", F.col("x") > 3, "d")]
    assert [(r.place, r.rule) for r in aggregates.observations_of(df, rules, 2).collect()] == [(0, "r2"), (1, "r3")]


def test_parity(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 1.0)], "k int, x double, y double")
    b = spark.createDataFrame([(1, 1.0, None), (2, 2.5, None)], "k int, x double, y double")
    assert {(r.feature, r.mismatches, r.status) for r in aggregates.parity(a, b, ["k"], ["x", "y"]).collect()} == {("x", 1, "PARTIAL"), ("y", 1, "PARTIAL")}


def test_report_comparison_needs_equal_versions(spark):
    o = spark.createDataFrame([("a", 1.0, "v1", "u"), ("b", 1.0, "v1", "u"), ("c", 1.0, "v1", "u"), ("d", 1.0, None, "u")], "metric string, value double, version string, unit string")
    n = spark.createDataFrame([("a", 2.0, "v1", "u"), ("b", 2.0, "v2", "u"), ("e", 1.0, "v1", "u"), ("d", 1.0, None, "u")], o.schema)
    got = {r.metric: (r.status, r.delta) for r in compare.compare_reports(o, n).collect()}
    assert got == {"a": ("changed", 1.0), "b": ("not_comparable", None), "c": ("removed", None), "d": ("same", 0.0), "e": ("added", None)}


def test_import_classes_and_retention(spark):
    have = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    new = spark.createDataFrame([(1, "x"), (2, "z"), (3, "w"), (4, None)], "k int, v string")
    assert {r.k: r["class"] for r in import_classes(have, new, "k", ["v"], F.col("v").isNotNull()).collect()} == {1: "duplicate", 2: "conflict", 3: "new", 4: "invalid"}
    sized = spark.createDataFrame([(i, 10.0) for i in range(9)], "k int, s double")
    assert sorted(r.k for r in retain_newest(sized, [F.desc("k")], "s", 5, 35.0).collect()) == [6, 7, 8]
