import datetime as dt

import pytest
from pyspark.sql import functions as F
from tidemark.functions import scalars as S
from tidemark.operators import aggregates, evaluate, models, names, pairs


def test_markers_and_periods(spark):
    df = spark.createDataFrame([("W", "", dt.date(2020, 1, 1), False), ("", "W", dt.date(2030, 1, 1), False), ("", "W", dt.date(2020, 1, 1), True)], "a string, b string, d date, k boolean")
    got = [tuple(r.m) for r in df.select(S.inferred_markers(F.col("a"), F.col("b"), F.col("d"), F.lit("2025-01-01").cast("date"), F.col("k")).alias("m")).collect()]
    assert got == [("W", "L", "blank_beside_win"), ("", "W", "future_day"), ("", "W", "known_contest")]
    t = spark.createDataFrame([("5 Rnd (5-5)", 100.0), (None, 1000.0), ("x", 301.0)], "t string, s double")
    assert [tuple(r) for r in t.select(S.planned_periods(F.col("t"), seconds=F.col("s")), S.last_period(F.col("s"))).collect()] == [(5, 1), (5, 4), (None, 2)]


def test_sides_are_attached(spark):
    snap = spark.createDataFrame([(1, 10, 5.0), (1, 11, 6.0)], "contest_id int, entity_id int, x double")
    p = spark.createDataFrame([(1, 11, 10), (2, 10, 11)], "contest_id int, entity_a int, entity_b int")
    assert {(r.contest_id, r.a_x, r.b_x) for r in pairs.attach_sides(p, snap).collect()} == {(1, 6.0, 5.0), (2, None, None)}


def test_fill_absent_keeps_nulls_of_columns_that_exist(spark):
    snap = spark.createDataFrame([(1, None)], "k int, x int")
    back = spark.createDataFrame([(1, 7, 8)], "k int, x int, old_y int")
    assert tuple(names.fill_absent(snap, back, "k", ["x", "y", "z"], {"y": ["old_y"]}).first()) == (1, None, 8, None)


def test_collapse(spark):
    df = spark.createDataFrame([(1, 2.0, "b", 2), (1, 4.0, "a", 1)], "k int, v double, s string, o int")
    assert tuple(aggregates.collapse(df, ["k"], ["o"]).first()) == (1, 3.0, "a", 1.5)


def test_folds_protocols_and_registry(spark):
    df = spark.createDataFrame([(i // 2, dt.date(2020, 1, 1 + i % 20)) for i in range(60)], "contest_id int, event_day date")
    f = evaluate.hash_folds(df, 3)
    assert evaluate.split_overlap(f.filter("fold = 0"), f.filter("fold <> 0")).count() == 0
    a, b = (evaluate.register_protocol(x, {"train": "2020-01-10", "test": ""}, "p").collect() for x in (df, df.repartition(3)))
    assert sorted(map(str, a)) == sorted(map(str, b)) and sum(r.rows for r in a) == 60
    with pytest.raises(ValueError, match="nope"):
        models.FeatureRegistry({"v1": ["contest_id", "nope"]}).select(df, "v1")
