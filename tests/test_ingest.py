import datetime as dt

import pytest
from pyspark.sql import functions as F
from tidemark.operators import ingest, names
from tidemark.operators.contracts import ContractError

SCHEMA = "contest_id bigint, event_day date, entity_id bigint, opponent_id bigint, attempts double, successes double, seconds double, result string, won int"


def rows(*items):
    return [(c, dt.date(2020, 1, d), a, b, t, s, 60.0, r, w) for c, d, a, b, t, s, r, w in items]


def test_audit_and_quarantine(spark):
    df = spark.createDataFrame(rows((1, 1, 1, 2, 5.0, 3.0, "win", 1), (1, 1, 2, 1, 1.0, 3.0, "loss", 1), (2, 9, 1, 1, 1.0, 1.0, "odd", None)), SCHEMA)
    audited = ingest.audit(df, ingest.observation_rules(F.lit("2020-01-05").cast("date")))
    good, bad = ingest.quarantine(audited)
    assert good.count() == 1 and good.columns == df.columns
    assert {(r.code, r.rows) for r in ingest.audit_summary(bad).collect()} == {("label_differs", 1), ("more_successes", 1), ("same_sides", 1), ("future_day", 1), ("unknown_result", 1)}


def test_range_comes_before_the_limit(spark):
    e = spark.createDataFrame([(i, dt.date(2020, 1, i)) for i in range(1, 11)], "event_id int, event_day date")
    got = ingest.select_days(e, F.lit("2020-01-03").cast("date"), F.lit("2020-01-06").cast("date"), 2)
    assert [r.event_id for r in got.collect()] == [3, 4]


def test_cutoffs():
    day = dt.date(2020, 1, 5)
    assert ingest.training_cutoff(day, dt.date(2020, 1, 2)) == dt.date(2020, 1, 2)
    assert ingest.training_cutoff(day, dt.date(2020, 2, 2)) == dt.date(2020, 1, 4)
    with pytest.raises(ContractError):
        ingest.training_cutoff(day, day, day)


def test_learnable_refuses_later_rows(spark):
    df = spark.createDataFrame([(i, dt.date(2020, 1, 1 + i % 9), i % 2) for i in range(40)], "contest_id int, event_day date, label int")
    cut = F.lit("2020-01-05").cast("date")
    with pytest.raises(ContractError):
        ingest.learnable(df, cut, least_rows=1, least_contests=1)
    with pytest.raises(ContractError):
        ingest.learnable(df, cut, allow_later=True)
    assert ingest.learnable(df, cut, least_rows=1, least_contests=1, allow_later=True).filter(F.col("event_day") > cut).count() == 0


def test_correction_rebuilds_from_the_first_changed_day(spark):
    old = spark.createDataFrame(rows((1, 1, 1, 2, 5.0, 3.0, "win", 1), (1, 1, 2, 1, 4.0, 1.0, "loss", 0), (2, 3, 1, 2, 2.0, 1.0, "draw", None), (2, 3, 2, 1, 2.0, 2.0, "draw", None)), SCHEMA)
    new = spark.createDataFrame(rows((2, 3, 1, 2, 9.0, 1.0, "draw", None), (2, 3, 2, 1, 2.0, 2.0, "draw", None)), SCHEMA)
    derive = lambda o: o.select("contest_id", "entity_id", "event_day", (F.col("attempts") * 10).alias("x"))
    marked = derive(old).withColumn("x", F.col("x") + 1)
    fresh, derived = ingest.apply_correction(old, new, ["attempts", "result"], marked, derive)
    assert {(r.contest_id, r.entity_id, r.x) for r in derived.collect()} == {(1, 1, 51.0), (1, 2, 41.0), (2, 1, 90.0), (2, 2, 20.0)}
    assert fresh.count() == 4
    with pytest.raises(ContractError):
        ingest.preview_correction(old, new.filter("entity_id = 1"), ["attempts"])
    same, kept = ingest.apply_correction(old, old.filter("contest_id = 2"), ["attempts"], marked, derive)
    assert same is old and kept is marked


def test_resolve_tokens(spark):
    catalog = spark.createDataFrame([("Ana Maria Lopez",), ("Ana Lopez",), ("Bo Lee",), ("Cy Young Jr",)], "name string")
    asked = spark.createDataFrame([("ana lopez",), ("maria",), ("cy young sr",), ("zed",), ("Ana",)], "name string")
    got = {r.name: (r.canonical, r.how) for r in names.resolve_tokens(asked, catalog).collect()}
    assert got == {"ana lopez": ("Ana Lopez", "equal"), "maria": ("Ana Maria Lopez", "holds"), "cy young sr": ("Cy Young Jr", "overlap"), "zed": (None, "unresolved"), "Ana": (None, "unresolved")}
