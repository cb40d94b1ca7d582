import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_operators import make_obs
from tidemark.operators import evaluate, history, maintenance, models, pairs
from tidemark.sources import tables


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_increment_gives_what_the_dataset_lacks(spark):
    obs, _ = make_obs(spark, seed=51, n=80, entities=15, undated=3)
    specs = [s for s in history.career_specs() if s.name in ("contests", "wins", "attempts_sum")]
    names = [s.name for s in specs]
    full = pairs.mirrored(pairs.pair_rows(history.snapshots(obs, specs), names))
    cut = F.lit(dt.date(2020, 2, 10))
    old = full.filter(F.col("event_day") < cut).withColumn("odds", F.lit(1.5))
    delta = pairs.increment(old, obs, specs, names)
    assert delta.dtypes == old.dtypes
    assert rows_of(delta.drop("odds")) == rows_of(full.filter((F.col("event_day") >= cut) | F.col("event_day").isNull()).select(*[c for c in old.columns if c != "odds"]))
    assert delta.filter("odds is not null").count() == 0
    assert pairs.increment(delta.unionByName(old), obs, specs, names).count() == 0


def test_bundle_members(spark):
    found = spark.createDataFrame([("/x/a.txt", 3, "aa"), ("/x/b.txt", 4, "bb"), ("/x/c.txt", 5, "cc"), ("/x/e.txt", 6, "ee")], "path string, bytes bigint, sha256 string")
    manifest = spark.createDataFrame([("a.txt", 3, "aa"), ("b.txt", 9, "bb"), ("c.txt", 5, "xx"), ("d.txt", 1, "dd")], "name string, bytes bigint, sha256 string")
    assert {(r.name, r.status) for r in tables.bundle_members(found, manifest).collect()} == {("a.txt", "ok"), ("b.txt", "size"), ("c.txt", "digest"), ("d.txt", "missing"), ("e.txt", "unlisted")}


def test_group_spells(spark):
    obs, rows = make_obs(spark, seed=52, n=60, entities=7, undated=4)
    got = {}
    for r in history.group_spells(obs).collect():
        got.setdefault(r.entity_id, []).append((r.place, r.grp, r.since, r.until, r.contests))
    for e in range(7):
        want = []
        for r in sorted((r for r in rows if r[3] == e and r[1]), key=lambda r: (r[1], r[0])):
            if want and want[-1][1] == r[2]:
                want[-1] = (*want[-1][:3], r[1], want[-1][4] + 1)
            else:
                want.append((len(want) + 1, r[2], r[1], r[1], 1))
        assert sorted(got.get(e, [])) == want


def test_gradient_is_flat_at_the_fit_only(spark):
    rows = [(i, float(i % 7), float((i * 5) % 11), int((i % 7) + (i * 3) % 5 > 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "contest_id int, a double, b double, label int")
    model = models.fit(df, "logistic", ["a", "b"])
    assert max(abs(r.gradient) for r in models.logistic_gradient(model, df).collect()) < 1e-5
    assert max(abs(r.gradient) for r in models.logistic_gradient(model, df.filter("a > 1")).collect()) > 1e-3


def test_retrospective_is_made_of_its_parts(spark):
    rows = [(i, dt.date(2020, 1, 1) + dt.timedelta(days=i % 40), i % 2 if i % 9 else None, (i % 10) / 10, 0.5) for i in range(200)]
    cases = spark.createDataFrame(rows, "contest_id int, event_day date, label int, m double, half double")
    got = {(r.model, r.part, r.section, r["item"]): r.value for r in evaluate.retrospective(cases, ["m", "half"], {"early": "2020-01-20", "late": ""}, "p", replicates=20).collect()}
    own = [(p, y) for _, d, y, p, _ in rows if y is not None and d >= dt.date(2020, 1, 20)]
    assert got["m", "late", "metrics", "brier"] == pytest.approx(sum((p - y) ** 2 for p, y in own) / len(own)) == got["m", "late", "interval", "mean"]
    assert got["half", "late", "metrics", "auc"] == 0.5 and got[None, "late", "protocol", "contests"] == len(own)
    assert got["m", "early", "interval", "low"] <= got["m", "early", "interval", "mean"] <= got["m", "early", "interval", "high"]
    assert sum(k[2] == "calibration" and k[0] == "half" for k in got) == 2


def test_recovery_by_the_journals_states(spark):
    rows = [("a", 1, "staging", True), ("a", 9, "committed", False), ("b", 2, "committing", False), ("c", 3, "committing", True), ("d", 4, "committed", False), ("e", 5, "staging", None), ("e", 6, "rolled_back", False), ("f", 7, "recovery_required", None), ("g", 8, "?", False)]
    got = {r.transaction: r.action for r in maintenance.recovery_actions(spark.createDataFrame(rows, "transaction string, at int, status string, alive boolean")).collect()}
    assert got == {"a": "may_restore", "b": "restore", "c": "refuse", "d": "keep", "e": "none", "f": "restore", "g": "unknown"}
    assert maintenance.recovery_actions(spark.createDataFrame([], "transaction string, at int, status string, alive boolean")).count() == 0


def test_sealed_reports(spark):
    report = maintenance.sealed(spark.createDataFrame([("n", 5.0), ("share", 0.4), ("share", None)], "item string, value double"))
    faults = lambda df, **b: sorted((r["item"], r.fault) for r in maintenance.seal_faults(df, b).collect())
    assert faults(report, n=(0, None)) == [] and faults(report) == []
    assert faults(report, share=(0, 1), n=(None, 4)) == [("n", "bounds"), ("share", "bounds")]
    assert faults(report.filter("value is not null")) == [("n", "integrity"), ("share", "integrity")]
