"""View upkeep, state in versions, walk-forward fits and keyed streams against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import make_obs
from tidemark.operators import asof_state, capture, history, upkeep, walkforward
from tidemark.streaming import keyed, ledger, twins


def rows_of(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*[c for c in df.columns if c != "recomputed"]).collect())


def corrected(obs, rows, rng):
    """Values, days and opponents changed; rows of one side and whole contests removed; contests added; an undated row dated and the other way round."""
    out = []
    gone, dated = rng.sample(range(len(rows) // 2), 3), rng.sample(range(len(rows) // 2), 3)
    for r in rows:
        r = list(r)
        if r[0] in gone[:2] or (r[0] == gone[2] and r[3] < r[4]):
            continue
        if r[0] in dated:
            r[1] = None if r[0] == dated[0] else dt.date(2020, 2, 20)
        if rng.random() < 0.03:
            r[5] += 1
        if rng.random() < 0.03:
            r[9] = 1
        out.append(tuple(r))
    for c in (900, 901):
        day = dt.date(2020, 2, 25)
        out += [(c, day, "x", 3, 77, 2.0, 1.0, 60.0, "win", 1), (c, day, "x", 77, 3, 1.0, 1.0, 60.0, "loss", 0)]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_upkeep_equals_computing_all(spark, seed):
    obs, rows = make_obs(spark, seed=seed, n=140, entities=45, undated=6)
    new = spark.createDataFrame(corrected(obs, rows, random.Random(seed)), obs.schema)
    got = upkeep.maintained(upkeep.contest_view(obs), obs, new).cache()
    assert rows_of(got) == rows_of(upkeep.contest_view(new))
    assert got.filter("recomputed").count() > 0


def test_upkeep_recomputes_only_what_reads_the_change(spark):
    obs, rows = make_obs(spark, seed=9, n=140, entities=45)
    last = max(r[1] for r in rows)
    late = [r for r in rows if r[1] == last]
    new = spark.createDataFrame([(*r[:5], r[5] + 1, *r[6:]) if r[1] == last else r for r in rows], obs.schema)
    got = upkeep.maintained(upkeep.contest_view(obs), obs, new).cache()
    assert got.filter("recomputed").count() == len(late)  # nothing comes after the last day
    assert rows_of(got) == rows_of(upkeep.contest_view(new))
    same = upkeep.maintained(upkeep.contest_view(obs), obs, obs)
    assert same.filter("recomputed").count() == 0 and rows_of(same) == rows_of(upkeep.contest_view(obs))


def test_state_in_versions_equals_as_of(spark):
    obs, rows = make_obs(spark, seed=4, n=150, entities=12, undated=4)
    specs = [s for s in history.career_specs() if s.name in ("contests", "wins", "attempts_sum", "last_day", "last_win_day")]
    state = asof_state.AsOfState.build(obs, specs, 13)
    days = [dt.date(2020, 2, 29), dt.date(2019, 1, 1), dt.date(2020, 1, 30), dt.date(2020, 1, 30), dt.date(2025, 5, 5), dt.date(2020, 1, 1), dt.date(2020, 2, 11)]
    asked = spark.createDataFrame([(e, d) for d in days for e in (*range(12), 99)] + [(None, days[0]), (3, None)], "entity_id bigint, event_day date")
    got = state.lookup(asked).collect()
    assert len(got) == 13 * 7 + 2
    for d in set(days):
        want = {r.entity_id: (r.contests, r.wins, r.attempts_sum, r.last_day, r.last_win_day) for r in history.as_of(obs, specs, F.lit(d)).collect()}
        mine = {r.entity_id: (r.contests, r.wins, r.attempts_sum, r.last_day, r.last_win_day) for r in got if r.event_day == d and r.entity_id is not None}
        assert mine == {e: want.get(e, (0, 0, 0, None, None)) for e in (*range(12), 99)}
        assert {r.entity_id: (r.contests, r.wins, r.attempts_sum, r.last_day, r.last_win_day) for r in state.at(d.isoformat()).collect()} == want
    longest = max(sum(r[3] == e and r[1] is not None and (r[1] - dt.date(1970, 1, 1)).days // 13 == b for r in rows) for e in range(12) for b in {(r[1] - dt.date(1970, 1, 1)).days // 13 for r in rows if r[1]})
    assert max(r.rows_read for r in got if r.rows_read is not None) <= longest
    with pytest.raises(ValueError, match="state takes"):
        asof_state.AsOfState.build(obs, [history.Spec("m", "avg", F.col("attempts"))], 13)


def test_all_folds_at_once_equal_fits_one_by_one(spark):
    rng = np.random.default_rng(1)
    n = 400
    day = np.sort(rng.integers(0, 200, n))
    x = rng.normal(size=(n, 3))
    y = (rng.random(n) < 1 / (1 + np.exp(-x @ [1.5, -0.5, 0]))).astype(float)
    start = dt.date(2020, 1, 1)
    rows = [(i, start + dt.timedelta(days=int(d)), *map(float, v), None if i % 17 == 0 else float(t)) for i, (d, v, t) in enumerate(zip(day, x, y, strict=True))]
    df = spark.createDataFrame([*rows, (1000, None, 1.0, 1.0, 1.0, 1.0)], "contest_id bigint, event_day date, a double, b double, c double, label double").repartition(5)
    cuts = [start, start + dt.timedelta(days=50), start + dt.timedelta(days=51), start + dt.timedelta(days=150)]
    weights = walkforward.fit_folds(df, ["a", "b", "c"], cuts, ridge=0.5)
    got = {(r.fold, r.feature): r.weight for r in weights.collect()}
    known = np.array([i % 17 != 0 for i in range(n)])
    fits = []
    for f, c in enumerate(cuts):
        own = known & (day < (c - start).days)
        beta = np.zeros(3)
        for _ in range(60):
            q = 1 / (1 + np.exp(-x[own] @ beta))
            h = (x[own] * (q * (1 - q))[:, None]).T @ x[own] + 0.5 * np.eye(3)
            beta = beta + np.linalg.solve(h, x[own].T @ (y[own] - q) - 0.5 * beta)
        fits.append(beta)
        assert np.allclose([got[f, k] for k in "abc"], beta, atol=1e-8)
    made = {r.contest_id: (r.fold, r.probability) for r in walkforward.forecasts(df.drop("label"), weights, ["a", "b", "c"]).collect()}
    for i, d in enumerate(day):
        f = sum((c - start).days <= d for c in cuts) - 1
        assert made[i][0] == f and abs(made[i][1] - 1 / (1 + np.exp(-x[i] @ fits[f]))) < 1e-8
    late = walkforward.forecasts(df, weights.filter("fold > 1"), ["a", "b", "c"])
    assert late.filter(F.col("event_day") < F.lit(cuts[2])).count() == 0
    got = {r.fold: r for r in walkforward.scored(walkforward.forecasts(df.drop("label"), weights, ["a", "b", "c"]), df).collect()}
    assert sum(r.forecasts for r in got.values()) == n and sum(r.settled for r in got.values()) == known.sum()


SCHEMA = "event_id bigint, ts timestamp, user_id bigint, value double"


def put(spark, path, name, items):
    rows = [(i, dt.datetime(2024, 1, d, h), u, v) for i, d, h, u, v in items]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in/{name}")


def live(spark, path):
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{path}/in")


def test_keyed_history_closes_days_by_timers_and_goes_on(spark, tmp_path):
    path = str(tmp_path)
    put(spark, path, "a", [(1, 1, 5, 7, 2.0), (2, 1, 3, 7, 3.0), (3, 2, 1, 7, 1.0), (8, 4, 1, 7, 1.0)])
    first = keyed.run_keyed(keyed.keyed_history(live(spark, path)), path)
    assert first["late_rows"] == 0 and spark.read.parquet(f"{path}/table").count() == 3  # the 4th is open
    put(spark, path, "b", [(4, 4, 9, 7, 4.0), (5, 1, 9, 7, 9.0), (6, 5, 1, 7, None), (7, 7, 1, 8, 1.0)])
    second = keyed.run_keyed(keyed.keyed_history(live(spark, path)), path)
    assert second["late_rows"] == 1  # event 5: its day is closed
    got = {(r.event_id, r.events_before, r.value_before) for r in spark.read.parquet(f"{path}/table").collect()}
    assert got == {(1, 0, 0.0), (2, 0, 0.0), (3, 2, 5.0), (8, 3, 6.0), (4, 3, 6.0), (6, 5, 11.0)}


def test_keyed_history_forgets_idle_keys(spark, tmp_path):
    path = str(tmp_path)
    run = lambda: keyed.run_keyed(keyed.keyed_history(live(spark, path), idle_days=3), path)
    put(spark, path, "a", [(1, 1, 5, 7, 2.0), (2, 3, 5, 7, 2.0), (3, 12, 1, 8, 1.0)])
    run()
    put(spark, path, "b", [(4, 13, 5, 7, 2.0), (5, 13, 5, 8, 1.0), (6, 20, 5, 9, 1.0)])
    last = run()
    got = {(r.event_id, r.events_before) for r in spark.read.parquet(f"{path}/table").collect()}
    assert got == {(1, 0), (2, 1), (3, 0), (4, 0), (5, 1)}  # of 7, days 1 and 3 are forgotten by day 13
    assert last["state_rows"] <= 6


def test_ledger_batches_are_written_once(spark, tmp_path):
    path, payload = str(tmp_path / "l"), ["v"]
    step = ledger.ledger_batches(path, "k", "n", payload)
    df = lambda rows: spark.createDataFrame(rows, "k int, n bigint, v string")
    step(df([(1, 1, "a"), (1, 2, "b"), (2, 1, "x"), (1, 2, "b")]), 0)
    again = df([(1, 2, "b"), (1, 3, "c"), (2, 5, "y"), (3, 1, "z")])
    step(again, 1)
    step(again, 1)  # replayed
    whole = spark.read.parquet(f"{path}/rows").drop("batch")
    want = capture.chained(df([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "x"), (2, 5, "y"), (3, 1, "z")]), "k", "n", payload)
    assert rows_of(whole.select(*want.columns)) == rows_of(want)
    assert capture.broken_links(whole, "k", "n", payload).count() == 0
    assert [tuple(r) for r in spark.read.parquet(f"{path}/skipped/batch=1").collect()] == [(1, 2, "b")]
    assert {r.k: r.firsts for r in ledger.chain_lengths(whole, "k").collect()} == {1: 1, 2: 1, 3: 1}
    with pytest.raises(ValueError, match="checkpoint"):
        step(again, 0)


def test_forecasts_are_settled_within_the_interval(spark):
    t = lambda d, h=0: dt.datetime(2024, 1, d, h)
    made = spark.createDataFrame([(1, t(1)), (2, t(1)), (3, t(1)), (4, t(5))], "forecast_id int, made_at timestamp")
    seen = spark.createDataFrame([(1, t(2), 1.0), (2, t(4), 0.0), (3, t(1), 1.0), (4, t(4), 1.0)], "forecast_id int, seen_at timestamp, outcome double")
    assert {r.forecast_id: r.outcome for r in ledger.settled(made, seen).collect()} == {1: 1.0, 2: None, 3: 1.0, 4: None}


def test_sliding_windows(spark):
    e = spark.createDataFrame([(dt.datetime(2024, 1, d), "t", float(d)) for d in (1, 2, 2, 4)], "ts timestamp, event_type string, value double")
    got = {(r.start.day, r.n, r.total) for r in twins.sliding(e).collect()}
    assert got == {(31, 1, 1.0), (1, 3, 5.0), (2, 2, 4.0), (3, 1, 4.0), (4, 1, 4.0)}
