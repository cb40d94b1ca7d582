"""Compiled smoothing against formulas by hand, batched close matches against all pairs, sketches against exact numbers."""

import datetime as dt
import difflib
import random

import pytest
from pyspark.sql import functions as F
from test_operators import make_obs
from tidemark.operators import evaluate, models, names, shrinkage, sketches, smoothing

FAMILIES = [smoothing.Family("acc", "successes", "attempts", 0.45, 120.0, 60.0, 20.0), smoothing.Family("none", "missing", "attempts", 0.5, 30.0, 90.0, 30.0)]


def brute(rows, i):
    """A row's own sums, prior, its source and strength by moments, from rows of earlier days."""
    c, day, grp, e = rows[i][:4]
    old = [r for r in rows if r[1] is not None and r[1] < day and r[5] > 0]
    tot = lambda rs: (sum(r[6] for r in rs), sum(r[5] for r in rs))
    n, d = tot([r for r in old if r[3] == e])
    gn, gd = tot([r for r in old if r[2] == grp])
    an, ad = tot(old)
    prior, src, pd = (gn / gd, "group", gd) if gd >= 60 else (an / ad, "global", ad) if ad > 0 else (0.45, "neutral", 0)
    by = [tot([r for r in old if r[3] == x]) for x in {r[3] for r in old}]
    p = an / ad if ad else None
    strength = 50.0
    if len(by) >= 30 and p and p < 1:
        rest = ad - sum(m * m for _, m in by) / ad - (len(by) - 1)
        if rest > 0:
            rho = ((sum(x * x / m for x, m in by) - ad * p * p) / (p * (1 - p)) - (len(by) - 1)) / rest
            strength = 500.0 if rho <= 0 else 5.0 if rho >= 1 else max(5.0, min(500.0, (1 - rho) / rho))
    return n, d, prior, src, pd, strength


def test_side_features_equal_formulas(spark):
    obs, rows = make_obs(spark, seed=31, n=150, entities=45, undated=5)
    got = {(r.contest_id, r.entity_id): r for r in smoothing.side_features(obs, FAMILIES).collect()}
    assert len(got) == len(rows) and not any("none_" in c for c in next(iter(got.values())).asDict())
    moments = 0
    for i, r in enumerate(rows):
        g = got[r[0], r[3]]
        if r[1] is None:
            assert g.acc_den is None and g.acc_s20 is None and g.acc_prior_source is None
            continue
        n, d, prior, src, pd, strength = brute(rows, i)
        shrunk = lambda k: max(0, min(1, (n + k * prior) / (d + k)))  # noqa: E731, B023
        scaled = max(20.0, min(120.0, 14400 / (d + 120)))
        moments += strength != 50.0
        source = src if d > 0 and src != "neutral" else "prior_only"
        for have, want in ((g.acc_num, n), (g.acc_den, d), (g.acc_prior, prior), (g.acc_prior_den, pd), (g.acc_moments_strength, strength), (g.acc_support_scaled_strength, scaled), (g.acc_s20, shrunk(20)), (g.acc_s50, shrunk(50)), (g.acc_own_strength, shrunk(120)), (g.acc_support_scaled, shrunk(scaled)), (g.acc_moments, shrunk(strength))):
            assert have == pytest.approx(want, abs=1e-9)
        assert (g.acc_prior_source, g.acc_prior_only, g.acc_low_support) == (source, int(source == "prior_only"), int(d < 20))
        assert g.acc_global_prior == (pytest.approx(prior) if source == "global" else None) and g.acc_group_prior == (pytest.approx(prior) if source == "group" else None)
    assert moments > 20


def test_manifest_lists_every_column_and_nothing_else(spark):
    obs, _ = make_obs(spark, seed=32, n=60, entities=20)
    pairs = smoothing.pair_features(smoothing.side_features(obs, FAMILIES), FAMILIES)
    listed = smoothing.manifest(obs, FAMILIES)
    assert sorted(x[0] for x in listed) == sorted(c for c in pairs.columns if c.startswith("acc_"))
    rows = {r.column_name: r for r in smoothing.manifest_rows(pairs, listed).collect()}
    assert rows["acc_s20_diff"].n_known == pairs.count() and rows["acc_prior_source_a"].mean is None
    p = pairs.filter("contest_id = 7").first()
    assert p.acc_s50_diff == pytest.approx(p.acc_s50_a - p.acc_s50_b) and p.acc_support_min == min(p.acc_den_a, p.acc_den_b)


def test_injected_rows_are_those_of_a_contest_of_that_day(spark):
    obs, rows = make_obs(spark, seed=33, n=100, entities=12)
    day = dt.date(2020, 2, 10)
    asked = spark.createDataFrame([(-1, day, "x", 5, 2), (-2, day, "y", 3, 99)], "contest_id bigint, event_day date, grp string, entity_a bigint, entity_b bigint")
    got = {(r.contest_id, r.row_direction): r for r in smoothing.injected(obs, asked, FAMILIES).collect()}
    assert {(k, r.entity_a, r.entity_b) for k, r in got.items()} == {((-1, "a_minus_b"), 5, 2), ((-1, "b_minus_a"), 2, 5), ((-2, "a_minus_b"), 3, 99), ((-2, "b_minus_a"), 99, 3)}
    real = spark.createDataFrame([*rows, (500, day, "x", 5, 2, 0.0, 0.0, 60.0, "draw", None), (500, day, "x", 2, 5, 0.0, 0.0, 60.0, "draw", None)], obs.schema)
    want = smoothing.pair_features(smoothing.side_features(real, FAMILIES), FAMILIES).filter("contest_id = 500").first()  # side a is entity 2
    mine = got[-1, "a_minus_b"]
    for v in smoothing.VARIANTS:
        assert mine[f"acc_{v}_diff"] == pytest.approx(-want[f"acc_{v}_diff"]) and got[-1, "b_minus_a"][f"acc_{v}_diff"] == pytest.approx(want[f"acc_{v}_diff"])
    assert mine.acc_num_a == want.acc_num_b and got[-2, "a_minus_b"].acc_prior_only_b == 1


def test_priors_take_one_expand(spark, capsys):
    obs, _ = make_obs(spark, n=5)
    smoothing.with_priors(obs, FAMILIES[:1]).explain()
    shrinkage.day_totals(obs, "successes", "attempts")[1].explain()
    said = capsys.readouterr().out
    assert said.count("Expand") >= 2 and "CartesianProduct" not in said


@pytest.mark.parametrize("cutoff", [0.45, 0.6, 0.8, 0.95])
def test_close_matches_equal_all_pairs(spark, cutoff):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeé z") for _ in range(rng.randrange(1, 14)))
    catalog = sorted({word().strip() or "q" for _ in range(120)})
    asked = [*(word() for _ in range(15)), "", "  ", catalog[0], catalog[1][::-1], "xyzxyz", None]
    plain = lambda x: spark.range(1).select(names.name_key(F.lit(x)).alias("k")).first().k
    got = {}
    for r in names.close_matches_all(spark.createDataFrame([(a,) for a in asked], "name string"), spark.createDataFrame([(c,) for c in [*catalog, None]], "name string"), cutoff).collect():
        got.setdefault(r.request, []).append((-r.ratio, r.name))
    keys = {x: plain(x) for x in {*catalog, *(a for a in asked if a)}}
    for a in {x for x in asked if x and x.strip()}:
        scores = [(-difflib.SequenceMatcher(None, keys[c], keys[a]).ratio(), c) for c in catalog if keys[c]]
        want = sorted(s for s in scores if -s[0] >= cutoff)[:3]
        assert sorted(got.get(a, [])) == want
    assert not set(got) - {x for x in asked if x and x.strip()}


def test_suggestions_and_fallback(spark):
    catalog = spark.createDataFrame([("José Silva", 1), ("Ann Lee", 3), ("Anna Leeds", 4)], "name string, entity_id int")
    asked = spark.createDataFrame([("jose silva",), ("Ann Le",), ("zzzz",)], "name string")
    got = {r.name: (r.status, r.suggestions) for r in names.resolve_or_suggest(asked, catalog).collect()}
    assert got == {"jose silva": ("resolved", []), "Ann Le": ("not_found", ["Ann Lee", "Anna Leeds"]), "zzzz": ("not_found", [])}
    assert {(r.name, r.how) for r in names.search_or_close(catalog, "lee").collect()} == {("Ann Lee", "holds"), ("Anna Leeds", "holds")}
    assert {(r.name, r.how) for r in names.search_or_close(catalog, "An Lee").collect()} == {("Ann Lee", "close"), ("Anna Leeds", "close")}


def test_sketches_merge_over_windows(spark):
    rng = random.Random(2)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(20)), rng.randrange(600), rng.random()) for _ in range(6000)] + [(None, 1, 1.0), (dt.date(2024, 1, 3), None, None), (dt.date(2024, 1, 3), 5, float("nan"))]
    df = spark.createDataFrame(rows, "day date, user bigint, value double")
    asked = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 4, 15, 15, 30)], "as_of date")
    got = {r.as_of: r for r in sketches.as_of_windows(sketches.daily_sketches(df, "day", "user", "value"), asked, 5, "day", at=(0.1, 0.5)).collect()}
    assert set(got) == {dt.date(2024, 1, 4), dt.date(2024, 1, 15)}
    for day, r in got.items():
        own = [x for x in rows if x[0] and day - dt.timedelta(days=5) <= x[0] < day]
        values = sorted(x[2] for x in own if x[2] is not None and x[2] == x[2])
        assert r.n == len(own) and abs(r["keys"] - len({x[1] for x in own if x[1] is not None})) <= 0.05 * 600
        for q, c in ((0.1, "quantile_0_1"), (0.5, "quantile_0_5")):
            assert abs(sum(v <= r[c] for v in values) / len(values) - q) < 0.02


def test_metrics_of_counts(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0.0, 0.2, 0.5, 0.5000001, 0.9, 1.0]), rng.choice([0, 1, 1, None])) for _ in range(300)] + [(None, 1)]
    got = evaluate.metrics(spark.createDataFrame(rows, "probability double, label int")).first()
    own = [(p, y) for p, y in rows if p is not None and y is not None]
    n = len(own)
    assert got.n == n and got.accuracy == pytest.approx(sum((p >= 0.5) == (y == 1) for p, y in own) / n) and got.brier == pytest.approx(sum((p - y) ** 2 for p, y in own) / n)
    wins = sum((a > b) + 0.5 * (a == b) for a, y in own if y == 1 for b, z in own if z == 0)
    assert got.auc == pytest.approx(wins / (sum(y == 1 for _, y in own) * sum(y == 0 for _, y in own)))
    none = evaluate.metrics(spark.createDataFrame([], "probability double, label int")).first()
    assert none.n == 0 and none.accuracy is None and none.auc is None


def test_both_ways_without_a_join(spark, capsys):
    pairs = spark.createDataFrame([(1, 2.0, 5.0, -3.0, 1), (2, 1.0, 1.0, 0.0, None)], "contest_id int, x_a double, x_b double, x_diff double, label int")
    model = models.Formula(1 / (1 + F.exp(-0.3 * F.col("x_a"))))
    out = models.score_both_ways(model, pairs)
    assert out.columns == [*pairs.columns, "probability"]
    sig = lambda x: 1 / (1 + 2.718281828459045 ** (-0.3 * x))
    assert [(r.x_a, r.x_b, r.x_diff, r.label) for r in out.collect()] == [tuple(r)[1:] for r in pairs.collect()]
    assert out.first().probability == pytest.approx((sig(2) + 1 - sig(5)) / 2)
    out.explain()
    assert "Join" not in capsys.readouterr().out
