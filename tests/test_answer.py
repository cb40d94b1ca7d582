"""The whole answer against brute force over the rows, and as a document."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from test_operators import brute_ratings, make_obs
from tidemark.operators import answer, history, ratings


def test_whole_answers_equal_brute_force(spark):
    obs, rows = make_obs(spark, seed=41, n=90, entities=14, undated=4)
    asked = [(1, 3, 5, dt.date(2020, 2, 20), "x", "+150", "-170"), (2, 0, 99, dt.date(2020, 1, 20), "y", "2.1", None), (3, 7, 8, dt.date(2019, 1, 1), "x", None, None), (4, 3, 5, dt.date(2020, 1, 9), "x", "1.9", "1.9"), (5, 2, 4, None, "x", None, None)]
    q = spark.createDataFrame(asked, "request_id int, entity_a bigint, entity_b bigint, event_day date, grp string, odds_a string, odds_b string")
    got = {r.request_id: r for r in answer.whole_answers(obs, q).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[5].contests_a is None and got[3].contests_a == 0
    final = {}
    for i, a, b, day, grp, _, _ in asked[:4]:
        g = got[i]
        for s, e in (("a", a), ("b", b)):
            old = [x for x in rows if x[3] == e and x[1] is not None and x[1] < day]
            assert (g[f"contests_{s}"], g[f"wins_{s}"], g[f"in_group_{s}"]) == (len(old), sum(x[9] == 1 for x in old), sum(x[2] == grp for x in old))
            rated = {}
            for x in sorted((x for x in rows if x[3] < x[4] and x[1] is not None and x[1] < day and x[9] is not None), key=lambda x: (x[1], x[0])):
                ra, rb = rated.get(x[3], 1500.0), rated.get(x[4], 1500.0)
                gain = 32 * (x[9] - 1 / (1 + 10 ** ((rb - ra) / 400)))
                rated[x[3]], rated[x[4]] = ra + gain, rb - gain
            assert g[f"rating_{s}"] == (pytest.approx(rated[e]) if e in rated else None)
            final[i, s] = rated.get(e, 1500.0)
        p = 0.5 + 0.9 * (1 / (1 + 10 ** ((final[i, "b"] - final[i, "a"]) / 400)) - 0.5)
        assert g.probability_a == pytest.approx(p) and g.pick == (a if p > 0.5 else b if p < 0.5 else None)
    assert got[1].market_a == pytest.approx((1 / 2.5) / (1 / 2.5 + 170 / 270)) and got[2].market_a is None and got[2].edge_reading == "no_market"
    assert got[3].reliability_score == 100 - 2 * (15 + 10 + 20) and got[3].reliability == "Low" and "no_rating_a" in got[3].reliability_reasons


def test_answers_of_the_same_entities_do_not_see_one_another(spark):
    obs, _ = make_obs(spark, seed=42, n=60, entities=5)
    rows = [(i, 1, 2, dt.date(2020, 3, 1) + dt.timedelta(days=i), "x", None, None) for i in range(4)]
    q = spark.createDataFrame(rows, "request_id int, entity_a bigint, entity_b bigint, event_day date, grp string, odds_a string, odds_b string")
    got = answer.whole_answers(obs, q).collect()
    assert len({(r.contests_a, r.wins_b, r.probability_a) for r in got}) == 1
    doc = json.loads(answer.as_documents(answer.whole_answers(obs, q)).filter("request_id = 2").first().answer)
    assert doc["sides"]["a"]["entity"] == 1 and doc["market"]["market_a"] is None and set(doc) == {"request", "sides", "differences", "forecast", "market", "reliability"}


def test_ratings_after_are_the_next_snapshots(spark):
    obs, rows = make_obs(spark, seed=43, n=70, entities=9)
    seen = ratings.rating_snapshots(obs, by_group=False, frozen=False)
    after = {(r.contest_id, r.entity_id): r.rating for r in answer.ratings_after(seen, ratings.decisive_pairs(obs)).collect()}
    before = brute_ratings(rows, False, False, False)
    for e in range(9):
        own = sorted({(x[1], x[0]) for x in rows if x[3] == e and x[9] is not None})
        for (_, c), (_, n) in zip(own, own[1:], strict=False):
            x = next(x for x in rows if x[0] == n and x[3] == e)
            assert after[c, e] == pytest.approx(before[n][0 if e < x[4] else 1])
    assert history.as_of(obs, history.career_specs(), F.lit(dt.date(2020, 2, 1))).count() > 0
