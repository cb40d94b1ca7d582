import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from tidemark.functions import scalars as S
from tidemark.operators import aggregates, capture, contracts, evaluate, graph, history, names, pairs, ratings, shrinkage
from tidemark.sources import pages, tables


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [(None, None), ("  ", None), ("2.0", "2"), ("007", "7"), ("-0.50", "-0.5"), ("2020-01-02T00:00:00", "2020-01-02"), (" a   b ", "a b"), ("0", "0"), ("100", "100")],
)
def test_canonical_value(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(S.canonical_value(F.col("t")).alias("x")).first().x == want


def test_parsers(spark):
    df = spark.createDataFrame([("3 of 7", "4:05", "5' 11\"", "75%", "+150"), ("9", "x", None, "0.4", "2.5"), ("---", "1:02:03", "6'", "--", "50")], "a string, b string, c string, d string, e string")
    got = df.select(S.parse_of_pair(F.col("a")).alias("a"), S.clock_seconds(F.col("b")).alias("b"), S.height_cm(F.col("c")).alias("c"), S.parse_percent(F.col("d")).alias("d"), S.decimal_odds(F.col("e")).alias("e")).collect()
    assert [tuple(r.a) for r in got] == [(3, 7), (9, None), (None, None)]
    assert [r.b for r in got] == [245, None, 3723]
    assert [r.c for r in got] == [180.34, None, None]  # feet alone are no height
    assert [r.d for r in got] == [0.75, 0.4, None]
    assert [r.e for r in got] == [2.5, 2.5, 50.0]


def test_pair_text_reverses(spark):
    df = spark.createDataFrame([("a", "b"), (None, " ")], "a string, b string")
    t = S.pair_text(F.col("a"), F.col("b"))
    assert [tuple(r) for r in df.select(t, S.reverse_pair_text(t)).collect()] == [("a_vs_b", "b_vs_a"), ("unknown_vs_unknown", "unknown_vs_unknown")]


def test_outcomes_and_methods(spark):
    df = spark.createDataFrame([("win", "L", "TKO (punch)"), ("D", "draw", "Draw"), ("NC", "no contest", "U-DEC"), ("W", "", "Rear Choke")], "a string, b string, m string")
    a, b = S.outcome_marker(F.col("a")), S.outcome_marker(F.col("b"))
    got = df.select(S.outcome_of_pair(a, b).alias("o"), S.method_class(F.col("m")).alias("m"), S.method_family(F.col("m")).alias("f")).collect()
    assert [tuple(r) for r in got] == [("win_loss", "knockout", "knockout"), ("draw", None, "other"), ("no_contest", "decision", "decision"), ("", "submission", "other")]


def make_obs(spark, seed=1, n=120, entities=6, undated=0):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        a, b = rng.sample(range(entities), 2)
        day = None if c < undated else dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(60))
        kind = rng.choice(["win", "loss", "draw", "no_contest"])
        for e, o, mine in ((a, b, kind), (b, a, {"win": "loss", "loss": "win"}.get(kind, kind))):
            tried = float(rng.randrange(10))
            rows.append((c, day, "xy"[c % 2], e, o, tried, float(rng.randrange(int(tried) + 1)), 60.0, mine, {"win": 1, "loss": 0}.get(mine)))
    return spark.createDataFrame(rows, "contest_id bigint, event_day date, grp string, entity_id bigint, opponent_id bigint, attempts double, successes double, seconds double, result string, won int"), rows


def test_snapshots_and_as_of_agree_with_brute_force(spark):
    obs, rows = make_obs(spark, undated=5)
    got = {(r.contest_id, r.entity_id): r for r in history.snapshots(obs, history.career_specs()).collect()}
    for c, day, _, e, *_ in rows:
        r = got[(c, e)]
        if day is None:
            assert r.contests is None
            continue
        old = [x for x in rows if x[3] == e and x[1] is not None and x[1] < day]
        assert (r.contests, r.wins, r.attempts_sum) == (len(old), sum(x[9] == 1 for x in old), sum(x[5] for x in old))
    cut = dt.date(2020, 2, 1)
    asof = {r.entity_id: r.contests for r in history.as_of(obs, history.career_specs(), F.lit(cut)).collect()}
    assert asof == {e: n for e in range(6) if (n := sum(x[3] == e and x[1] is not None and x[1] < cut for x in rows))}


def test_recent_takes_last_rows_of_earlier_days(spark):
    obs, rows = make_obs(spark, seed=2)
    for r in history.recent(obs, 3, ["attempts"], "last").collect():
        old = sorted((x[1], x[0], x[5]) for x in rows if x[3] == r.entity_id and x[1] < r.event_day)[-3:]
        assert [(x._d, x._t, x.attempts) for x in r["last"]] == old


def test_streaks(spark):
    obs, rows = make_obs(spark, seed=3)
    for r in history.streaks(obs).collect():
        win = loss = 0
        for _, _, kind in sorted((x[1], x[0], x[8]) for x in rows if x[3] == r.entity_id and x[1] < r.event_day):
            if kind != "no_contest":
                win, loss = (win + 1 if kind == "win" else 0), (loss + 1 if kind == "loss" else 0)
        assert (r.win_streak, r.loss_streak) == (win, loss)


def test_as_of_lookup_is_strict_or_not(spark):
    left = spark.createDataFrame([(1, dt.date(2020, 1, 2)), (1, dt.date(2020, 1, 3)), (2, dt.date(2020, 1, 3))], "k int, d date")
    right = spark.createDataFrame([(1, dt.date(2020, 1, 2), "a"), (1, dt.date(2020, 1, 1), "b")], "k int, d date, v string")
    strict = {tuple(r)[:2]: r.v for r in history.as_of_lookup(left, right, "k", "d", "d", ["v"]).collect()}
    loose = {tuple(r)[:2]: r.v for r in history.as_of_lookup(left, right, "k", "d", "d", ["v"], strict=False).collect()}
    assert strict == {(1, dt.date(2020, 1, 2)): "b", (1, dt.date(2020, 1, 3)): "a", (2, dt.date(2020, 1, 3)): None}
    assert loose == {(1, dt.date(2020, 1, 2)): "a", (1, dt.date(2020, 1, 3)): "a", (2, dt.date(2020, 1, 3)): None}


def test_population_moments(spark):
    obs, rows = make_obs(spark, seed=4)
    for r in shrinkage.population_moments(obs, "successes", "attempts").collect():
        totals = {}
        for x in rows:
            if x[1] < r.event_day and x[5] > 0:
                t = totals.setdefault(x[3], [0.0, 0.0])
                t[0], t[1] = t[0] + x[6], t[1] + x[5]
        assert r.entities == len(totals)
        assert abs(r.sum_x2n - sum(a * a / b for a, b in totals.values())) < 1e-6


@pytest.mark.parametrize("frozen", [True, False])
def test_rating_fold(spark, frozen):
    obs, rows = make_obs(spark, seed=5)
    got = {r.contest_id: r for r in ratings.rating_snapshots(obs, by_group=True, frozen=frozen).collect()}
    rating, dawn, day = {}, {}, None
    for x in sorted((x for x in rows if x[3] < x[4]), key=lambda x: (x[1], x[0])):
        c, d, g, a, b, won = x[0], x[1], x[2], x[3], x[4], x[9]
        if d != day:
            day, dawn = d, dict(rating)
        ra, rb = rating.get((g, a), 1500.0), rating.get((g, b), 1500.0)
        seen = [dawn.get((g, e), 1500.0) for e in (a, b)] if frozen else [ra, rb]
        assert abs(got[c].rating_a - seen[0]) < 1e-9 and abs(got[c].rating_b - seen[1]) < 1e-9
        if won is not None:
            gain = 32 * (won - 1 / (1 + 10 ** ((rb - ra) / 400)))
            rating[(g, a)], rating[(g, b)] = ra + gain, rb - gain


def test_mirror_audit_finds_what_is_wrong(spark):
    obs, _ = make_obs(spark, seed=6)
    rows = pairs.mirrored(pairs.pair_rows(history.snapshots(obs, history.career_specs()), ["contests", "wins"]))
    assert pairs.mirror_audit(rows).filter("sign_errors + swap_errors + label_errors > 0").count() == 0
    bad = rows.withColumn("wins_diff", F.when((F.col("contest_id") == 3) & (F.col("row_direction") == "b_minus_a"), 99).otherwise(F.col("wins_diff")))
    assert [r.contest_id for r in pairs.mirror_audit(bad).filter("sign_errors > 0").collect()] == [3]


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "")], "k int, v string")
    assert [tuple(r) for r in contracts.duplicate_keys(df, ["k"]).collect()] == [(1, 2)]
    with pytest.raises(contracts.ContractError):
        contracts.checked_left_join(df, df, ["k"])
    profile = {r.column: r for r in contracts.column_profile(df).collect()}
    assert profile["v"].missing == 1 and profile["k"].distinct == 2
    assert contracts.leaking_features(["wins_diff", "result_diff", "label"]) == ["result_diff", "label"]


def test_diff_upsert_and_ledger(spark):
    old = spark.createDataFrame([(1, "2.0", "x"), (2, "5", "y"), (3, "1", "z")], "k int, a string, b string")
    new = spark.createDataFrame([(1, "2", "x"), (2, "6", "y"), (4, "1", "z")], "k int, a string, b string")
    assert {(r.k, r.change, r.column) for r in capture.keyed_diff(old, new, ["k"], ["a", "b"]).collect()} == {(2, "corrected", "a"), (3, "removed", None), (4, "added", None)}
    assert {(r.k, r.a) for r in capture.upsert(old, new, ["k"]).collect()} == {(1, "2"), (2, "6"), (3, "1"), (4, "1")}
    ledger = capture.chained(old.withColumn("c", F.lit(0)), "c", "k", ["a"])
    assert capture.broken_links(ledger, "c", "k", ["a"]).count() == 0
    forged = ledger.withColumn("a", F.when(F.col("k") == 2, "9").otherwise(F.col("a")))
    assert [(r.k, r.reason) for r in capture.broken_links(forged, "c", "k", ["a"]).collect()] == [(2, "content")]


def test_calibration_edges(spark):
    df = spark.createDataFrame([(0.0, 0), (0.1, 1), (1.0, 1)], "probability double, label int")
    assert {r.bin: r.n for r in evaluate.calibration(df, 10).collect() if r.n} == {1: 2, 10: 1}
    assert {r.bin: r.n for r in evaluate.calibration(df, 5, right_closed=False).collect() if r.n} == {1: 2, 5: 1}


def test_names(spark):
    catalog = spark.createDataFrame([("José  Silva", 1), ("Jose Silva", 2), ("Ann Lee", 3)], "name string, entity_id int")
    asked = spark.createDataFrame([("jose silva",), ("ANN LEE",), ("nobody",)], "name string")
    assert {r.name: (r.entity_id, r.status) for r in names.resolve(asked, catalog).collect()} == {"jose silva": (None, "ambiguous"), "ANN LEE": (3, "resolved"), "nobody": (None, "not_found")}
    assert [r.name for r in names.close_matches(catalog, "An Lee").collect()] == ["Ann Lee"]
    assert names.token_suggestions(asked, catalog, 0.4).filter("request = 'ANN LEE'").first().name == "Ann Lee"


def test_page_tables(spark):
    html = "<table><tr><th>Name</th><th>Hits</th></tr><tr><td><p>A</p><p>B</p></td><td>1<table><tr><td>in</td></tr></table></td></tr></table><script>var t='<table>';</script>"
    p = spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")
    rows = pages.table_rows(p)
    assert {(r.table, r.header, tuple(r.cells)) for r in rows.collect()} == {(0, True, ("Name", "Hits")), (0, False, ("A | B", "1")), (1, False, ("in",))}
    picked = pages.tables_with_headers(rows, ["hits", "NAME"])
    assert [list(r.x) for r in picked.select(pages.paired(F.col("cells")[0]).alias("x")).collect()] == [["A", "B"]]


def test_sources(spark, tmp_path):
    empty = tables.string_csv(spark, str(tmp_path / "none.csv"), ["a", "b"])
    assert empty.columns == ["a", "b"] and empty.count() == 0
    df = spark.createDataFrame([("1", "x,\n\"q\"")], "a string, b string")
    tables.write_csv(df, str(tmp_path / "out"), ["b", "c", "a"])
    back = tables.string_csv(spark, str(tmp_path / "out"), ["b", "c", "a"])
    assert tuple(back.first()) == ("x,\n\"q\"", "", "1")
    facts = tables.table_facts(spark.createDataFrame([("2020-01-01",), ("oops",), ("2999-01-01",)], "d string"), "t", "d")
    assert (facts.first().rows, facts.first().bad_dates) == (3, 2)


def test_publish_is_all_or_nothing(spark, tmp_path):
    df = spark.range(3)

    def refuse(_):
        raise contracts.ContractError("no")

    with pytest.raises(contracts.ContractError):
        tables.publish(df, str(tmp_path), "t", [refuse])
    assert not (tmp_path / "t").exists()
    assert tables.publish(df, str(tmp_path), "t").count() == 3
    with pytest.raises(FileExistsError):
        tables.publish(df, str(tmp_path), "t")


def months_back(day, n):
    y, m = divmod(day.year * 12 + day.month - 1 - n, 12)
    for d in (day.day, 30, 29, 28):
        try:
            return dt.date(y, m + 1, d)
        except ValueError:
            pass


def test_calendar_windows(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(3), dt.date(2019, 1, 1) + dt.timedelta(days=rng.randrange(900)), i) for i in range(300)] + [(1, None, 300)]
    df = spark.createDataFrame(rows, "entity_id int, event_day date, contest_id int")
    for r in history.snapshots(df, [history.Spec("n", "count", F.lit(1), 3)]).collect():
        low = r.event_day and months_back(r.event_day, 3)
        assert r.n == (sum(e == r.entity_id and d is not None and low <= d < r.event_day for e, d, _ in rows) if r.event_day else None)


def test_history_by_day_equals_snapshots_where_one_entity_is_hot(spark):
    """A third of the rows on one entity, some of them on one day; rows without a day or key, repeated rows, and columns that clash."""
    obs, _ = make_obs(spark, seed=21, n=200, entities=12, undated=9)
    hot = obs.withColumn("entity_id", F.when(F.col("entity_id") % 3 == 0, 0).when(F.col("entity_id") == 1, None).otherwise(F.col("entity_id")))
    hot = hot.withColumn("event_day", F.when(F.col("contest_id").between(40, 80), F.lit("2020-01-20").cast("date")).otherwise(F.col("event_day")))
    hot = hot.unionByName(hot.filter("contest_id % 7 = 0")).withColumns({"a.b": F.lit(1), "_key": F.lit(2), "wins": F.lit(-1)})
    won = F.col("won")
    specs = [*history.career_specs(), history.Spec("mean", "avg", F.col("attempts")), history.Spec("mean_won", "avg", won), history.Spec("low", "min", won), history.Spec("known", "count", won), history.Spec("month", "sum", F.col("seconds"), 1), history.Spec("month_n", "count", won, 1)]
    want, got = history.snapshots(hot, specs), history.snapshots_by_day(hot, specs)
    assert sorted(got.dtypes) == sorted(want.dtypes)
    names = [f"`{c}`" for c in sorted(want.columns)]
    text = lambda df: sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in df.select(*names).collect())
    assert text(got) == text(want)
    empty = history.snapshots_by_day(hot.limit(0), specs)
    assert empty.collect() == [] and sorted(empty.columns) == sorted(want.columns)
    assert history.snapshots_by_day(hot, []).columns == hot.columns
    with pytest.raises(ValueError):
        history.snapshots_by_day(hot, [history.Spec("x", "max", won, 3)])


def test_history_by_day_adds_up_before_its_windows(spark, capsys):
    obs, _ = make_obs(spark, n=5)
    history.snapshots_by_day(obs, history.career_specs()).explain()
    plan = capsys.readouterr().out
    assert "partial_count" in plan[plan.rindex("Window") :]


@pytest.mark.parametrize(("operator", "most"), [(history.streaks, 1), (lambda o: history.previous_group(o, {}), 1), (history.group_experience, 2), (lambda o: history.snapshots(o, history.career_specs()), 1)])
def test_windows_share_shuffles(spark, operator, most, capsys):
    obs, _ = make_obs(spark, n=5)
    operator(obs).explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") <= most


def test_undated_rows_see_nothing_and_are_seen_by_none(spark):
    """Every history operator against brute force over dated rows only; some rows have no day."""
    obs, rows = make_obs(spark, seed=12, undated=15)
    dated = [x for x in rows if x[1] is not None]
    old = lambda e, day: [x for x in dated if x[3] == e and x[1] < day]
    for r in history.row_shift(obs, ["attempts"]).collect():
        before = [x for x in dated if x[3] == r.entity_id and r.event_day and (x[1], x[0]) < (r.event_day, r.contest_id)]
        assert r.prior_attempts == (sum(x[5] for x in before) if r.event_day else None)
    for r in history.group_experience(obs).collect():
        mine = old(r.entity_id, r.event_day) if r.event_day else []
        want = (len([x for x in mine if x[2] == r.grp]), len([x for x in mine if x[2] == r.grp and x[9] == 1]), len({x[2] for x in mine}))
        assert (r.in_group_contests, r.in_group_wins, r.groups_seen) == (want if r.event_day else (None,) * 3)
    for r in history.previous_group(obs, {"x": 1, "y": 2}).collect():
        mine = old(r.entity_id, r.event_day) if r.event_day else []
        last = max(mine, key=lambda x: (x[1], x[0]))[2] if mine else None
        move = "debut_or_unknown" if last is None else "same" if last == r.grp else "up" if r.grp > last else "down"
        assert (r.previous_grp, r.movement) == ((last, move) if r.event_day else (None, None))
    assert {r.movement for r in history.previous_group(obs, {"x": 1}).collect()} == {None, "debut_or_unknown", "same", "changed_unknown_direction"}
    for r in history.recent(obs, 3, ["attempts"], "last").collect():
        mine = sorted((x[1], x[0], x[5]) for x in old(r.entity_id, r.event_day))[-3:] if r.event_day else []
        assert [(x._d, x._t, x.attempts) for x in r["last"]] == mine
    for r in history.streaks(obs).collect():
        assert (r.win_streak is None) == (r.event_day is None)
    for r in shrinkage.prior_sums(obs, "successes", "attempts").collect():
        assert r.own_den == (sum(x[5] for x in old(r.entity_id, r.event_day)) if r.event_day else None)
    for r in shrinkage.prior_ladder(obs, "successes", "attempts", 20, 0.4).filter("event_day is not null").collect():
        mine = [x for x in dated if x[1] < r.event_day and x[5] > 0]
        group = [x for x in mine if x[2] == r.grp]
        rate = lambda xs: sum(x[6] for x in xs) / sum(x[5] for x in xs)
        want = rate(group) if sum(x[5] for x in group) >= 20 else rate(mine) if mine else 0.4
        assert abs(r.prior - want) < 1e-9
    moments = shrinkage.population_moments(obs, "successes", "attempts").collect()
    assert all(r.event_day is not None for r in moments)
    assert all(r.sum_n == sum(x[5] for x in dated if x[1] < r.event_day) for r in moments)
    w = aggregates.method_mix(obs.withColumn("method", F.lit("KO"))).filter("event_day is null").collect()
    assert w and all(r.knockout_share is None for r in w)
    assert all(r.after_loss is None for r in aggregates.after_loss(obs.withColumn("method", F.lit("KO"))).filter("event_day is null").collect())


def test_prior_strength_falls_back_where_it_is_undefined(spark):
    def strength(*sums, fallback=50.0):
        x, n, n2, x2n, count = map(float, sums)
        return one(spark, shrinkage.mom_strength(*(F.col(c) for c in "abcde"), fallback), a=x, b=n, c=n2, d=x2n, e=count)

    assert strength(50, 100, 9000, 30, 40) == 50.0  # the denominator is below 0
    assert strength(50, 100, 200, 30, 29) == 50.0 and strength(0, 0, 0, 0, 40) == 50.0 and strength(100, 100, 200, 100, 40) == 50.0
    p, between = 0.4, 300.0 - 400.0**2 / 1000
    rho = (between / (p * (1 - p)) - 39) / (1000 - 30000 / 1000 - 39)
    assert strength(400, 1000, 30000, 300, 40) == pytest.approx(min(500, max(5, (1 - rho) / rho)))
    assert strength(400, 1000, 30000, 160, 40) == 500.0 and strength(400, 1000, 30000, 900, 40) == 5.0
    assert one(spark, shrinkage.support_scaled(F.col("d"), 50.0), d=-50.0) == 50.0
    assert one(spark, shrinkage.smoothed(F.col("n"), F.lit(4.0), F.lit(None).cast("double"), F.lit(5.0)), n=1.0) is None


def test_metrics_rank_probabilities_wherever_they_lie(spark):
    rng = random.Random(2)
    rows = [(0.5 + rng.randrange(400) * 1e-7, int(rng.random() < 0.5)) for _ in range(1500)] + [(0.0, 1), (1.0, 0)]
    got = evaluate.metrics(spark.createDataFrame(rows, "probability double, label int")).first()
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    assert got.auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)))


def test_close_matches_lose_no_name_to_the_bound(spark):
    import difflib

    rng = random.Random(3)
    listed = sorted({"".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 12))).strip() or "x" for _ in range(300)})
    want = sorted(((-r, x) for x in listed if (r := difflib.SequenceMatcher(None, " ".join(x.split()), "bad cab").ratio()) >= 0.5))[:40]
    got = names.close_matches(spark.createDataFrame([(x,) for x in listed], "name string"), "Bad  cab", 0.5, 40).collect()
    assert [(r.name, round(r.ratio, 9)) for r in got] == [(x, round(-r, 9)) for r, x in want]


def brute_ratings(rows, by_group, frozen, unknown_half):
    rating, dawn, day, out = {}, {}, None, {}
    for x in sorted((x for x in rows if x[3] < x[4] and x[1] is not None), key=lambda x: (x[1], x[0])):
        c, d, g, a, b, won = x[0], x[1], x[2] if by_group else "", x[3], x[4], x[9]
        if d != day:
            day, dawn = d, dict(rating)
        now = [rating.get((g, e), (1500.0, 0)) for e in (a, b)]
        seen = [dawn.get((g, e), (1500.0, 0)) for e in (a, b)] if frozen else now
        out[c] = (round(seen[0][0], 8), round(seen[1][0], 8), seen[0][1], seen[1][1])
        if won is not None or unknown_half:
            gain = 32 * ((0.5 if won is None else won) - 1 / (1 + 10 ** ((now[1][0] - now[0][0]) / 400)))
            rating[g, a], rating[g, b] = (now[0][0] + gain, now[0][1] + 1), (now[1][0] - gain, now[1][1] + 1)
    return out


@pytest.mark.parametrize(("by_group", "frozen", "unknown_half", "most"), [(False, True, False, 3), (False, False, True, 7), (True, True, False, 5), (False, True, False, 10_000)])
def test_rating_blocks_equal_the_fold(spark, by_group, frozen, unknown_half, most):
    obs, rows = make_obs(spark, seed=21, n=60, entities=40, undated=5)
    got = ratings.rating_snapshots_in_blocks(obs, most, by_group=by_group, frozen=frozen, unknown_half=unknown_half)
    assert {r.contest_id: (round(r.rating_a, 8), round(r.rating_b, 8), r.updates_a, r.updates_b) for r in got.collect()} == brute_ratings(rows, by_group, frozen, unknown_half)


def test_no_component_is_larger_than_asked(spark):
    obs, rows = make_obs(spark, seed=22, n=90, entities=40)
    pairs_ = ratings.decisive_pairs(obs)
    shares = ratings.block_shares(ratings.component_blocks(pairs_, 6, graph.Steps(spark, "t"))).collect()
    assert sum(r.contests for r in shares) == pairs_.count() and any(r.components > 1 for r in shares)
    days = {r.event_day for r in pairs_.select("event_day").distinct().collect()}
    first = sorted(r.block for r in shares)
    assert all(r.largest <= 6 or len([d for d in days if d >= r.block and (r.block == first[-1] or d < first[first.index(r.block) + 1])]) == 1 for r in shares)
    assert ratings.rating_snapshots_in_blocks(obs.limit(0)).collect() == []


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000), (None, 3), (7, 8), (8, 7)] + [(2000, 2001 + i) for i in range(80)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for u, v in edges:
        if u is not None:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    got = graph.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert sorted((r.vertex, r.component) for r in got) == sorted((x, find(x)) for x in list(parent))
    assert graph.connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
