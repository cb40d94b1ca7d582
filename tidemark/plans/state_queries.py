"""Registered queries for folds in blocks, keyed state, upkeep by changes, versioned state and streams that restart."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answer, asof_state, capture, evaluate, history, maintenance, models, names, pairs, ratings, sketches, smoothing, upkeep, walkforward
from ..operators.graph import Steps
from ..sources import tables
from ..streaming import keyed, ledger, twins
from .aggregate_queries import _snapshots_sql
from .contests import load, observations
from .queries import _FORE, _PAIRS, _SWAP, PAIR_FEATURES, career_pairs, doubles, forecasts, query, r6, with_obs


def staged(spark: SparkSession, d: str) -> DataFrame:
    """The observations, written: queries that pass over them several times derive them once."""
    return Steps(spark, "obs").write(observations(spark, d))


@query(with_obs(f"{_snapshots_sql(chr(39) * 2)} SELECT contest_id, event_day, grp, entity_a, entity_b, round(rating_a, 6) AS rating_a, round(rating_b, 6) AS rating_b, updates_a, updates_b FROM snap", recursive=True))
def rating_snapshots_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The overall fold in blocks of days, here of a sixth of all contests at most, components side by side."""
    obs = staged(spark, d)
    most = max(1, ratings.decisive_pairs(obs).count() // 6)
    return ratings.rating_snapshots_in_blocks(obs, most).withColumns({"rating_a": r6("rating_a"), "rating_b": r6("rating_b")})


@query(
    with_obs(
        """e AS MATERIALIZED (SELECT event_day AS d, entity_id AS a, opponent_id AS b FROM obs WHERE event_day IS NOT NULL),
    r(d, v, c) AS (SELECT DISTINCT d, a, a FROM e UNION SELECT r.d, r.v, e.b FROM r JOIN e ON e.d = r.d AND e.a = r.c),
    k AS (SELECT d, v, min(c) AS c FROM r GROUP BY d, v),
    s AS (SELECT e.d, k.c, count(*) // 2 AS n FROM e JOIN k ON k.d = e.d AND k.v = e.a GROUP BY e.d, k.c)
    SELECT d AS block, CAST(sum(n) AS BIGINT) AS contests, count(*) AS components, max(n) AS largest FROM s GROUP BY d""",
        recursive=True,
    )
)
def rating_day_components(spark: SparkSession, d: str) -> DataFrame:
    """How a day's contests hang together: its components can be rated side by side, the largest is what one task gets."""
    pairs = ratings.decisive_pairs(observations(spark, d)).select("event_day", "entity_a", "entity_b")
    return ratings.block_shares(ratings.component_blocks(pairs, 1, Steps(spark, "components"), longest_first=False))


# streams that stop in the middle and go on

_MIDDLE = "2024-01-16"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"""WITH k AS (SELECT user_id, event_id, CAST(ts AS DATE) AS day, coalesce(value, 0) AS value FROM events WHERE NOT (event_id % 97 = 0 AND CAST(ts AS DATE) < DATE '{_MIDDLE}' - 1)),
    h AS (SELECT user_id, event_id, day, count(*) OVER w AS events_before, round(coalesce(sum(value) OVER w, 0), 4) AS value_before FROM k
        WINDOW w AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING))
    SELECT * FROM h WHERE day < (SELECT max(day) FROM k)""")
def stream_keyed_history(spark: SparkSession, d: str) -> DataFrame:
    """ST1, X10: keyed state and timers, stopped and gone on with. Of the first half, events whose id divides by 97 come late, in the second part: those of
    days that are closed by then are left out. The last day is still open at the end."""
    root, e = twins.shared_root(spark, "keyed"), _events(spark, d)
    for put in ledger.in_two_parts(e, (F.col("ts") >= F.lit(_MIDDLE)) | (F.col("event_id") % 97 == 0), root):
        put()
        keyed.run_keyed(keyed.keyed_history(ledger.stream_of(spark, root, e)), root)
    return twins.read_or_empty(spark, f"{root}/table", twins.HISTORY).withColumn("value_before", F.round("value_before", 4))


@query(f"""WITH o AS (SELECT event_id - 1 AS forecast_id, ts + to_days(CAST(event_id % 5 AS INTEGER)) AS seen_at, value AS outcome FROM events WHERE event_id % 2 = 1),
    f AS (SELECT event_id AS forecast_id, ts AS made_at FROM events WHERE event_id % 2 = 0),
    j AS (SELECT f.*, o.seen_at, o.outcome FROM f LEFT JOIN o ON o.forecast_id = f.forecast_id AND o.seen_at BETWEEN made_at AND made_at + INTERVAL 2 DAY)
    SELECT * FROM j WHERE seen_at IS NOT NULL OR made_at + INTERVAL 3 DAY < (SELECT least((SELECT max(made_at) FROM f), (SELECT max(seen_at) FROM o)))""")
def stream_settled(spark: SparkSession, d: str) -> DataFrame:
    """Forecasts met by the outcomes of the two days that follow; what has none is given out when none can come any more."""
    root, e = twins.shared_root(spark, "settled"), _events(spark, d)
    for put in ledger.in_two_parts(e, F.col("ts") >= F.lit(_MIDDLE), root):
        put()
        live = ledger.stream_of(spark, root, e)
        made = live.filter("event_id % 2 = 0").select(F.col("event_id").alias("forecast_id"), F.col("ts").alias("made_at"))
        seen = live.filter("event_id % 2 = 1").select((F.col("event_id") - 1).alias("forecast_id"), F.expr("ts + make_interval(0, 0, 0, cast(event_id % 5 as int))").alias("seen_at"), F.col("value").alias("outcome"))
        joined = ledger.settled(made, seen)
        twins.run_into(joined, root)
    out = twins.read_or_empty(spark, f"{root}/table", joined.schema)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("made_at", "seen_at")})


@query("""WITH c AS (SELECT user_id, event_id, event_type, value, sha256(concat('{"event_id":', event_id, ',"event_type":"', event_type, '","user_id":', user_id, ',"v":', CAST(round(value * 100) AS BIGINT), '}')) AS payload_hash FROM events)
    SELECT user_id, event_id, event_type, CAST(round(value * 100) AS BIGINT) AS v, payload_hash, coalesce(lag(payload_hash) OVER (PARTITION BY user_id ORDER BY event_id), '') AS previous_hash, true AS intact FROM c""")
def stream_ledger(spark: SparkSession, d: str) -> DataFrame:
    """ST6, E18: the ledger of a stream that stops, goes on, and has a tenth of its first rows sent again: each row once, every link whole."""
    root, e = twins.shared_root(spark, "ledger"), load(spark, d, "events").select("user_id", "event_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("v"), "ts")
    first, second = ledger.in_two_parts(e, F.col("ts") >= F.lit(_MIDDLE).cast("timestamp_ntz"), root)
    first()
    live = ledger.stream_of(spark, root, e)
    ledger.run_ledger(live, f"{root}/chain", "user_id", "event_id", ["event_type", "v"])
    second()
    e.filter((F.col("ts") < F.lit(_MIDDLE).cast("timestamp_ntz")) & (F.col("event_id") % 10 == 0)).write.mode("append").parquet(f"{root}/in")
    whole = ledger.run_ledger(live, f"{root}/chain", "user_id", "event_id", ["event_type", "v"])
    broken = capture.broken_links(whole, "user_id", "event_id", ["event_type", "v"]).select("event_id", F.lit(False).alias("_ok"))
    return whole.join(broken, "event_id", "left").select("user_id", "event_id", "event_type", "v", "payload_hash", "previous_hash", F.coalesce("_ok", F.lit(True)).alias("intact"))


@query("""WITH w AS (SELECT unnest([date_trunc('day', ts) - INTERVAL 1 DAY, date_trunc('day', ts)]) AS start, event_type, value FROM events)
    SELECT start, start + INTERVAL 2 DAY AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM w WHERE start + INTERVAL 2 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY ALL""")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """ST8: windows of two days that begin every day, in append mode: each is given out once, when the watermark has passed its end, and then forgotten."""
    root, e = twins.shared_root(spark, "sliding"), _events(spark, d)
    for put in ledger.in_two_parts(e, F.col("ts") >= F.lit(_MIDDLE), root):
        put()
        windows = twins.sliding(twins.stamped(ledger.stream_of(spark, root, e)))
        twins.run_into(windows, root)
    out = twins.read_or_empty(spark, f"{root}/table", windows.schema)
    return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
    x AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k) SELECT * FROM x WHERE "end" <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def stream_session_closed(spark: SparkSession, d: str) -> DataFrame:
    """ST8: sessions in append mode, each given out once when no event can lengthen it."""
    root, e = twins.shared_root(spark, "closed_sessions"), _events(spark, d)
    for put in ledger.in_two_parts(e, F.col("ts") >= F.lit(_MIDDLE), root):
        put()
        found = twins.sessions(twins.stamped(ledger.stream_of(spark, root, e)))
        twins.run_into(found, root)
    out = twins.read_or_empty(spark, f"{root}/table", found.schema)
    return out.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "n")


# upkeep of a view, state in versions

_LATE = "2001-03-01"
_VIEW_SQL = """c AS (SELECT *, count(*) OVER h AS contests, CAST(coalesce(sum(CASE WHEN won = 1 THEN 1 ELSE 0 END) OVER h, 0) AS BIGINT) AS wins, CAST(coalesce(sum(attempts) OVER h, 0) AS DOUBLE) AS attempts_sum
        FROM now WINDOW h AS (PARTITION BY entity_id ORDER BY event_day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)),
    v AS (SELECT a.contest_id, a.entity_id, a.opponent_id, a.event_day, a.contests, a.wins, a.attempts_sum, b.contests AS opponent_contests, b.wins AS opponent_wins, b.attempts_sum AS opponent_attempts_sum
        FROM c a LEFT JOIN c b ON a.contest_id = b.contest_id AND a.opponent_id = b.entity_id),
    w AS (SELECT *, round(avg(opponent_wins) OVER (PARTITION BY entity_id ORDER BY event_day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING), 6) AS opponents_wins FROM v)"""


@query(
    with_obs(
        f"""late AS (SELECT *, event_day >= DATE '{_LATE}' AND contest_id % 61 = 0 AS fixed, event_day >= DATE '{_LATE}' AND contest_id % 61 = 1 AS gone FROM obs),
    now AS (SELECT contest_id, event_day, entity_id, opponent_id, CASE WHEN fixed THEN 1 - won ELSE won END AS won, CASE WHEN fixed THEN attempts + 1 ELSE attempts END AS attempts FROM late WHERE NOT gone),
    {_VIEW_SQL},
    ch AS (SELECT contest_id, entity_id, event_day FROM late WHERE fixed OR gone),
    t AS (SELECT entity_id, min(event_day) AS d FROM ch GROUP BY 1),
    a AS (SELECT n.* FROM now n LEFT JOIN t ON t.entity_id = n.entity_id WHERE n.event_day > t.d OR (n.contest_id, n.entity_id) IN (SELECT contest_id, entity_id FROM ch)),
    m AS (SELECT * FROM a UNION SELECT n.* FROM now n JOIN a ON a.contest_id = n.contest_id AND a.opponent_id = n.entity_id UNION SELECT * FROM now WHERE contest_id IN (SELECT contest_id FROM ch)),
    t2 AS (SELECT entity_id, min(event_day) AS d FROM (SELECT entity_id, event_day FROM m UNION ALL SELECT entity_id, event_day FROM ch) GROUP BY 1),
    dirty AS (SELECT contest_id, entity_id FROM m UNION SELECT n.contest_id, n.entity_id FROM now n JOIN t2 ON t2.entity_id = n.entity_id AND n.event_day > t2.d)
    SELECT w.*, (contest_id, entity_id) IN (SELECT contest_id, entity_id FROM dirty) AS recomputed, round((SELECT count(*) FROM dirty) / (SELECT count(*) FROM now), 6) AS recomputed_share FROM w"""
    )
)
def view_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """ST3, M03, T09: late corrections and removals reach the view through the rows that read them; only these are computed anew."""
    steps = Steps(spark, "upkeep")
    old = steps.write(observations(spark, d).select(*upkeep.ROW, "won", "attempts"))
    late = F.coalesce(F.col("event_day") >= F.lit(_LATE).cast("date"), F.lit(False))
    fixed = late & (F.col("contest_id") % 61 == 0)
    new = old.filter(~(late & (F.col("contest_id") % 61 == 1))).withColumns({"won": F.when(fixed, 1 - F.col("won")).otherwise(F.col("won")), "attempts": F.when(fixed, F.col("attempts") + 1).otherwise(F.col("attempts"))})
    out = upkeep.maintained(steps.write(upkeep.contest_view(old)), old, new, steps)
    share = out.agg(F.round(F.avg(F.col("recomputed").cast("double")), 6).alias("recomputed_share"))
    return out.withColumn("opponents_wins", r6("opponents_wins")).crossJoin(share)  # one row


_ASKED = [date(1995 + (i * 7) % 7, 1 + (i * 5) % 12, 1 + (i * 11) % 28) for i in range(20)]


@query(
    with_obs(
        f"""q AS (SELECT e.entity_id, d.event_day FROM (SELECT DISTINCT entity_id FROM obs) e, (VALUES {", ".join(f"(DATE '{x}')" for x in sorted(set(_ASKED)))}) d(event_day))
    SELECT q.entity_id, q.event_day, count(o.contest_id) AS contests, CAST(coalesce(sum(CASE WHEN o.won = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS wins, CAST(coalesce(sum(o.attempts), 0) AS DOUBLE) AS attempts_sum, max(o.event_day) AS last_day,
        count(o.contest_id) FILTER (date_diff('day', DATE '1970-01-01', o.event_day) // 91 = date_diff('day', DATE '1970-01-01', q.event_day) // 91) AS rows_read
    FROM q LEFT JOIN obs o ON o.entity_id = q.entity_id AND o.event_day < q.event_day GROUP BY 1, 2"""
    )
)
def as_of_versions(spark: SparkSession, d: str) -> DataFrame:
    """W22, ST2: totals of all entities before twenty days in no order, from versions of 91 days and the rows after them."""
    obs = staged(spark, d)
    specs = [s for s in history.career_specs() if s.name in ("contests", "wins", "attempts_sum", "last_day")]
    state = asof_state.AsOfState.build(obs, specs, 91)
    days = spark.createDataFrame([(x,) for x in sorted(set(_ASKED))], "event_day date")
    asked = obs.select("entity_id").distinct().crossJoin(days)  # twenty rows
    return state.lookup(asked).withColumn("attempts_sum", F.col("attempts_sum").cast("double"))


# walk-forward evaluation

_FOLDS = [date(y, m, 1) for y in (1997, 1998, 1999, 2000) for m in (1, 7)]
_STEPS = 6


def _newton_sql() -> str:
    """CTEs t (rows), b0 ... bn (weights by fold): Newton steps for two features, spelled out."""
    folds = ", ".join(f"({i}, DATE '{c}')" for i, c in enumerate(_FOLDS))
    out = [
        "t AS MATERIALIZED (SELECT contest_id, event_day, CAST(label AS DOUBLE) AS y, wins_diff / 10.0 AS x0, attempts_sum_diff / 1000.0 AS x1 FROM pairs)",
        f"b0 AS (SELECT fold, c, CAST(0 AS DOUBLE) AS w0, CAST(0 AS DOUBLE) AS w1 FROM (VALUES {folds}) v(fold, c))",
    ]
    for k in range(_STEPS):
        out += [
            f"q{k} AS (SELECT fold, c, w0, w1, x0, x1, y, 1 / (1 + exp(-(x0 * w0 + x1 * w1))) AS q FROM b{k} LEFT JOIN t ON event_day < c AND y IS NOT NULL)",
            f"s{k} AS (SELECT fold, c, w0, w1, coalesce(sum(x0 * (y - q)), 0) - w0 AS g0, coalesce(sum(x1 * (y - q)), 0) - w1 AS g1, coalesce(sum(q * (1 - q) * x0 * x0), 0) + 1 AS h00, coalesce(sum(q * (1 - q) * x0 * x1), 0) AS h01, coalesce(sum(q * (1 - q) * x1 * x1), 0) + 1 AS h11 FROM q{k} GROUP BY fold, c, w0, w1)",
            f"b{k + 1} AS MATERIALIZED (SELECT fold, c, w0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS w0, w1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS w1 FROM s{k})",
        ]
    out.append(f"p AS (SELECT t.contest_id, t.event_day, t.y, CAST(b.fold AS INTEGER) AS fold, 1 / (1 + exp(-(x0 * w0 + x1 * w1))) AS probability FROM t ASOF JOIN b{_STEPS} b ON t.event_day >= b.c)")
    return ",\n    ".join(out)


def _walk(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Forecasts, written before any outcome is looked at, and the rows with their outcomes."""
    steps, features = Steps(spark, "walk"), ["x0", "x1"]
    rows = steps.write(career_pairs(spark, d).select("contest_id", "event_day", "label", (F.col("wins_diff") / 10).alias("x0"), (F.col("attempts_sum_diff") / 1000).alias("x1")))
    weights = walkforward.fit_folds(rows, features, _FOLDS, ridge=1.0, most_steps=_STEPS, tolerance=0.0, steps=steps)
    return steps.write(walkforward.forecasts(rows.drop("label"), weights, features)), rows


@query(with_obs(f"{_PAIRS}, {_newton_sql()} SELECT contest_id, event_day, fold, round(probability, 6) AS probability FROM p"))
def walk_forward_forecasts(spark: SparkSession, d: str) -> DataFrame:
    """Forecasts of each half year by a fit to all rows before it, all fits at once."""
    return _walk(spark, d)[0].withColumn("probability", r6("probability"))


@query(
    with_obs(
        f"""{_PAIRS}, {_newton_sql()} SELECT fold, count(*) AS forecasts, count(y) AS settled, round(avg(-(y * ln(probability) + (1 - y) * ln(1 - probability))), 6) AS log_loss,
    round(avg((probability - y) * (probability - y)), 6) AS brier, round(avg(CASE WHEN y IS NOT NULL THEN CASE WHEN (probability >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END END), 6) AS accuracy FROM p GROUP BY fold"""
    )
)
def walk_forward_scores(spark: SparkSession, d: str) -> DataFrame:
    """The forecasts scored by fold once their outcomes are there."""
    made, rows = _walk(spark, d)
    return walkforward.scored(made, rows).select("fold", "forecasts", "settled", *[r6(c).alias(c) for c in ("log_loss", "brier", "accuracy")])


# shrunk rates from a list of families

FAMILIES = [
    smoothing.Family("accuracy", "successes", "attempts", 0.45, 120.0, 600.0, 120.0),
    smoothing.Family("defence", "stopped", "opponent_attempts", 0.55, 30.0, 600.0, 90.0),
    smoothing.Family("control", "held", "seconds", 0.5, 60.0, 300.0, 60.0),  # no such column here: it has no features and no rows in the manifest
]


def _rated(spark: SparkSession, d: str) -> DataFrame:
    obs = pairs.opponent_columns(observations(spark, d), ["attempts", "successes"])
    stopped = (F.col("opponent_attempts") - F.col("opponent_successes")).alias("stopped")
    return Steps(spark, "rated").write(obs.select("contest_id", "event_day", "grp", "entity_id", "successes", "attempts", "opponent_attempts", stopped))


_RATED_SQL = "rated AS (SELECT a.contest_id, a.event_day, a.grp, a.entity_id, a.opponent_id, a.successes, a.attempts, b.attempts AS opponent_attempts, b.attempts - b.successes AS stopped FROM obs a JOIN obs b ON a.contest_id = b.contest_id AND a.opponent_id = b.entity_id)"


def _family_sql(f: smoothing.Family, base: str) -> str:
    n, d, x = f.num, f.den, f.name
    ok, s = f"{d} > 0 AND {n} >= 0 AND {n} <= {d}", f.strength
    k = f"greatest({min(max(10.0, s / 3), 20.0)}, least({s}, {s * s} / (den + {s})))"
    earlier = "OVER (PARTITION BY entity_id ORDER BY event_day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)"
    shrunk = ", ".join(f"greatest(0, least(1, (num + {v} * prior) / (den + {v}))) AS {name}" for name, v in (("s20", "20"), ("s50", "50"), ("own_strength", s), ("support_scaled", k), ("moments", "moments_strength")))
    return f"""{x}1 AS (SELECT event_day, grp, sum(CASE WHEN {ok} THEN {n} ELSE 0 END) AS n, sum(CASE WHEN {ok} THEN {d} ELSE 0 END) AS d FROM {base} GROUP BY ALL),
    {x}2 AS (SELECT event_day, grp, coalesce(sum(n) OVER w, 0) AS gn, coalesce(sum(d) OVER w, 0) AS gd FROM {x}1 WINDOW w AS (PARTITION BY grp ORDER BY event_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    {x}3 AS (SELECT event_day, coalesce(sum(n) OVER w, 0) AS an, coalesce(sum(d) OVER w, 0) AS ad FROM (SELECT event_day, sum(n) AS n, sum(d) AS d FROM {x}1 GROUP BY 1) WINDOW w AS (ORDER BY event_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    {x}4 AS (SELECT entity_id, event_day, sum(sum({n})) OVER w AS x, sum(sum({d})) OVER w AS n FROM {base} WHERE {ok} GROUP BY entity_id, event_day WINDOW w AS (PARTITION BY entity_id ORDER BY event_day ROWS UNBOUNDED PRECEDING)),
    {x}5 AS (SELECT event_day, x - coalesce(lag(x) OVER w, 0) AS sx, n - coalesce(lag(n) OVER w, 0) AS sn, n * n - coalesce(lag(n * n) OVER w, 0) AS sq, x * x / n - coalesce(lag(x * x / n) OVER w, 0) AS sr, CASE WHEN lag(n) OVER w IS NULL THEN 1 ELSE 0 END AS sc FROM {x}4 WINDOW w AS (PARTITION BY entity_id ORDER BY event_day)),
    {x}6 AS (SELECT event_day, coalesce(sum(sx) OVER w, 0) AS sx, coalesce(sum(sn) OVER w, 0) AS sn, coalesce(sum(sq) OVER w, 0) AS sq, coalesce(sum(sr) OVER w, 0) AS sr, coalesce(sum(sc) OVER w, 0) AS sc
        FROM (SELECT DISTINCT event_day FROM {base}) LEFT JOIN (SELECT event_day, sum(sx) AS sx, sum(sn) AS sn, sum(sq) AS sq, sum(sr) AS sr, sum(sc) AS sc FROM {x}5 GROUP BY 1) USING (event_day) WINDOW w AS (ORDER BY event_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    {x}7 AS (SELECT *, CASE WHEN sn > 0 THEN sx / sn END AS p FROM {x}6),
    {x}8 AS (SELECT *, CASE WHEN p * (1 - p) > 0 AND sn - sq / sn - (sc - 1) > 0 THEN ((sr - sn * p * p) / (p * (1 - p)) - (sc - 1)) / (sn - sq / sn - (sc - 1)) END AS rho FROM {x}7),
    {x}9 AS (SELECT o.contest_id, o.entity_id, coalesce(sum(CASE WHEN {ok} THEN {n} END) {earlier}, 0) AS num, coalesce(sum(CASE WHEN {ok} THEN {d} END) {earlier}, 0) AS den,
        CASE WHEN gd >= {f.group_least} THEN gn / gd WHEN ad > 0 THEN an / ad ELSE {f.neutral} END AS prior, CASE WHEN gd >= {f.group_least} THEN 'group' WHEN ad > 0 THEN 'global' ELSE 'neutral' END AS src,
        CASE WHEN gd >= {f.group_least} THEN gd WHEN ad > 0 THEN ad ELSE 0 END AS prior_den,
        CASE WHEN sc < 30 OR rho IS NULL THEN {f.fallback} WHEN rho <= 0 THEN 500.0 WHEN rho >= 1 THEN 5.0 ELSE greatest(5.0, least(500.0, (1 - rho) / rho)) END AS moments_strength
        FROM {base} o JOIN {x}2 USING (event_day, grp) JOIN {x}3 USING (event_day) JOIN {x}8 USING (event_day)),
    {x}s AS MATERIALIZED (SELECT *, CASE WHEN prior_only = 1 THEN 'prior_only' ELSE src END AS prior_source, CASE WHEN prior_only = 0 AND src = 'global' THEN prior END AS global_prior, CASE WHEN prior_only = 0 AND src = 'group' THEN prior END AS group_prior FROM
        (SELECT contest_id, entity_id, num, den, prior, src, prior_den, moments_strength, CASE WHEN den > 0 THEN num / den END AS rate, {shrunk}, {k} AS support_scaled_strength,
            CASE WHEN den > 0 AND src <> 'neutral' THEN 0 ELSE 1 END AS prior_only, CASE WHEN den < {f.low_support} THEN 1 ELSE 0 END AS low_support FROM {x}9))"""


def _pair_sql(f: smoothing.Family) -> str:
    sides = ", ".join(f"{s}.{p[0]} AS {f.name}_{p[0]}_{s}" for p in smoothing.PARTS for s in "ab")
    diffs = ", ".join(f"a.{v} - b.{v} AS {f.name}_{v}_diff" for v in smoothing.VARIANTS)
    return f"""{f.name}p AS MATERIALIZED (SELECT a.contest_id, a.entity_id AS entity_a, b.entity_id AS entity_b, {sides}, {diffs}, a.den - b.den AS {f.name}_support_diff, least(a.den, b.den) AS {f.name}_support_min, abs(a.den - b.den) AS {f.name}_support_asymmetry,
        greatest(a.low_support, b.low_support) AS {f.name}_either_low_support, least(a.low_support, b.low_support) AS {f.name}_both_low_support, greatest(a.prior_only, b.prior_only) AS {f.name}_either_prior_only
        FROM {f.name}s a JOIN {f.name}s b ON a.contest_id = b.contest_id AND a.entity_id < b.entity_id)"""


def _listed() -> list[tuple]:
    class There:
        columns = ("successes", "attempts", "stopped", "opponent_attempts")

    return smoothing.manifest(There, FAMILIES)


def _manifest_sql() -> str:
    said = lambda x: ", ".join(f"'{v.replace(chr(39), chr(39) * 2)}' AS {n}" for v, n in zip(x, ("column_name", "family", "side", "made_of", "prior", "note"), strict=True))
    mean = lambda c: "CAST(NULL AS DOUBLE)" if "prior_source" in c else f"round(avg({c}), 4)"
    return " UNION ALL ".join(f"SELECT {said(x)}, count({x[0]}) AS n_known, {mean(x[0])} AS mean FROM {x[1]}p" for x in _listed())


_MADE_SQL = ", ".join([_RATED_SQL, *(_family_sql(f, "rated") for f in FAMILIES[:2]), *(_pair_sql(f) for f in FAMILIES[:2])])


@query(with_obs(f"{_MADE_SQL} {_manifest_sql()}"))
def smoothing_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Every column that the families make, what it is, and how many values it has with what mean over all contests."""
    made = smoothing.paired_features(_rated(spark, d), FAMILIES)
    with smoothing.methods_the_jvm_compiles(spark):
        rows = Steps(spark, "manifest").write(smoothing.manifest_rows(made, _listed()))
    return rows.withColumn("mean", F.round("mean", 4))


_SHOWN = ("accuracy_own_strength_diff", "accuracy_support_scaled_diff", "defence_moments_diff", "defence_s20_diff", "accuracy_rate_a", "accuracy_rate_b", "defence_either_low_support")
_ASKED_DAY, _ASKED_GROUP = "2000-06-01", "1-URGENT"
_BACK = {"accuracy_rate_a": "accuracy_rate_b", "accuracy_rate_b": "accuracy_rate_a"}


def _shown_sql(back: bool) -> str:
    return ", ".join(f"round({'0 - ' if back and c.endswith('_diff') else ''}{_BACK.get(c, c) if back else c}, 6) AS {c}" for c in _SHOWN)


@query(
    with_obs(
        f"""{_RATED_SQL}, e AS (SELECT DISTINCT entity_id FROM obs), rq AS (SELECT -1 - x.entity_id AS contest_id, x.entity_id AS a, y.entity_id AS b FROM e x JOIN e y ON y.entity_id = x.entity_id + 1),
    both_ AS (SELECT contest_id, event_day, grp, entity_id, successes, attempts, opponent_attempts, stopped FROM rated UNION ALL SELECT contest_id, DATE '{_ASKED_DAY}', '{_ASKED_GROUP}', unnest([a, b]), NULL, NULL, NULL, NULL FROM rq),
    {', '.join(_family_sql(f, 'both_') for f in FAMILIES[:2])}, {', '.join(_pair_sql(f) for f in FAMILIES[:2])},
    j AS (SELECT * FROM accuracyp JOIN defencep USING (contest_id, entity_a, entity_b) WHERE contest_id < 0)
    SELECT contest_id, entity_a, entity_b, 'a_minus_b' AS row_direction, {_shown_sql(False)} FROM j UNION ALL SELECT contest_id, entity_b, entity_a, 'b_minus_a', {_shown_sql(True)} FROM j"""
    )
)
def smoothing_injected(spark: SparkSession, d: str) -> DataFrame:
    """The families' features for contests that are only asked for, in both directions: each entity against the next one, on one day."""
    rated = _rated(spark, d)
    e = rated.select("entity_id").distinct()
    asked = e.join(e.select(F.col("entity_id").alias("entity_b"), (F.col("entity_id") - 1).alias("entity_id")), "entity_id").select((-1 - F.col("entity_id")).alias("contest_id"), F.lit(_ASKED_DAY).cast("date").alias("event_day"), F.lit(_ASKED_GROUP).alias("grp"), F.col("entity_id").alias("entity_a"), "entity_b")
    out = smoothing.injected(rated, asked, FAMILIES)
    return out.select("contest_id", "entity_a", "entity_b", "row_direction", *[r6(F.col(c).cast("double")).alias(c) for c in _SHOWN])


# names, sketches

_TYPED = "replace(replace(p_name, 'e', ''), 'ol', 'lo')"


@query(f"""WITH RECURSIVE c AS (SELECT DISTINCT p_name AS name FROM part), q AS (SELECT DISTINCT {_TYPED} AS request FROM part),
    r(request, name, a, b, m) AS (
        SELECT request, name, lower(name), lower(request), 0 FROM q, c
        UNION ALL
        SELECT request, name, unnest([a[:i - 1], a[i + k:]]), unnest([b[:j - 1], b[j + k:]]), unnest([k, 0])
        FROM (SELECT request, name, a, b, x.k AS k, 0 - x.i AS i, 0 - x.j AS j FROM (
            SELECT request, name, a, b, list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(a) - i + 2), lambda k:
                {{'k': CASE WHEN contains(b, a[i:i + k - 1]) THEN k ELSE 0 END, 'i': 0 - i, 'j': 0 - strpos(b, a[i:i + k - 1])}})))) AS x
            FROM r WHERE a <> '' AND b <> '') WHERE x.k > 0)),
    s AS (SELECT request, name, 2 * sum(m) / (length(request) + length(name)) AS ratio FROM r GROUP BY request, name),
    k AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY ratio DESC, name) AS i FROM s WHERE ratio >= 0.6)
    SELECT request, name, round(ratio, 9) AS ratio FROM k WHERE i <= 3""")
def close_matches_batch(spark: SparkSession, d: str) -> DataFrame:
    """The three closest names for every mistyped name, through an index of rare letters."""
    part = load(spark, d, "part")
    out = names.close_matches_all(part.select(F.expr(_TYPED).alias("name")), part.select(F.col("p_name").alias("name")))
    return out.withColumn("ratio", F.round("ratio", 9))


@query(f"""WITH c AS (SELECT lower(p_name) AS k, count(DISTINCT p_size) AS n, min(p_size) AS id FROM part GROUP BY 1), q AS (SELECT DISTINCT {_TYPED} AS name FROM part)
    SELECT q.name, CASE WHEN n = 1 THEN id END AS entity_id, CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status, n IS NULL AS has_suggestions FROM q LEFT JOIN c ON c.k = lower(q.name)""")
def names_or_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Names that aren't found come with close ones."""
    part = load(spark, d, "part")
    out = names.resolve_or_suggest(part.select(F.expr(_TYPED).alias("name")).distinct(), part.select(F.col("p_name").alias("name"), F.col("p_size").alias("entity_id")), cutoff=0.4)
    return out.select("name", "entity_id", "status", (F.size("suggestions") > 0).alias("has_suggestions"))


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS day, user_id, value FROM events), a AS (SELECT DISTINCT day AS as_of FROM e)
    SELECT as_of, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_close, true AS median_close FROM a JOIN e ON e.day < as_of AND e.day >= as_of - 7 GROUP BY as_of""")
def sketch_windows(spark: SparkSession, d: str) -> DataFrame:
    """Distinct users and the median value of the seven days before each day from daily sketches, against exact ones: users within 5 %, the median's
    rank within 2 % of one half."""
    e = load(spark, d, "events").select(F.col("ts").cast("date").alias("day"), "user_id", "value")
    asked = e.select(F.col("day").alias("as_of")).distinct()
    got = sketches.as_of_windows(sketches.daily_sketches(e, "day", "user_id", "value"), asked, 7, "day")
    rows = e.withColumn("as_of", F.explode(F.sequence(F.date_add("day", 1), F.date_add("day", 7)))).join(got.select("as_of", "quantile_0_5"), "as_of")
    exact = rows.groupBy("as_of").agg(F.count_distinct("user_id").alias("users"), F.avg((F.col("value") <= F.col("quantile_0_5")).cast("double")).alias("rank"))
    close = F.abs(F.col("keys") - F.col("users")) <= 0.05 * F.col("users") + 1
    return got.join(exact, "as_of").select("as_of", "n", "users", close.alias("users_close"), (F.abs(F.col("rank") - 0.5) <= 0.02 + 1 / F.col("n")).alias("median_close"))


# whole answers

_PENALTY = " + ".join(f"CASE WHEN contests_{s} < 5 THEN 15 ELSE 0 END + CASE WHEN in_group_{s} = 0 THEN 10 ELSE 0 END + CASE WHEN event_day - last_{s} > 730 THEN 10 ELSE 0 END + CASE WHEN rating_{s} IS NULL THEN 20 ELSE 0 END" for s in "ab")
_HISTORY = "(SELECT count(*) AS contests, coalesce(sum(CASE WHEN won = 1 THEN 1 ELSE 0 END), 0) AS wins, sum(successes) / nullif(sum(attempts), 0) AS accuracy, max(o.event_day) AS last, count(*) FILTER (o.grp = q.grp) AS in_group FROM obs o WHERE o.entity_id = {} AND o.event_day < q.event_day)"


@query(
    with_obs(
        f"""{_snapshots_sql(chr(39) * 2)}, e AS (SELECT DISTINCT entity_id AS a FROM obs),
    q AS (SELECT a AS request_id, a AS entity_a, a + 1 AS entity_b, DATE '2001-03-01' - CAST(a % 400 * 5 AS INTEGER) AS event_day, '2-HIGH' AS grp, 1.25 + (a % 17) / 10.0 AS odds_a, CASE WHEN a % 7 > 0 THEN 1.25 + (a % 13) / 10.0 END AS odds_b FROM e),
    h AS (SELECT q.*, x.contests AS contests_a, x.wins AS wins_a, x.accuracy AS accuracy_a, x.last AS last_a, x.in_group AS in_group_a, y.contests AS contests_b, y.wins AS wins_b, y.accuracy AS accuracy_b, y.last AS last_b, y.in_group AS in_group_b
        FROM q, LATERAL {_HISTORY.format('q.entity_a')} x, LATERAL {_HISTORY.format('q.entity_b')} y),
    hr AS (SELECT h.*, x.rating AS rating_a, y.rating AS rating_b FROM h ASOF LEFT JOIN du x ON x.e = h.entity_a AND h.event_day > x.day ASOF LEFT JOIN du y ON y.e = h.entity_b AND h.event_day > y.day),
    hp AS (SELECT *, 0.5 + 0.9 * (1 / (1 + pow(10.0, (coalesce(rating_b, 1500) - coalesce(rating_a, 1500)) / 400)) - 0.5) AS probability_a, (1 / odds_a) / (1 / odds_a + 1 / odds_b) AS market_a, greatest(0, 100 - ({_PENALTY})) AS reliability_score FROM hr),
    l AS (SELECT *, probability_a - market_a AS edge, CASE WHEN reliability_score >= 75 THEN 'High' WHEN reliability_score >= 55 THEN 'Medium' ELSE 'Low' END AS reliability, greatest(probability_a, 1 - probability_a) AS top FROM hp)
    SELECT request_id, event_day, CAST(contests_a AS BIGINT) AS contests_a, CAST(contests_b AS BIGINT) AS contests_b, CAST(wins_a - wins_b AS BIGINT) AS wins_diff, round(accuracy_a - accuracy_b, 6) AS accuracy_diff, CAST(in_group_a AS BIGINT) AS in_group_a, round(rating_a, 6) AS rating_a, round(rating_b, 6) AS rating_b,
        round(probability_a, 6) AS probability_a, CASE WHEN top >= 0.8 THEN 'very_high' WHEN top >= 0.7 THEN 'high' WHEN top >= 0.6 THEN 'medium' WHEN top >= 0.55 THEN 'low' ELSE 'toss_up' END AS tier, round(market_a, 6) AS market_a, round(edge, 6) AS edge,
        CASE WHEN edge IS NULL THEN 'no_market' WHEN abs(edge) < 0.03 THEN 'aligned' WHEN reliability = 'Low' THEN CASE WHEN edge > 0 THEN 'unreliable_a' ELSE 'unreliable_b' END
            ELSE (CASE WHEN abs(edge) < 0.07 THEN 'small' WHEN abs(edge) < 0.12 THEN 'medium' ELSE 'large' END) || CASE WHEN edge > 0 THEN '_a' ELSE '_b' END END AS edge_reading,
        CAST(reliability_score AS INTEGER) AS reliability_score, reliability, CASE WHEN probability_a > 0.5 THEN entity_a WHEN probability_a < 0.5 THEN entity_b END AS pick FROM l""",
        recursive=True,
    )
)
def whole_answers(spark: SparkSession, d: str) -> DataFrame:
    """Each entity against the next, on days of its own: histories, ratings, probability, market, edge and reliability in one row."""
    obs = staged(spark, d)
    a = F.col("entity_a")
    asked = obs.select(F.col("entity_id").alias("entity_a")).distinct().select(
        a.alias("request_id"), a, (a + 1).alias("entity_b"), F.date_sub(F.lit("2001-03-01").cast("date"), (a % 400 * 5).cast("int")).alias("event_day"), F.lit("2-HIGH").alias("grp"),
        F.format_string("%.2f", F.lit(1.25) + (a % 17) / 10).alias("odds_a"), F.when(a % 7 > 0, F.format_string("%.2f", F.lit(1.25) + (a % 13) / 10)).alias("odds_b"),
    )
    out = answer.whole_answers(obs, asked)
    return out.select("request_id", "event_day", "contests_a", "contests_b", "wins_diff", r6("accuracy_diff").alias("accuracy_diff"), "in_group_a", *[r6(c).alias(c) for c in ("rating_a", "rating_b", "probability_a", "market_a", "edge")], "tier", "edge_reading", "reliability_score", "reliability", "pick")


# deltas, bundles, spells, evaluation in one piece

_NEW = "2001-02-01"


@query(with_obs(f"{_PAIRS}, m AS (SELECT *, 'a_minus_b' AS row_direction FROM pairs UNION ALL SELECT contest_id, event_day, grp, entity_b, entity_a, CAST(1 - label AS INTEGER), {_SWAP}, 'b_minus_a' FROM pairs) SELECT * FROM m WHERE event_day >= DATE '{_NEW}'"))
def dataset_increment(spark: SparkSession, d: str) -> DataFrame:
    """The mirrored rows that a dataset of older contests lacks, with its columns, from the histories of the new contests' entities alone."""
    obs = observations(spark, d)
    old = pairs.mirrored(pairs.pair_rows(history.snapshots(obs.filter(F.col("event_day") < F.lit(_NEW).cast("date")), history.career_specs()), PAIR_FEATURES))
    return doubles(pairs.increment(old, obs, history.career_specs(), PAIR_FEATURES))


_LINES = "string_agg({c}, chr(10) ORDER BY {c}) || chr(10)"


@query(
    f"""WITH f AS (SELECT 'nation.txt' AS name, {_LINES.format(c='n_name')} AS x, 'ok' AS status FROM nation UNION ALL SELECT 'region.txt', {_LINES.format(c='r_name')}, 'digest' FROM region
    UNION ALL SELECT 'supplier.txt', {_LINES.format(c='s_name')}, 'size' FROM supplier UNION ALL SELECT 'customer.txt', {_LINES.format(c='c_name')}, 'unlisted' FROM customer)
    SELECT name, status, CAST(octet_length(encode(x)) AS BIGINT) AS bytes FROM f UNION ALL SELECT 'part.txt', 'missing', NULL"""
)
def bundle_members(spark: SparkSession, d: str) -> DataFrame:
    """The files of a bundle against its manifest, as a set; one has another digest than listed, one another size, one is missing and one isn't listed."""
    root, found = twins.shared_root(spark, "bundle"), []
    for t, c in (("nation", "n_name"), ("region", "r_name"), ("supplier", "s_name"), ("customer", "c_name")):
        load(spark, d, t).select(c).coalesce(1).sortWithinPartitions(c).write.text(f"{root}/{t}")
        files = tables.file_hashes(spark, f"{root}/{t}").filter(~F.col("path").rlike(r"/[._][^/]*$"))
        found.append(files.select(F.lit(f"{root}/{t}.txt").alias("path"), "bytes", "sha256"))
    there = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
    name = F.element_at(F.split("path", "/"), -1)
    listed = there.select(name.alias("name"), (F.col("bytes") + F.when(name == "supplier.txt", 1).otherwise(0)).alias("bytes"), F.when(name == "region.txt", F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"))
    manifest = listed.withColumn("name", F.when(F.col("name") == "customer.txt", "part.txt").otherwise(F.col("name")))
    return tables.bundle_members(there, manifest)


@query(
    with_obs(
        """c AS (SELECT *, CASE WHEN grp IS NOT DISTINCT FROM lag(grp) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM obs WINDOW w AS (PARTITION BY entity_id ORDER BY event_day, contest_id)),
    p AS (SELECT *, sum(new) OVER (PARTITION BY entity_id ORDER BY event_day, contest_id ROWS UNBOUNDED PRECEDING) AS place FROM c)
    SELECT entity_id, CAST(place AS BIGINT) AS place, any_value(grp) AS grp, min(event_day) AS since, max(event_day) AS until, count(*) AS contests FROM p GROUP BY entity_id, place"""
    )
)
def group_spells(spark: SparkSession, d: str) -> DataFrame:
    """Each entity's groups in order, with the days they were held."""
    return history.group_spells(observations(spark, d))


_LOGIT = ("wins_diff", "losses_diff", "attempts_sum_diff")


@query(with_obs(f"{_PAIRS} SELECT f AS feature, count(label) AS n, true AS flat FROM pairs, (SELECT unnest([{', '.join(repr(x) for x in (*_LOGIT, 'intercept'))}]) AS f) WHERE event_day < DATE '1999-01-01' GROUP BY f"))
def logit_gradients(spark: SparkSession, d: str) -> DataFrame:
    """At the fitted weights the penalised loss is flat in every direction."""
    rows = Steps(spark, "gradients").write(career_pairs(spark, d).filter(F.col("event_day") < F.lit("1999-01-01").cast("date")))
    model = models.fit(rows, "logistic", list(_LOGIT))
    return models.logistic_gradient(model, rows).select("feature", "n", (F.abs("gradient") < 1e-4).alias("flat"))


_PARTS = {"develop": "1999-01-01", "test": ""}


@query(
    with_obs(
        f"""{_FORE}, c AS (SELECT contest_id, CAST(label AS DOUBLE) AS y, unnest(['rating', 'half']) AS model, unnest([probability, 0.5]) AS p, CASE WHEN event_day < DATE '1999-01-01' THEN 'develop' ELSE 'test' END AS part FROM fore WHERE label IS NOT NULL),
    g AS (SELECT model, part, count(*) AS n, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END) AS accuracy, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS log_loss, avg((p - y) * (p - y)) AS brier FROM c GROUP BY ALL),
    b AS (SELECT model, part, greatest(1, ceil(p * 10)) AS bin, avg(y) AS observed FROM c GROUP BY ALL)
    SELECT NULL AS model, part, 'protocol' AS section, 'contests' AS item, CAST(count(DISTINCT contest_id) AS DOUBLE) AS value FROM c GROUP BY part
    UNION ALL SELECT model, part, 'metrics', 'n', n FROM g UNION ALL SELECT model, part, 'metrics', 'accuracy', round(accuracy, 6) FROM g UNION ALL SELECT model, part, 'metrics', 'log_loss', round(log_loss, 6) FROM g UNION ALL SELECT model, part, 'metrics', 'brier', round(brier, 6) FROM g
    UNION ALL SELECT model, part, 'interval', 'mean', round(brier, 6) FROM g UNION ALL SELECT model, part, 'calibration', 'bin ' || CAST(CAST(bin AS BIGINT) AS VARCHAR), round(observed, 6) FROM b"""
    )
)
def retrospective_report(spark: SparkSession, d: str) -> DataFrame:
    """A frozen evaluation of the rating's expectation and of one half, by part: protocol, metrics, calibration, and the mean that the interval is around."""
    cases = forecasts(spark, d).filter("row_direction = 'a_minus_b'").select("contest_id", "event_day", "label", F.col("probability").alias("rating"), F.lit(0.5).alias("half"))
    out = evaluate.retrospective(cases, ["rating", "half"], _PARTS, "frozen")
    return out.filter("item not in ('balanced_accuracy', 'auc', 'low', 'high')").withColumn("value", r6("value"))


# recovery, sealed reports

_STATES = ("staging", "committing", "committed", "rolled_back", "recovery_required", "odd")


@query(
    f"""WITH j AS (SELECT o_custkey AS k, o_orderkey AS pos, [{", ".join(repr(x) for x in _STATES)}][o_orderkey % {len(_STATES)} + 1] AS status, o_orderkey % 5 = 0 AS alive FROM orders),
    l AS (SELECT k, arg_max(status, pos) AS status, arg_max(alive, pos) AS alive, max(pos) AS pos FROM j GROUP BY k)
    SELECT k AS "transaction", status, CASE WHEN status IN ('staging', 'committing', 'recovery_required') THEN CASE WHEN alive THEN 'refuse' ELSE 'restore' END WHEN status = 'rolled_back' THEN 'none'
        WHEN status = 'committed' THEN CASE WHEN pos = (SELECT max(pos) FROM l WHERE status = 'committed') THEN 'may_restore' ELSE 'keep' END ELSE 'unknown' END AS action FROM l"""
)
def recovery_actions(spark: SparkSession, d: str) -> DataFrame:
    """Customers stand for transactions, orders for the rows of their journals."""
    k = F.col("o_orderkey")
    state = F.element_at(F.array(*[F.lit(x) for x in _STATES]), (k % len(_STATES) + 1).cast("int"))
    return maintenance.recovery_actions(load(spark, d, "orders").select(F.col("o_custkey").alias("transaction"), k.alias("at"), state.alias("status"), (k % 5 == 0).alias("alive")))


@query("""WITH r AS (SELECT o_orderpriority AS item, avg(o_totalprice) AS value FROM orders GROUP BY 1)
    SELECT 'whole' AS report, item, 'bounds' AS fault FROM r WHERE item = '1-URGENT' AND value > 1 OR item = '2-HIGH' AND value < 0 UNION ALL SELECT 'changed', item, unnest(CASE WHEN item = '1-URGENT' THEN ['integrity', 'bounds'] ELSE ['integrity'] END) FROM r""")
def sealed_report(spark: SparkSession, d: str) -> DataFrame:
    """A report that is whole but for one value out of its bounds, and one that was changed after it was sealed."""
    report = Steps(spark, "report").write(load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("item")).agg(F.avg("o_totalprice").alias("value")))
    bounds = {"1-URGENT": (None, 1.0), "2-HIGH": (0.0, None)}
    whole = maintenance.sealed(report)
    changed = whole.withColumn("value", F.col("value") + 1)
    return maintenance.seal_faults(whole, bounds).withColumn("report", F.lit("whole")).unionByName(maintenance.seal_faults(changed, bounds).withColumn("report", F.lit("changed")))
