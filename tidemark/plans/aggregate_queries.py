"""Registered queries for the descriptive aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, compare, evaluate, history, ratings
from .contests import load, observations
from .queries import _CUTOFF, _PAIRS, _STRICT, ID, PAIR_FEATURES, career_pairs, query, r6, with_obs

_OLD = f"old AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY event_day DESC, contest_id DESC) AS n FROM obs WHERE event_day < DATE '{_CUTOFF}')"


@query(with_obs("SELECT grp, 'accuracy' AS metric, round(sum(successes) / sum(attempts), 6) AS value, CAST(count(*) AS BIGINT) AS eligible, CAST(0 AS BIGINT) AS missing FROM obs GROUP BY 1 UNION ALL SELECT grp, 'successes_per_minute', round(60 * sum(successes) / sum(seconds), 6), count(*), 0 FROM obs GROUP BY 1 UNION ALL SELECT grp, 'attempts_per_15', round(900 * sum(attempts) / sum(seconds), 6), count(*), 0 FROM obs GROUP BY 1"))
def pooled_by_group(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.pooled_ratios(observations(spark, d), ["grp"]).withColumn("value", r6("value"))


_SCOPES = " UNION ALL ".join(f"SELECT entity_id, '{m}' AS metric, '{s}' AS scope, round(CASE WHEN sum({den}) > 0 THEN {f} * sum({num}) / sum({den}) END, 6) AS value FROM old WHERE {w} GROUP BY 1" for m, num, den, f in aggregates.METRICS for s, w in (("career", "true"), ("last_3", "n <= 3"), ("last_5", "n <= 5")))


@query(with_obs(f"{_OLD} {_SCOPES}"))
def form_table(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.form(observations(spark, d), F.lit(_CUTOFF).cast("date")).withColumn("value", r6("value"))


def _mix(cond: str) -> str:
    return f"sum(CASE WHEN {cond} THEN 1 ELSE 0 END) {_STRICT}"


_FIN = "(upper(method) LIKE '%KO%' OR upper(method) LIKE '%SUB%')"


@query(with_obs(f"m AS (SELECT *, {_mix('won = 1')} AS w, {_mix('won = 0')} AS l, {_mix('won = 1 AND upper(method) LIKE ' + chr(39) + '%KO%' + chr(39))} AS k, {_mix('won = 1 AND upper(method) LIKE ' + chr(39) + '%DEC%' + chr(39))} AS dc, {_mix('won = 0 AND ' + _FIN)} AS fl FROM obs) SELECT contest_id, entity_id, round(CASE WHEN w > 0 THEN k / w END, 6) AS knockout_share, round(CASE WHEN w > 0 THEN dc / w END, 6) AS decision_share, round(CASE WHEN l > 0 THEN fl / l END, 6) AS finish_loss_rate FROM m"))
def method_mix(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.method_mix(observations(spark, d)).select(*ID, *[r6(c).alias(c) for c in ("knockout_share", "decision_share", "finish_loss_rate")])


@query(with_obs(f"e AS (SELECT entity_id, event_day, arg_max(coalesce(won = 0, false), contest_id) AS lost, arg_max({_FIN}, contest_id) AS fin FROM obs GROUP BY ALL) SELECT o.contest_id, o.entity_id, CAST(e.lost AS INTEGER) AS after_loss, CAST(e.lost AND e.fin AS INTEGER) AS after_finish_loss FROM obs o ASOF LEFT JOIN e ON o.entity_id = e.entity_id AND o.event_day > e.event_day"))
def after_loss(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.after_loss(observations(spark, d)).select(*ID, "after_loss", "after_finish_loss")


@query(with_obs("SELECT result, count(*) AS contests FROM (SELECT contest_id, max(CASE WHEN result IN ('win', 'loss') THEN 'win_loss' ELSE result END) AS result FROM obs GROUP BY 1) GROUP BY 1"))
def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.outcome_counts(observations(spark, d))


@query("SELECT (SELECT count(DISTINCT p_partkey) FROM part) AS entities, (SELECT max(n) FROM (SELECT count(DISTINCT p_name) AS n FROM part GROUP BY p_partkey)) AS most_names, (SELECT count(DISTINCT p_name) FROM part) AS names, (SELECT max(n) FROM (SELECT count(DISTINCT p_partkey) AS n FROM part GROUP BY p_name)) AS most_entities")
def identity_cardinality(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.identity_cardinality(load(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name")))


@query("SELECT 'before' AS state, count(*) FILTER (o_orderdate < TIMESTAMP '2000-01-01') AS rows, count(DISTINCT o_orderkey) FILTER (o_orderdate < TIMESTAMP '2000-01-01') AS keys, CAST(0 AS BIGINT) AS duplicates FROM orders UNION ALL SELECT 'after', count(*), count(DISTINCT o_orderkey), 0 FROM orders")
def update_facts(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    return aggregates.before_after(o.filter("o_orderdate < timestamp_ntz'2000-01-01'"), o, ["o_orderkey"], "o_orderdate").select("state", "rows", "keys", "duplicates")


@query(with_obs("SELECT f AS feature, count(*) AS n, CAST(0 AS BIGINT) AS mismatches, 'PASS' AS status FROM (SELECT DISTINCT entity_id FROM obs WHERE event_day = DATE '1998-06-01'), (SELECT unnest(['contests', 'wins', 'attempts_sum']) AS f) GROUP BY 1"))
def parity_batch_query(spark: SparkSession, d: str) -> DataFrame:
    """The windowed history at one day against the as-of aggregation for that day."""
    obs, day = observations(spark, d), F.lit("1998-06-01").cast("date")
    batch = history.snapshots(obs, history.career_specs()).filter(F.col("event_day") == day).dropDuplicates(["entity_id"])
    return aggregates.parity(batch, history.as_of(obs, history.career_specs(), day), ["entity_id"], ["contests", "wins", "attempts_sum"])


_METRIC_ROWS = " UNION ALL ".join(f"SELECT contest_id, '{f}' AS metric, 'count' AS unit, {f}_a AS a, {f}_b AS b, {f}_diff AS diff FROM pairs" for f in PAIR_FEATURES)


@query(with_obs(f"{_PAIRS} {_METRIC_ROWS}"))
def metric_table(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.metric_table(career_pairs(spark, d), [(f, "count", [f]) for f in PAIR_FEATURES])


def _fold_sql(group: str) -> str:
    body = with_obs(f"""m AS MATERIALIZED (SELECT row_number() OVER (ORDER BY event_day, contest_id) AS step, {group} AS g, entity_id AS a, opponent_id AS b, CAST(won AS DOUBLE) AS s FROM obs WHERE entity_id < opponent_id AND won IS NOT NULL),
    r(g, e, rating, updates, step) USING KEY (g, e) AS (
        SELECT '', CAST(-1 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
        UNION
        (SELECT m.g, CASE WHEN side = 0 THEN m.a ELSE m.b END,
            CASE WHEN side = 0 THEN coalesce(x.rating, 1500.0) + gain ELSE coalesce(y.rating, 1500.0) - gain END,
            CASE WHEN side = 0 THEN coalesce(x.updates, 0) ELSE coalesce(y.updates, 0) END + 1, m.step
         FROM (SELECT max(step) AS step FROM r) c JOIN m ON m.step = c.step + 1
         LEFT JOIN recurring.r x ON x.g = m.g AND x.e = m.a LEFT JOIN recurring.r y ON y.g = m.g AND y.e = m.b,
         LATERAL (SELECT 32.0 * (m.s - 1 / (1 + pow(10.0, (coalesce(y.rating, 1500.0) - coalesce(x.rating, 1500.0)) / 400))) AS gain) q,
         (VALUES (0), (1)) v(side)))
    SELECT g AS grp, e AS entity_id, round(rating, 6) AS rating, updates FROM r WHERE e >= 0""")
    return body.replace("WITH ", "WITH RECURSIVE ", 1)


@query(_fold_sql("grp"))
def rating_final_by_group(spark: SparkSession, d: str) -> DataFrame:
    return ratings.final_ratings(observations(spark, d)).withColumn("rating", r6("rating"))


@query(_fold_sql("''"))
def rating_final(spark: SparkSession, d: str) -> DataFrame:
    return ratings.final_ratings(observations(spark, d), by_group=False).withColumn("rating", r6("rating"))


def _snapshots_sql(group: str) -> str:
    """CTEs up to snap: both sides' ratings at the dawn of each contest's day. Each entity keeps the list of its ratings in the fold."""
    entry = "{{'day': m.event_day, 'step': m.step, 'rating': coalesce({0}.rating, 1500.0) {1} gain, 'updates': coalesce({0}.updates, 0) + 1}}"
    return f"""m AS MATERIALIZED (SELECT row_number() OVER (ORDER BY event_day, contest_id) AS step, {group} AS g, event_day, entity_id AS a, opponent_id AS b, CAST(won AS DOUBLE) AS s FROM obs WHERE entity_id < opponent_id AND won IS NOT NULL),
    r(g, e, rating, updates, step, hist) USING KEY (g, e) AS (
        SELECT '', CAST(-1 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS STRUCT(day DATE, step BIGINT, rating DOUBLE, updates BIGINT)[])
        UNION
        (SELECT m.g, CASE WHEN side = 0 THEN m.a ELSE m.b END, CASE WHEN side = 0 THEN coalesce(x.rating, 1500.0) + gain ELSE coalesce(y.rating, 1500.0) - gain END,
            CASE WHEN side = 0 THEN coalesce(x.updates, 0) ELSE coalesce(y.updates, 0) END + 1, m.step,
            CASE WHEN side = 0 THEN list_append(coalesce(x.hist, []), {entry.format('x', '+')}) ELSE list_append(coalesce(y.hist, []), {entry.format('y', '-')}) END
         FROM (SELECT max(step) AS step FROM r) c JOIN m ON m.step = c.step + 1
         LEFT JOIN recurring.r x ON x.g = m.g AND x.e = m.a LEFT JOIN recurring.r y ON y.g = m.g AND y.e = m.b,
         LATERAL (SELECT 32.0 * (m.s - 1 / (1 + pow(10.0, (coalesce(y.rating, 1500.0) - coalesce(x.rating, 1500.0)) / 400))) AS gain) q,
         (VALUES (0), (1)) v(side))),
    u AS (SELECT g, e, unnest(hist, recursive := true) FROM r WHERE e >= 0),
    du AS (SELECT g, e, day, arg_max(rating, step) AS rating, arg_max(updates, step) AS updates FROM u GROUP BY ALL),
    p AS (SELECT contest_id, event_day, grp, {group} AS g, entity_id AS entity_a, opponent_id AS entity_b, won FROM obs WHERE entity_id < opponent_id),
    snap AS (SELECT p.*, coalesce(x.rating, 1500.0) AS rating_a, coalesce(y.rating, 1500.0) AS rating_b, CAST(coalesce(x.updates, 0) AS BIGINT) AS updates_a, CAST(coalesce(y.updates, 0) AS BIGINT) AS updates_b
        FROM p ASOF LEFT JOIN du x ON x.g = p.g AND x.e = p.entity_a AND p.event_day > x.day ASOF LEFT JOIN du y ON y.g = p.g AND y.e = p.entity_b AND p.event_day > y.day)"""


def rating_sides_sql(group: str) -> str:
    return f"""{_snapshots_sql(group)},
    sides AS (SELECT contest_id, event_day, grp, entity_a AS entity_id, entity_b AS opponent_id, rating_a AS rating, rating_b AS opponent_rating, CAST(won AS DOUBLE) AS value FROM snap
        UNION ALL SELECT contest_id, event_day, grp, entity_b, entity_a, rating_b, rating_a, CAST(1 - won AS DOUBLE) FROM snap)"""


def rating_sides(spark: SparkSession, d: str) -> DataFrame:
    return ratings.side_ratings(ratings.rating_snapshots(observations(spark, d)))


@query(with_obs(f"{_snapshots_sql('grp')} SELECT contest_id, event_day, grp, entity_a, entity_b, round(rating_a, 6) AS rating_a, round(rating_b, 6) AS rating_b, updates_a, updates_b FROM snap", recursive=True))
def rating_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return ratings.rating_snapshots(observations(spark, d)).withColumns({"rating_a": r6("rating_a"), "rating_b": r6("rating_b")})


@query(
    with_obs(
        f"""{rating_sides_sql('grp')}, f AS (SELECT *, value IS NOT NULL AND opponent_rating > 0 AS ok FROM sides)
    SELECT contest_id, entity_id, round(avg(opponent_rating) {_STRICT}, 6) AS opponents_mean, round(max(opponent_rating) {_STRICT}, 6) AS opponents_max,
        round(sum(CASE WHEN ok THEN value * opponent_rating END) {_STRICT} / sum(CASE WHEN ok THEN opponent_rating END) {_STRICT}, 6) AS weighted_form,
        round(rating - coalesce(lag(rating, 3) OVER w, first_value(rating) OVER w), 6) AS trend FROM f WINDOW w AS (PARTITION BY entity_id ORDER BY event_day, contest_id)""",
        recursive=True,
    )
)
def rating_strength(spark: SparkSession, d: str) -> DataFrame:
    sides = ratings.side_ratings(ratings.rating_snapshots(observations(spark, d)))
    won = observations(spark, d).select(*ID, F.col("won").cast("double").alias("value"))
    out = aggregates.rating_trend(aggregates.rating_weighted_form(aggregates.opponent_strength(sides.join(won, list(ID)))))
    return out.select(*ID, *[r6(c).alias(c) for c in ("opponents_mean", "opponents_max", "weighted_form", "trend")])


@query(
    with_obs(
        f"""{_snapshots_sql("''")}, k AS (SELECT CAST(won AS DOUBLE) AS y, 0.5 + 0.9 * (1 / (1 + pow(10.0, (rating_b - rating_a) / 400)) - 0.5) AS p FROM snap WHERE won IS NOT NULL),
    rk AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM k)
    SELECT count(*) AS n, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END), 6) AS accuracy, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier,
        round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auc FROM rk""",
        recursive=True,
    )
)
def rating_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Frozen overall ratings as forecasts, scored."""
    r = compare.with_probability(ratings.rating_snapshots(observations(spark, d), by_group=False, with_score=True))
    return evaluate.metrics(r.withColumnRenamed("score_a", "label")).select("n", *[r6(c).alias(c) for c in ("accuracy", "log_loss", "brier", "auc")])
