"""Registered queries over the canonical contests and the other driver tables, each with its SQL twin for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import capture, contracts, evaluate, history, pairs, shrinkage
from .contests import OBSERVATIONS_SQL, load, observations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def r6(x: str | Column) -> Column:
    """Rounded to six places as SQL engines do it: the nearest multiple of the product. F.round takes the decimal digits, and differs where the seventh is a last 5."""
    million = F.lit(1e6)
    return F.round((F.col(x) if isinstance(x, str) else x).cast("double") * million) / million


def with_obs(body: str, recursive: bool = False) -> str:
    start = "WITH RECURSIVE" if recursive else "WITH"
    return f"{start} {OBSERVATIONS_SQL}, {body}" if body.lstrip()[:6].upper() != "SELECT" else f"{start} {OBSERVATIONS_SQL} {body}"


ID = ("contest_id", "entity_id")


@query(with_obs("SELECT contest_id, event_day, grp, entity_id, opponent_id, attempts, successes, seconds, method, result, CAST(won AS INTEGER) AS won FROM obs"))
def pit_contests(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d)


_STRICT = "OVER (PARTITION BY entity_id ORDER BY event_day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)"
_CAREER = f"""
    hist AS (SELECT *, count(*) {_STRICT} AS contests, coalesce(sum(CASE WHEN won = 1 THEN 1 ELSE 0 END) {_STRICT}, 0) AS wins,
        coalesce(sum(CASE WHEN won = 0 THEN 1 ELSE 0 END) {_STRICT}, 0) AS losses, coalesce(sum(CASE WHEN result = 'draw' THEN 1 ELSE 0 END) {_STRICT}, 0) AS draws,
        coalesce(sum(attempts) {_STRICT}, 0) AS attempts_sum, coalesce(sum(successes) {_STRICT}, 0) AS successes_sum, coalesce(sum(seconds) {_STRICT}, 0) AS seconds_sum,
        max(event_day) {_STRICT} AS last_day, max(CASE WHEN won = 1 THEN event_day END) {_STRICT} AS last_win_day, max(CASE WHEN won = 0 THEN event_day END) {_STRICT} AS last_loss_day
        FROM obs)"""


@query(with_obs(f"{_CAREER} SELECT contest_id, entity_id, contests, CAST(wins AS BIGINT) AS wins, CAST(losses AS BIGINT) AS losses, CAST(draws AS BIGINT) AS draws, CAST(attempts_sum AS DOUBLE) AS attempts_sum, CAST(successes_sum AS DOUBLE) AS successes_sum, CAST(seconds_sum AS DOUBLE) AS seconds_sum, last_day FROM hist"))
def pit_history_strict(spark: SparkSession, d: str) -> DataFrame:
    out = history.snapshots(observations(spark, d), history.career_specs())
    return out.select(*ID, "contests", "wins", "losses", "draws", "attempts_sum", "successes_sum", "seconds_sum", "last_day")


_HOT = "CASE WHEN entity_id % 3 = 0 THEN 0 ELSE entity_id END"
_HOT_STRICT = "OVER (PARTITION BY hot ORDER BY event_day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)"
_HOT_YEAR = "OVER (PARTITION BY hot ORDER BY event_day RANGE BETWEEN INTERVAL 12 MONTH PRECEDING AND INTERVAL 1 DAY PRECEDING)"


@query(
    with_obs(f"""h AS (SELECT *, {_HOT} AS hot FROM obs)
    SELECT contest_id, opponent_id, hot AS entity_id, count(*) {_HOT_STRICT} AS contests, CAST(coalesce(sum(CASE WHEN won = 1 THEN 1 ELSE 0 END) {_HOT_STRICT}, 0) AS BIGINT) AS wins,
        CAST(coalesce(sum(attempts) {_HOT_STRICT}, 0) AS DOUBLE) AS attempts_sum, round(avg(seconds) {_HOT_STRICT}, 6) AS mean_seconds, min(attempts) {_HOT_STRICT} AS least_attempts,
        max(CASE WHEN won = 1 THEN event_day END) {_HOT_STRICT} AS last_win_day, count(*) {_HOT_YEAR} AS contests_12m FROM h""")
)
def history_hot_entity(spark: SparkSession, d: str) -> DataFrame:
    """W01, W13 where one entity has a third of all rows: every third entity counts as one. Windows over one row for each entity and day."""
    obs = observations(spark, d).withColumn("entity_id", F.expr(_HOT))
    won = F.when(F.col("won") == 1, 1).otherwise(0)
    specs = [
        history.Spec("contests", "count", F.lit(1)),
        history.Spec("wins", "sum", won),
        history.Spec("attempts_sum", "sum", F.col("attempts")),
        history.Spec("mean_seconds", "avg", F.col("seconds")),
        history.Spec("least_attempts", "min", F.col("attempts")),
        history.Spec("last_win_day", "max", F.when(F.col("won") == 1, F.col("event_day"))),
        history.Spec("contests_12m", "count", F.lit(1), 12),
    ]
    out = history.snapshots_by_day(obs, specs)
    return out.select("contest_id", "opponent_id", "entity_id", "contests", "wins", "attempts_sum", r6("mean_seconds").alias("mean_seconds"), "least_attempts", "last_win_day", "contests_12m")


_RATES = """round(CASE WHEN wins + losses > 0 THEN wins / (wins + losses) END, 6) AS win_rate, round(CASE WHEN attempts_sum > 0 THEN successes_sum / attempts_sum END, 6) AS accuracy,
    round(CASE WHEN seconds_sum > 0 THEN successes_sum / (seconds_sum / 60) END, 6) AS per_minute, round(CASE WHEN seconds_sum > 0 THEN attempts_sum / (seconds_sum / 60) * 15 END, 6) AS per_15,
    CAST(event_day - last_day AS BIGINT) AS days_since_last, CAST(event_day - last_win_day AS BIGINT) AS days_since_win, CAST(event_day - last_loss_day AS BIGINT) AS days_since_loss"""


@query(with_obs(f"{_CAREER} SELECT contest_id, entity_id, {_RATES} FROM hist"))
def pit_career_rates(spark: SparkSession, d: str) -> DataFrame:
    out = history.career_rates(history.snapshots(observations(spark, d), history.career_specs()))
    return out.select(*ID, r6("win_rate").alias("win_rate"), r6("accuracy").alias("accuracy"), r6("per_minute").alias("per_minute"), r6("per_15").alias("per_15"), "days_since_last", "days_since_win", "days_since_loss")


@query(with_obs(f"{_CAREER} SELECT contest_id, entity_id, round(CASE WHEN contests > 0 THEN wins / contests END, 6) AS win_rate FROM hist"))
def pit_draws_as_losses(spark: SparkSession, d: str) -> DataFrame:
    out = history.career_rates(history.snapshots(observations(spark, d), history.career_specs()), draws_as_losses=True)
    return out.select(*ID, r6("win_rate").alias("win_rate"))


PAIR_FEATURES = ("contests", "wins", "losses", "attempts_sum", "successes_sum")


def career_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.pair_rows(history.snapshots(observations(spark, d), history.career_specs()), PAIR_FEATURES)


_PAIR_COLS = ", ".join(f"CAST(a.{f} AS DOUBLE) AS {f}_a, CAST(b.{f} AS DOUBLE) AS {f}_b, CAST(a.{f} - b.{f} AS DOUBLE) AS {f}_diff" for f in PAIR_FEATURES)
_PAIRS = f"{_CAREER}, pairs AS (SELECT a.contest_id, a.event_day, a.grp, a.entity_id AS entity_a, b.entity_id AS entity_b, CAST(a.won AS INTEGER) AS label, {_PAIR_COLS} FROM hist a JOIN hist b ON a.contest_id = b.contest_id AND a.entity_id < b.entity_id)"


def doubles(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if c.split("_")[-1] in ("a", "b", "diff") and not c.startswith("entity") else F.col(c) for c in df.columns])


@query(with_obs(f"{_PAIRS} SELECT * FROM pairs"))
def pit_pairs(spark: SparkSession, d: str) -> DataFrame:
    return doubles(career_pairs(spark, d))


_SWAP = ", ".join(f"{f}_b AS {f}_a, {f}_a AS {f}_b, 0 - {f}_diff AS {f}_diff" for f in PAIR_FEATURES)


@query(with_obs(f"{_PAIRS} SELECT *, 'a_minus_b' AS row_direction FROM pairs UNION ALL SELECT contest_id, event_day, grp, entity_b, entity_a, CAST(1 - label AS INTEGER), {_SWAP}, 'b_minus_a' FROM pairs"))
def mirror_rows(spark: SparkSession, d: str) -> DataFrame:
    return doubles(pairs.mirrored(career_pairs(spark, d)))


_LOST, _BENT, _RELABELLED = 97, 89, 83  # contests by their id: the mirror row is lost, its sides are not exchanged, its label is side a's


@query(with_obs(f"""{_PAIRS}, f AS (SELECT *, contest_id % {_LOST} = 0 AS lost, contest_id % {_BENT} = 0 AND contest_id % {_LOST} <> 0 AS bent, contest_id % {_RELABELLED} = 0 AND contest_id % {_LOST} <> 0 AS relabelled FROM pairs)
    SELECT contest_id, CAST(CASE WHEN lost THEN 1 ELSE 2 END AS BIGINT) AS n_rows, CASE WHEN lost THEN 5 WHEN bent AND wins_diff <> 0 THEN 1 ELSE 0 END AS sign_errors,
        CASE WHEN lost THEN 12 WHEN bent AND wins_a <> wins_b THEN 2 ELSE 0 END AS swap_errors, CASE WHEN label IS NOT NULL AND (lost OR relabelled) THEN 1 ELSE 0 END AS label_errors FROM f"""))
def mirror_audit(spark: SparkSession, d: str) -> DataFrame:
    """Both orientations of all contests; some are planted with faults."""
    rows, k = pairs.mirrored(career_pairs(spark, d)), F.col("contest_id")
    back = F.col("row_direction") == "b_minus_a"
    bent = {"wins_a": F.col("wins_b"), "wins_b": F.col("wins_a"), "wins_diff": -F.col("wins_diff")}
    faulty = rows.filter(~(back & (k % _LOST == 0))).withColumns({c: F.when(back & (k % _BENT == 0), v).otherwise(F.col(c)) for c, v in bent.items()})
    return pairs.mirror_audit(faulty.withColumn("label", F.when(back & (k % _RELABELLED == 0), 1 - F.col("label")).otherwise(F.col("label"))))


_DIFFS = " UNION ALL ".join(f"SELECT contest_id, '{f}_diff' AS feature, {f}_diff AS diff FROM pairs" for f in PAIR_FEATURES)


@query(with_obs(f"{_PAIRS}, long AS ({_DIFFS}), r AS (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY abs(diff) DESC, feature) AS place FROM long WHERE diff IS NOT NULL) SELECT contest_id, feature, diff, place FROM r WHERE place <= 3"))
def topk_abs_diff(spark: SparkSession, d: str) -> DataFrame:
    return pairs.top_differences(career_pairs(spark, d), 3)


@query(with_obs("SELECT a.contest_id, a.entity_id, b.attempts AS opponent_attempts, b.successes AS opponent_successes FROM obs a JOIN obs b ON a.contest_id = b.contest_id AND a.opponent_id = b.entity_id"))
def opponent_join(spark: SparkSession, d: str) -> DataFrame:
    return pairs.opponent_columns(observations(spark, d), ["attempts", "successes"]).select(*ID, "opponent_attempts", "opponent_successes")


_LATERAL = """SELECT o.contest_id, o.entity_id, x.* FROM obs o, LATERAL (SELECT {agg} FROM (SELECT p.* FROM obs p WHERE p.entity_id = o.entity_id AND p.event_day < o.event_day ORDER BY p.event_day DESC, p.contest_id DESC LIMIT {n}) q) x"""


@query(with_obs(_LATERAL.format(n=3, agg="round(CASE WHEN sum(attempts) > 0 THEN sum(successes) / sum(attempts) END, 6) AS recent_accuracy, count(*) AS recent_contests, round(CASE WHEN count(won) > 0 THEN sum(won) / count(won) END, 6) AS recent_win_rate")))
def recent3_pooled(spark: SparkSession, d: str) -> DataFrame:
    out = history.recent(observations(spark, d), 3, ["attempts", "successes", "won"], "last")
    last = F.col("last")
    known = F.filter(last, lambda x: x["won"].isNotNull())
    wins = F.size(F.filter(known, lambda x: x["won"] == 1))
    return out.select(*ID, r6(history.pooled(last, "successes", "attempts")).alias("recent_accuracy"), F.size(last).cast("bigint").alias("recent_contests"), r6(F.when(F.size(known) > 0, wins / F.size(known))).alias("recent_win_rate"))


@query(with_obs(f"{_CAREER}, last5 AS ({_LATERAL.format(n=5, agg='CASE WHEN sum(attempts) > 0 THEN sum(successes) / sum(attempts) END AS a5')}) SELECT h.contest_id, h.entity_id, round(l.a5 - CASE WHEN h.attempts_sum > 0 THEN h.successes_sum / h.attempts_sum END, 6) AS form_delta FROM hist h JOIN last5 l USING (contest_id, entity_id)"))
def recent5_vs_career(spark: SparkSession, d: str) -> DataFrame:
    out = history.recent(history.career_rates(history.snapshots(observations(spark, d), history.career_specs())), 5, ["attempts", "successes"], "last")
    return out.select(*ID, r6(history.pooled(F.col("last"), "successes", "attempts") - F.col("accuracy")).alias("form_delta"))


@query(
    with_obs("""k AS (SELECT entity_id, event_day, contest_id, result, coalesce(won, -1) AS w FROM obs WHERE result <> 'no_contest'),
    g AS (SELECT *, sum(CASE WHEN w = 1 THEN 0 ELSE 1 END) OVER b AS gw, sum(CASE WHEN w = 0 THEN 0 ELSE 1 END) OVER b AS gl FROM k WINDOW b AS (PARTITION BY entity_id ORDER BY event_day, contest_id ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT *, sum(CASE WHEN w = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id, gw ORDER BY event_day, contest_id ROWS UNBOUNDED PRECEDING) AS ws,
        sum(CASE WHEN w = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id, gl ORDER BY event_day, contest_id ROWS UNBOUNDED PRECEDING) AS ls FROM g),
    e AS (SELECT entity_id, event_day, arg_max(ws, contest_id) AS ws, arg_max(ls, contest_id) AS ls FROM s GROUP BY ALL)
    SELECT o.contest_id, o.entity_id, CAST(coalesce(e.ws, 0) AS BIGINT) AS win_streak, CAST(coalesce(e.ls, 0) AS BIGINT) AS loss_streak
    FROM obs o ASOF LEFT JOIN e ON o.entity_id = e.entity_id AND o.event_day > e.event_day""")
)
def streaks(spark: SparkSession, d: str) -> DataFrame:
    return history.streaks(observations(spark, d)).select(*ID, "win_streak", "loss_streak")


@query(
    with_obs("""SELECT contest_id, entity_id, count(*) OVER y AS contests_12m, CAST(coalesce(sum(CASE WHEN won = 1 THEN 1 ELSE 0 END) OVER y, 0) AS BIGINT) AS wins_12m, count(*) OVER z AS contests_24m FROM obs
    WINDOW y AS (PARTITION BY entity_id ORDER BY event_day RANGE BETWEEN INTERVAL 12 MONTH PRECEDING AND INTERVAL 1 DAY PRECEDING), z AS (PARTITION BY entity_id ORDER BY event_day RANGE BETWEEN INTERVAL 24 MONTH PRECEDING AND INTERVAL 1 DAY PRECEDING)""")
)
def calendar_12_24m(spark: SparkSession, d: str) -> DataFrame:
    won = F.when(F.col("won") == 1, 1).otherwise(0)
    specs = [history.Spec("contests_12m", "count", F.lit(1), 12), history.Spec("wins_12m", "sum", won, 12), history.Spec("contests_24m", "count", F.lit(1), 24)]
    return history.snapshots(observations(spark, d), specs).select(*ID, "contests_12m", "wins_12m", "contests_24m")


@query(
    with_obs("""SELECT o.contest_id, o.entity_id, count(p.contest_id) FILTER (p.grp = o.grp) AS in_group_contests, CAST(count(p.contest_id) FILTER (p.grp = o.grp AND p.won = 1) AS BIGINT) AS in_group_wins, count(DISTINCT p.grp) AS groups_seen
    FROM obs o LEFT JOIN obs p ON p.entity_id = o.entity_id AND p.event_day < o.event_day GROUP BY ALL""")
)
def group_experience(spark: SparkSession, d: str) -> DataFrame:
    return history.group_experience(observations(spark, d)).select(*ID, "in_group_contests", "in_group_wins", "groups_seen")


@query(
    with_obs("""g AS (SELECT entity_id, event_day, arg_max(grp, contest_id) AS g FROM obs GROUP BY ALL)
    SELECT o.contest_id, o.entity_id, g.g AS previous_grp, CASE WHEN g.g IS NULL THEN 'debut_or_unknown' WHEN o.grp = g.g THEN 'same' WHEN '4-NOT SPECIFIED' IN (o.grp, g.g) THEN 'changed_unknown_direction'
        WHEN left(o.grp, 1) < left(g.g, 1) THEN 'up' ELSE 'down' END AS movement
    FROM obs o ASOF LEFT JOIN g ON o.entity_id = g.entity_id AND o.event_day > g.event_day""")
)
def group_movement(spark: SparkSession, d: str) -> DataFrame:
    ranks = {"1-URGENT": 4, "2-HIGH": 3, "3-MEDIUM": 2, "5-LOW": 1}
    return history.previous_group(observations(spark, d), ranks).select(*ID, "previous_grp", "movement")


@query(with_obs("SELECT contest_id, entity_id, coalesce(sum(attempts) OVER w, 0) AS prior_attempts, coalesce(sum(successes) OVER w, 0) AS prior_successes FROM obs WINDOW w AS (PARTITION BY entity_id ORDER BY event_day, contest_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
def row_shift_sums(spark: SparkSession, d: str) -> DataFrame:
    return history.row_shift(observations(spark, d), ["attempts", "successes"]).select(*ID, "prior_attempts", "prior_successes")


_CUTOFF = "1996-06-01"


@query(with_obs(f"SELECT entity_id, count(*) AS contests, CAST(sum(CASE WHEN won = 1 THEN 1 ELSE 0 END) AS BIGINT) AS wins, sum(attempts) AS attempts_sum, max(event_day) AS last_day FROM obs WHERE event_day < DATE '{_CUTOFF}' GROUP BY entity_id"))
def as_of_snapshot(spark: SparkSession, d: str) -> DataFrame:
    out = history.as_of(observations(spark, d), history.career_specs(), F.lit(_CUTOFF).cast("date"))
    return out.select("entity_id", "contests", "wins", "attempts_sum", "last_day")


@query(
    with_obs(f"""r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY event_day DESC, contest_id DESC) AS n FROM obs WHERE event_day < DATE '{_CUTOFF}')
    SELECT entity_id, contest_id, event_day, result, n AS place FROM r WHERE n <= 5""")
)
def topk_recent(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("entity_id").orderBy(F.desc("event_day"), F.desc("contest_id"))
    return observations(spark, d).filter(F.col("event_day") < F.lit(_CUTOFF).cast("date")).withColumn("place", F.row_number().over(w).cast("bigint")).filter("place <= 5").select("entity_id", "contest_id", "event_day", "result", "place")


@query("""WITH f AS (SELECT c_custkey AS k, CAST(o_orderdate AS DATE) AS d, max(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    a AS (SELECT o_orderkey, o_custkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders)
    SELECT a.o_orderkey, round(f.v, 2) AS last_price FROM a ASOF LEFT JOIN f ON a.k = f.k AND a.d > f.d""")
def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").alias("price"))
    known = o.join(load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    out = history.as_of_lookup(o.drop("price"), known, "o_custkey", "day", "day", ["price"])
    return out.select("o_orderkey", F.round("price", 2).alias("last_price"))


_VALID = "attempts > 0 AND successes >= 0 AND successes <= attempts"
_PRIOR = f"""
    dg AS (SELECT event_day, grp, sum(CASE WHEN {_VALID} THEN successes ELSE 0 END) AS n, sum(CASE WHEN {_VALID} THEN attempts ELSE 0 END) AS d FROM obs GROUP BY ALL),
    dd AS (SELECT event_day, sum(n) AS n, sum(d) AS d FROM dg GROUP BY ALL),
    gg AS (SELECT event_day, grp, coalesce(sum(n) OVER w, 0) AS dn, coalesce(sum(d) OVER w, 0) AS dd FROM dg WINDOW w AS (PARTITION BY grp ORDER BY event_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    al AS (SELECT event_day, coalesce(sum(n) OVER w, 0) AS gn, coalesce(sum(d) OVER w, 0) AS gd FROM dd WINDOW w AS (ORDER BY event_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    pr AS (SELECT o.*, CASE WHEN dd >= 500 THEN dn / dd WHEN gd > 0 THEN gn / gd ELSE 0.4 END AS prior, CASE WHEN dd >= 500 THEN 'group' WHEN gd > 0 THEN 'global' ELSE 'neutral' END AS prior_source,
        CASE WHEN dd >= 500 THEN dd WHEN gd > 0 THEN gd ELSE 0 END AS prior_den,
        coalesce(sum(CASE WHEN {_VALID} THEN successes END) {_STRICT}, 0) AS own_num, coalesce(sum(CASE WHEN {_VALID} THEN attempts END) {_STRICT}, 0) AS own_den
        FROM obs o JOIN gg USING (event_day, grp) JOIN al USING (event_day))"""


@query(with_obs(f"{_PRIOR} SELECT contest_id, entity_id, round(prior, 6) AS prior, prior_source, CAST(prior_den AS DOUBLE) AS prior_den FROM pr"))
def prior_ladder(spark: SparkSession, d: str) -> DataFrame:
    return shrinkage.prior_ladder(observations(spark, d), "successes", "attempts", 500, 0.4).select(*ID, r6("prior").alias("prior"), "prior_source", "prior_den")


@query(
    with_obs(f"""{_PRIOR} SELECT contest_id, entity_id, round(CASE WHEN own_den > 0 THEN own_num / own_den END, 6) AS raw_rate, round((own_num + 50 * prior) / (own_den + 50), 6) AS fixed_rate,
    round((own_num + greatest(50.0/3, least(50.0, 2500.0 / (own_den + 50))) * prior) / (own_den + greatest(50.0/3, least(50.0, 2500.0 / (own_den + 50)))), 6) AS scaled_rate,
    CASE WHEN own_den > 0 AND prior_source IN ('group', 'global') THEN prior_source ELSE 'prior_only' END AS source_label FROM pr""")
)
def smoothed_rates(spark: SparkSession, d: str) -> DataFrame:
    out = shrinkage.smoothing_family(observations(spark, d), "successes", "attempts", 50, 500, 0.4)
    return out.select(*ID, r6("raw_rate").alias("raw_rate"), r6("fixed_rate").alias("fixed_rate"), r6("scaled_rate").alias("scaled_rate"), "source_label")


_MOMENTS = f"""
    ed AS (SELECT entity_id, event_day, sum(successes) AS x, sum(attempts) AS n FROM obs WHERE {_VALID} GROUP BY ALL),
    et AS (SELECT entity_id, event_day, sum(x) OVER w AS x, sum(n) OVER w AS n FROM ed WINDOW w AS (PARTITION BY entity_id ORDER BY event_day ROWS UNBOUNDED PRECEDING)),
    ch AS (SELECT event_day, x - coalesce(lag(x) OVER w, 0) AS sx, n - coalesce(lag(n) OVER w, 0) AS sn, n * n - coalesce(lag(n * n) OVER w, 0) AS sn2, x * x / n - coalesce(lag(x * x / n) OVER w, 0) AS sxn, CASE WHEN lag(n) OVER w IS NULL THEN 1 ELSE 0 END AS c FROM et WINDOW w AS (PARTITION BY entity_id ORDER BY event_day)),
    pd AS (SELECT event_day, sum(sx) AS sx, sum(sn) AS sn, sum(sn2) AS sn2, sum(sxn) AS sxn, sum(c) AS c FROM ch GROUP BY ALL),
    al2 AS (SELECT DISTINCT event_day FROM obs),
    mo AS (SELECT event_day, coalesce(sum(sx) OVER w, 0) AS sum_x, coalesce(sum(sn) OVER w, 0) AS sum_n, coalesce(sum(sn2) OVER w, 0) AS sum_n2, coalesce(sum(sxn) OVER w, 0) AS sum_x2n, coalesce(sum(c) OVER w, 0) AS entities
        FROM al2 LEFT JOIN pd USING (event_day) WINDOW w AS (ORDER BY event_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(with_obs(f"{_MOMENTS} SELECT event_day, round(sum_x, 2) AS sum_x, round(sum_n, 2) AS sum_n, round(sum_n2, 2) AS sum_n2, round(sum_x2n, 2) AS sum_x2n, CAST(entities AS BIGINT) AS entities FROM mo"))
def population_moments(spark: SparkSession, d: str) -> DataFrame:
    m = shrinkage.population_moments(observations(spark, d), "successes", "attempts")
    return m.select("event_day", *[F.round(c, 2).alias(c) for c in ("sum_x", "sum_n", "sum_n2", "sum_x2n")], F.col("entities").cast("bigint"))


@query(
    with_obs(f"""{_MOMENTS}, q AS (SELECT *, CASE WHEN sum_n > 0 THEN sum_x / sum_n END AS p FROM mo),
    z AS (SELECT *, CASE WHEN p * (1 - p) > 0 AND sum_n - sum_n2 / sum_n - (entities - 1) > 0 THEN ((sum_x2n - sum_n * p * p) / (p * (1 - p)) - (entities - 1)) / (sum_n - sum_n2 / sum_n - (entities - 1)) END AS rho FROM q)
    SELECT event_day, round(CASE WHEN entities < 30 OR rho IS NULL THEN 50.0 WHEN rho <= 0 THEN 500.0 WHEN rho >= 1 THEN 5.0 ELSE greatest(5.0, least(500.0, (1 - rho) / rho)) END, 3) AS strength FROM z""")
)
def mom_strength_by_day(spark: SparkSession, d: str) -> DataFrame:
    m = shrinkage.population_moments(observations(spark, d), "successes", "attempts")
    k = shrinkage.mom_strength(F.col("sum_x"), F.col("sum_n"), F.col("sum_n2"), F.col("sum_x2n"), F.col("entities"), 50.0)
    return m.select("event_day", F.round(k, 3).alias("strength"))


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    """Both orientations of each contest with the win expectation that prior win counts give."""
    rows = pairs.mirrored(career_pairs(spark, d))
    p = S.expected_score(F.lit(1500.0) + 5 * (F.col("wins_a") - F.col("losses_a")), F.lit(1500.0) + 5 * (F.col("wins_b") - F.col("losses_b")))
    return rows.withColumn("probability", p)


_FORE = f"{_PAIRS}, fore AS (SELECT contest_id, event_day, label, 1 / (1 + pow(10.0, (5 * (wins_b - losses_b) - 5 * (wins_a - losses_a)) / 400)) AS probability FROM pairs)"


@query(
    with_obs(f"""{_FORE}, k AS (SELECT CAST(label AS DOUBLE) AS y, probability AS p FROM fore WHERE label IS NOT NULL),
    rk AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM k)
    SELECT count(*) AS n, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END), 6) AS accuracy,
        round((avg(CASE WHEN y = 1 THEN CASE WHEN p >= 0.5 THEN 1.0 ELSE 0 END END) + avg(CASE WHEN y = 0 THEN CASE WHEN p < 0.5 THEN 1.0 ELSE 0 END END)) / 2, 6) AS balanced_accuracy,
        round(avg(-(y * ln(greatest(1e-6, least(1 - 1e-6, p))) + (1 - y) * ln(1 - greatest(1e-6, least(1 - 1e-6, p))))), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier,
        round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auc FROM rk""")
)
def forecast_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.metrics(pairs.canonical_rows(forecasts(spark, d)))
    return m.select("n", *[r6(c).alias(c) for c in ("accuracy", "balanced_accuracy", "log_loss", "brier", "auc")])


def _calibration_sql(bins: int, b: str) -> str:
    return with_obs(f"""{_FORE}, g AS (SELECT CAST({b} AS BIGINT) AS bin, count(*) AS n, avg(probability) AS mp, avg(CAST(label AS DOUBLE)) AS ob FROM fore WHERE label IS NOT NULL GROUP BY 1)
        SELECT i AS bin, coalesce(n, 0) AS n, round(mp, 6) AS mean_probability, round(ob, 6) AS observed FROM range(1, {bins + 1}) t(i) LEFT JOIN g ON g.bin = t.i""")


@query(_calibration_sql(10, "greatest(1, ceil(probability * 10))"))
def calibration_10(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.calibration(pairs.canonical_rows(forecasts(spark, d)), 10).select("bin", "n", r6("mean_probability").alias("mean_probability"), r6("observed").alias("observed"))


@query(_calibration_sql(5, "least(5, floor(probability * 5) + 1)"))
def calibration_5(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.calibration(pairs.canonical_rows(forecasts(spark, d)), 5, right_closed=False).select("bin", "n", r6("mean_probability").alias("mean_probability"), r6("observed").alias("observed"))


@query(with_obs(f"{_FORE} SELECT count(*) AS n, CAST(0.0 AS DOUBLE) AS mean_error, CAST(0.0 AS DOUBLE) AS median_error, CAST(0.0 AS DOUBLE) AS max_error, CAST(0 AS BIGINT) AS over_005 FROM fore"))
def symmetry_error(spark: SparkSession, d: str) -> DataFrame:
    e = evaluate.symmetry_error(forecasts(spark, d))
    return e.select("n", *[r6(c).alias(c) for c in ("mean_error", "median_error", "max_error")], "over_005")


@query(with_obs(f"{_FORE} SELECT contest_id, CASE WHEN event_day < DATE '1997-01-01' THEN 'train' ELSE 'test' END AS split FROM fore"))
def chrono_split(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.holdout(career_pairs(spark, d), F.lit("1997-01-01").cast("date")).select("contest_id", "split")


@query(
    with_obs("""c AS (SELECT DISTINCT contest_id, event_day FROM obs), b AS (SELECT event_day, ntile(4) OVER (ORDER BY event_day) AS block FROM (SELECT DISTINCT event_day FROM c)),
    f AS (SELECT unnest([1, 2, 3]) AS fold)
    SELECT CAST(fold AS BIGINT) AS fold, CASE WHEN block = fold + 1 THEN 'test' ELSE 'train' END AS part, count(*) AS n, min(event_day) AS first_day, max(event_day) AS last_day FROM c JOIN b USING (event_day) JOIN f ON block <= fold + 1 GROUP BY ALL""")
)
def expanding_folds(spark: SparkSession, d: str) -> DataFrame:
    c = observations(spark, d).select("contest_id", "event_day").distinct()
    return evaluate.expanding_folds(c).groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), F.min("event_day").alias("first_day"), F.max("event_day").alias("last_day"))


@query(with_obs("d AS (SELECT event_day, row_number() OVER (ORDER BY event_day) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT event_day FROM obs)) SELECT event_day AS boundary FROM d WHERE i = least(floor(n * 0.8), n - 1)"))
def calibration_boundary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.calibration_day(observations(spark, d))


@query(
    with_obs("""d AS (SELECT event_day, sum(successes) AS s, count(*) AS n, row_number() OVER (ORDER BY event_day) - 1 AS i, count(*) OVER () AS days FROM obs GROUP BY event_day),
    k AS (SELECT r, k, days FROM range(50) t(r), (SELECT DISTINCT days FROM d), LATERAL (SELECT unnest(range(days)) AS k)),
    m AS (SELECT r, sum(s) / sum(n) AS m FROM k JOIN d ON d.i = CAST('0x' || substr(md5(r || '-' || k), 1, 8) AS BIGINT) % k.days GROUP BY r)
    SELECT (SELECT round(sum(s) / sum(n), 6) FROM d) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
)
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.day_bootstrap(observations(spark, d), "successes", 50).select(*[r6(c).alias(c) for c in ("mean", "low", "high")])


# contracts, joins, capture


@query("SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def contract_dups(spark: SparkSession, d: str) -> DataFrame:
    return contracts.duplicate_keys(load(spark, d, "orders"), ["o_custkey"]).select(F.col("o_custkey").alias("key"), "n")


@query("""SELECT key, side FROM (SELECT DISTINCT c_custkey AS key, 'left_only' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT DISTINCT o_custkey, 'right_only' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))""")
def contract_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return contracts.key_gaps(load(spark, d, "customer").select(F.col("c_custkey").alias("key")), load(spark, d, "orders").select(F.col("o_custkey").alias("key")), "key")


def _profile_sql(table: str, cols: dict[str, bool]) -> str:
    parts = []
    for c, num in cols.items():
        x = f"CAST({c} AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)"
        gone = f"{c} IS NULL" if num else f"({c} IS NULL OR lower(trim({c})) IN ('', 'nan', 'none', 'null', '--', '---'))"
        parts.append(f"SELECT '{c}' AS \"column\", count(*) AS rows, count_if({gone}) AS missing, count_if({x} = 0) AS zeros, count(DISTINCT {c}) AS \"distinct\", min({x}) AS low, max({x}) AS high, round(avg({x}), 4) AS mean FROM {table}")
    return f"""SELECT "column", CAST(rows AS BIGINT) AS rows, CAST(missing AS BIGINT) AS missing, CAST(coalesce(zeros, 0) AS BIGINT) AS zeros, "distinct", low, high, mean,
        CASE WHEN rows = missing THEN 'empty' WHEN "distinct" <= 1 THEN 'constant' WHEN missing / greatest(rows, 1) > 0.5 THEN 'sparse' WHEN missing / greatest(rows, 1) > 0.05 THEN 'partial' ELSE 'good' END AS usability FROM ({" UNION ALL ".join(parts)})"""


@query(_profile_sql("part", {"p_partkey": True, "p_name": False, "p_brand": False, "p_size": True, "p_retailprice": True}))
def contract_profile(spark: SparkSession, d: str) -> DataFrame:
    out = contracts.column_profile(load(spark, d, "part"), ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"])
    return out.withColumn("mean", F.round("mean", 4)).drop("missing_share")


@query("SELECT CAST(count(o_orderdate) AS BIGINT) AS valid, CAST(0 AS BIGINT) AS invalid, CAST(count_if(CAST(o_orderdate AS DATE) > DATE '1997-01-01') AS BIGINT) AS future, min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day FROM orders")
def contract_dates(spark: SparkSession, d: str) -> DataFrame:
    return contracts.date_profile(load(spark, d, "orders"), "o_orderdate", F.lit("1997-01-01").cast("date"))


@query("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1")
def contract_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return contracts.value_counts(load(spark, d, "customer"), "c_mktsegment")


@query(with_obs("SELECT contest_id, count(*) AS n, 'rows' AS reason FROM obs GROUP BY 1 HAVING count(*) <> 2"))
def pair_integrity(spark: SparkSession, d: str) -> DataFrame:
    return contracts.pair_integrity(observations(spark, d))


@query("""SELECT l_orderkey AS key, 'l_quantity' AS "column", l_quantity AS value FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT l_orderkey, 'l_discount', l_discount FROM lineitem WHERE l_discount < 0.01""")
def range_violations(spark: SparkSession, d: str) -> DataFrame:
    return contracts.range_violations(load(spark, d, "lineitem").withColumnRenamed("l_orderkey", "key"), {"l_quantity": (None, 45), "l_discount": (0.01, None)}, "key")


def perturbed(o: DataFrame) -> DataFrame:
    """A later state of orders: every 7th is gone, every 11th has a new price, a few are new."""
    k = F.col("o_orderkey")
    changed = o.filter(k % 7 != 0).withColumn("o_totalprice", F.when(k % 11 == 0, F.round(F.col("o_totalprice") + 1, 2)).otherwise(F.col("o_totalprice")))
    return changed.unionByName(o.filter(k % 13 == 0).withColumn("o_orderkey", k + 100_000_000))


_PERT = """n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN round(o_totalprice + 1, 2) ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0
    UNION ALL SELECT o_orderkey + 100000000, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 13 = 0)"""


@query(f"""WITH {_PERT} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey,
    CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed' ELSE 'corrected' END AS change, CASE WHEN o.o_orderkey IS NOT NULL AND n.o_orderkey IS NOT NULL THEN 'o_totalprice' END AS "column"
    FROM orders o FULL JOIN n ON o.o_orderkey = n.o_orderkey WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.o_totalprice <> n.o_totalprice""")
def keyed_diff(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return capture.keyed_diff(o, perturbed(o), ["o_orderkey"], ["o_totalprice", "o_orderstatus"]).select("o_orderkey", "change", "column")


@query(f"WITH {_PERT} SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM n UNION ALL SELECT o_orderkey, round(o_totalprice, 2) FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n)")
def upsert_replace(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return capture.upsert(o, perturbed(o), ["o_orderkey"]).select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query(with_obs("SELECT contest_id, entity_id, attempts + CASE WHEN event_day >= DATE '1997-01-01' THEN 1 ELSE 0 END AS attempts FROM obs"))
def suffix_rebuild(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d).select(*ID, "event_day", "attempts")
    return capture.rebuild_suffix(o, o.withColumn("attempts", F.col("attempts") + 1), F.lit("1997-01-01").cast("date")).drop("event_day")


@query(f"""WITH {_PERT} SELECT n.o_orderkey, CASE WHEN n.o_totalprice < 5000 THEN 'invalid' WHEN o.o_orderkey IS NULL THEN 'new' WHEN n.o_totalprice = o.o_totalprice THEN 'duplicate' ELSE 'conflict' END AS class FROM n LEFT JOIN orders o USING (o_orderkey)""")
def import_classes(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return capture.import_classes(o, perturbed(o), "o_orderkey", ["o_totalprice", "o_orderstatus"], F.col("o_totalprice") >= 5000)


@query("""WITH r AS (SELECT *, row_number() OVER w AS n, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC))
    SELECT o_orderkey, o_custkey FROM r WHERE n <= 5 AND s <= 300000""")
def retention_budget(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    return capture.retain_newest(o, [F.desc("o_orderdate"), F.desc("o_orderkey")], "o_totalprice", 5, 300000, "o_custkey").select("o_orderkey", "o_custkey")


@query("""WITH e AS (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events), k AS (SELECT * FROM e WHERE event_id % 211 <> 5)
    SELECT event_id, CASE WHEN event_id % 101 = 7 THEN 'content' ELSE 'link' END AS reason FROM k WHERE event_id % 101 = 7 OR before % 211 = 5""")
def ledger_verify(spark: SparkSession, d: str) -> DataFrame:
    """A hash-chained ledger in which some payloads were forged and some rows taken out."""
    e = load(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    ledger = capture.chained(e, "user_id", "event_id", ["event_type", "value"]).filter("event_id % 211 <> 5")
    forged = ledger.withColumn("event_type", F.when(F.col("event_id") % 101 == 7, "forged").otherwise(F.col("event_type")))
    return capture.broken_links(forged, "user_id", "event_id", ["event_type", "value"]).select("event_id", "reason")


# scalars and text


@query("""SELECT o_orderkey, CASE WHEN x IS NULL THEN 'debut' WHEN x <= 90 THEN '0_90' WHEN x <= 180 THEN '91_180' WHEN x <= 365 THEN '181_365' WHEN x <= 730 THEN '366_730' ELSE '731_plus' END AS layoff,
    CASE WHEN x / 30.0 IS NULL THEN 'unknown' WHEN x / 30.0 < 25 THEN 'under_25' WHEN x / 30.0 <= 34 THEN '25_34' WHEN x / 30.0 <= 39 THEN '35_39' ELSE '40_plus' END AS age
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) - lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS x FROM orders)""")
def scalar_buckets(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    day = F.col("o_orderdate").cast("date")
    x = load(spark, d, "orders").withColumn("x", F.datediff(day, F.lag(day).over(w)))
    return x.select("o_orderkey", S.layoff_bucket(F.col("x")).alias("layoff"), S.age_bucket(F.col("x") / 30).alias("age"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS made, CAST(l_partkey AS BIGINT) AS tried, CAST((l_linenumber - 1) * 300 + (l_orderkey % 5) * 60 + l_partkey % 60 AS BIGINT) AS seconds FROM lineitem")
def scalar_parse(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    pair = S.parse_of_pair(F.format_string("%d of %d", F.col("l_quantity").cast("int"), F.col("l_partkey")))
    clock = F.format_string("%d:%02d", F.col("l_orderkey") % 5, F.col("l_partkey") % 60)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", pair["made"].alias("made"), pair["tried"].alias("tried"), S.elapsed_seconds(F.col("l_linenumber"), clock).alias("seconds"))


@query("SELECT s_suppkey, n_name || '_vs_' || s_name AS text, s_name || '_vs_' || n_name AS reversed FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def text_pair_reverse(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "supplier").join(load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    text = S.pair_text(F.col("n_name"), F.col("s_name"))
    return s.select("s_suppkey", text.alias("text"), S.reverse_pair_text(text).alias("reversed"))


@query("""SELECT contest_id, round(1 / da / (1 / da + 1 / db), 6) AS market_a, CASE WHEN abs(p) < 0.03 THEN 'aligned' ELSE (CASE WHEN abs(p) < 0.07 THEN 'small' WHEN abs(p) < 0.12 THEN 'medium' ELSE 'large' END) || CASE WHEN p > 0 THEN '_a' ELSE '_b' END END AS edge
    FROM (SELECT *, 0.5 - 1 / da / (1 / da + 1 / db) AS p FROM (SELECT o_orderkey AS contest_id, 1.2 + (o_orderkey % 17) / 10.0 AS da, 1.2 + (o_custkey % 13) / 10.0 AS db FROM orders))""")
def odds_no_vig(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("contest_id"), (F.lit(1.2) + (F.col("o_orderkey") % 17) / 10).alias("da"), (F.lit(1.2) + (F.col("o_custkey") % 13) / 10).alias("db"))
    a, _ = S.no_vig(S.decimal_odds(F.col("da").cast("string")), S.decimal_odds(F.col("db").cast("string")))
    return o.select("contest_id", r6(a).alias("market_a"), S.edge_label(F.lit(0.5) - a, F.lit("High")).alias("edge"))


@query("""SELECT p_partkey, list_aggregate([1], 'sum') * round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part)""")
def token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", r6(S.token_jaccard(S.name_key(F.col("p_name")), S.name_key(F.col("p_type")))).alias("jaccard"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS BIGINT) AS links FROM pages""")
def page_titles_links(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).cast("bigint").alias("links"))
