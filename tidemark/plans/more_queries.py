"""Further registered queries: comparisons, names, pages, streams, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import capture, compare, evaluate, models, names
from ..operators.graph import Steps
from ..sources import pages, tables
from ..streaming import twins
from .contests import load, observations
from .queries import _CUTOFF, PAIR_FEATURES, career_pairs, query, r6, with_obs

_SIDE = "SELECT entity_id, count(*) AS contests, sum(CASE WHEN won = 1 THEN 1.0 ELSE 0 END) AS wins, sum(CASE WHEN won = 0 THEN 1.0 ELSE 0 END) AS losses, sum(attempts) AS att, sum(successes) AS su, sum(seconds) AS se, max(event_day) AS ld FROM obs WHERE event_day < DATE '1996-06-01' AND entity_id IN (1, 2) GROUP BY 1"
_LONG = " UNION ALL ".join(
    f"SELECT entity_id, '{m}' AS metric, CAST({x} AS DOUBLE) AS v FROM s"
    for m, x in (("contests", "contests"), ("wins", "wins"), ("losses", "losses"), ("win_rate", "CASE WHEN wins + losses > 0 THEN wins / (wins + losses) END"), ("accuracy", "CASE WHEN att > 0 THEN su / att END"), ("per_minute", "CASE WHEN se > 0 THEN su / (se / 60) END"), ("days_since_last", "DATE '1996-06-01' - ld"))
)


@query(with_obs(f"s AS ({_SIDE}), l AS ({_LONG}) SELECT metric, round(max(v) FILTER (entity_id = 1), 6) AS a, round(max(v) FILTER (entity_id = 2), 6) AS b, round(max(v) FILTER (entity_id = 1) - max(v) FILTER (entity_id = 2), 6) AS diff FROM l GROUP BY metric"))
def compare_as_of(spark: SparkSession, d: str) -> DataFrame:
    out = compare.compare(observations(spark, d), 1, 2, F.lit(_CUTOFF).cast("date"))
    return out.select("metric", r6("a").alias("a"), r6("b").alias("b"), r6("diff").alias("diff"))


@query(with_obs(f"SELECT entity_id, count(*) AS contests, max(event_day) AS last_day, arg_max(grp, (event_day, contest_id)) AS last_grp, CAST(count(*) FILTER (grp = '1-URGENT') AS BIGINT) AS in_group FROM obs WHERE event_day < DATE '{_CUTOFF}' GROUP BY 1"))
def entity_coverage(spark: SparkSession, d: str) -> DataFrame:
    return compare.coverage(observations(spark, d), F.lit(_CUTOFF).cast("date"), "1-URGENT")


@query(with_obs(f"l AS (SELECT entity_id, arg_max(grp, (event_day, contest_id)) AS g FROM obs WHERE event_day < DATE '{_CUTOFF}' AND entity_id IN (1, 2) GROUP BY 1), p AS (SELECT max(g) FILTER (entity_id = 1) AS a, max(g) FILTER (entity_id = 2) AS b FROM l) SELECT CASE WHEN a = b THEN a WHEN b IS NULL THEN coalesce(a, 'Unknown') WHEN a IS NULL THEN b ELSE 'Unknown' END AS grp, CASE WHEN a IS NULL AND b IS NULL THEN 'no_history' WHEN a IS NULL OR b IS NULL THEN 'one_side_only' WHEN a <> b THEN 'groups_differ' END AS warning FROM p"))
def group_inference(spark: SparkSession, d: str) -> DataFrame:
    return compare.infer_group(observations(spark, d), 1, 2, F.lit(_CUTOFF).cast("date"))


@query("""WITH o AS (SELECT c_custkey AS metric, c_acctbal AS value, c_mktsegment AS unit FROM customer), n AS (SELECT metric + 10 AS metric, value, unit FROM o WHERE metric % 9 <> 0),
    b AS (SELECT coalesce(o.metric, n.metric) AS metric, o.value AS ov, n.value AS nv, o.unit AS ou, n.unit AS nu, o.metric IS NOT NULL AS io, n.metric IS NOT NULL AS inn FROM o FULL JOIN n ON o.metric = n.metric)
    SELECT metric, CASE WHEN NOT io THEN 'added' WHEN NOT inn THEN 'removed' WHEN ou IS DISTINCT FROM nu THEN 'not_comparable' WHEN ov = nv THEN 'same' ELSE 'changed' END AS status, round(CASE WHEN ou IS NOT DISTINCT FROM nu THEN nv - ov END, 4) AS delta FROM b""")
def report_diff(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "customer").select(F.col("c_custkey").alias("metric"), F.col("c_acctbal").alias("value"), F.col("c_mktsegment").alias("unit"))
    n = o.filter("metric % 9 <> 0").withColumn("metric", F.col("metric") + 10)
    return compare.compare_reports(o, n, same=("unit",)).withColumn("delta", F.round("delta", 4))


@query("""SELECT o_orderkey, greatest(0, 100 - CASE WHEN o_totalprice < 20000 THEN 30 ELSE 0 END - CASE WHEN o_orderstatus = 'O' THEN 20 ELSE 0 END) AS reliability_score,
    CASE WHEN 100 - CASE WHEN o_totalprice < 20000 THEN 30 ELSE 0 END - CASE WHEN o_orderstatus = 'O' THEN 20 ELSE 0 END >= 75 THEN 'High' WHEN 100 - CASE WHEN o_totalprice < 20000 THEN 30 ELSE 0 END - CASE WHEN o_orderstatus = 'O' THEN 20 ELSE 0 END >= 55 THEN 'Medium' ELSE 'Low' END AS reliability FROM orders""")
def reliability_score(spark: SparkSession, d: str) -> DataFrame:
    rules = {"cheap": (F.col("o_totalprice") < 20000, 30), "open": (F.col("o_orderstatus") == "O", 20)}
    return compare.reliability(load(spark, d, "orders"), rules).select("o_orderkey", "reliability_score", "reliability")


@query("""WITH k AS (SELECT lower(p_name) AS nm, count(DISTINCT p_partkey) AS n, min(p_partkey) AS id FROM part GROUP BY 1), q AS (SELECT DISTINCT upper(p_name) AS name FROM part UNION SELECT 'no such part')
    SELECT q.name, CASE WHEN n = 1 THEN id END AS entity_id, CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status FROM q LEFT JOIN k ON lower(q.name) = k.nm""")
def name_resolution(spark: SparkSession, d: str) -> DataFrame:
    part = load(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("entity_id"))
    asked = part.select(F.upper("name").alias("name")).unionByName(spark.createDataFrame([("no such part",)], "name string")).distinct()
    return names.resolve(asked, part)


@query("SELECT DISTINCT p_name AS name FROM part WHERE contains(lower(p_name), 'al') ORDER BY lower(p_name) <> 'al', NOT starts_with(lower(p_name), 'al'), p_name LIMIT 10")
def search_topk(spark: SparkSession, d: str) -> DataFrame:
    return names.search(load(spark, d, "part").select(F.col("p_name").alias("name")), "al", 10)


@query()
def close_matches(spark: SparkSession, d: str) -> DataFrame:
    return names.close_matches(load(spark, d, "part").select(F.col("p_name").alias("name")), "royal red", 0.4, 5)


@query("""WITH k AS (SELECT lower(p_brand) AS name_key, p_size AS entity_id, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY n DESC, entity_id) AS i FROM k) SELECT name_key, entity_id, n FROM r WHERE i = 1""")
def name_majority(spark: SparkSession, d: str) -> DataFrame:
    return names.majority_ids(load(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_size").alias("entity_id")))


@query("""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<a\\s[^>]*href="[^"]*"[^>]*>.*?</a>')) AS x FROM pages) SELECT page_id, regexp_extract(x, 'href="([^"]*)"', 1) AS href FROM a""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return pages.links(load(spark, d, "pages")).select("page_id", "href")


@query("SELECT 'orders' AS name, count(*) AS rows, CAST(max(o_orderdate) AS DATE) AS last_day, CAST(0 AS BIGINT) AS bad_dates FROM orders")
def table_facts(spark: SparkSession, d: str) -> DataFrame:
    return tables.table_facts(load(spark, d, "orders"), "orders", "o_orderdate").drop("columns")


@query(with_obs("f AS (SELECT contest_id, list(struct_pack(attempts := attempts, entity_id := entity_id, result := result, successes := successes) ORDER BY attempts, entity_id, result, successes) AS l FROM obs GROUP BY 1) SELECT contest_id, sha256(CAST(to_json(l) AS VARCHAR)) AS sha FROM f"))
def contest_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return capture.contest_fingerprints(observations(spark, d), ["entity_id", "attempts", "successes", "result"])


@query("SELECT (SELECT count(*) FROM orders) AS forecasts, (SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS scored, round(avg((0.6 - y) * (0.6 - y)), 6) AS brier FROM (SELECT l_orderkey, arg_max(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END, (l_linenumber, l_partkey, l_suppkey)) AS y FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1)")
def ledger_scores(spark: SparkSession, d: str) -> DataFrame:
    f = load(spark, d, "orders").select(F.col("o_orderkey").alias("forecast_id"), F.lit(0.6).alias("probability"))
    o = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("forecast_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("outcome"))
    return evaluate.ledger_scores(f, o).withColumn("brier", F.round("brier", 6))


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = load(spark, d, "events").schema
    return twins.stamped(spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet"))


@query("""SELECT user_id, event_id, CAST(ts AS DATE) AS day, count(*) OVER w AS events_before, round(coalesce(sum(value) OVER w, 0), 4) AS value_before FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY CAST(ts AS DATE) RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)""")
def stream_history(spark: SparkSession, d: str) -> DataFrame:
    out = twins.run_frozen_history(event_stream(spark, d), "tidemark_history")
    return out.withColumn("value_before", F.round("value_before", 4))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = twins.run_available(twins.tumbling(event_stream(spark, d)), "tidemark_tumbling", "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    out = twins.run_available(twins.sessions(event_stream(spark, d)), "tidemark_sessions", "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT event_id, user_id FROM events")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    e = event_stream(spark, d)
    return twins.run_available(twins.distinct_events(e.unionByName(e)).select("event_id", "user_id"), "tidemark_dedupe")


NUMERIC = [f"{f}_diff" for f in PAIR_FEATURES]


@query()
def logit_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = Steps(spark, "logit").write(evaluate.holdout(career_pairs(spark, d), F.lit("1999-01-01").cast("date")))  # fitting passes over them many times
    model = models.fit_calibrated(rows.filter("split = 'train'"), "logistic", NUMERIC)
    scored = models.score_both_ways(model, rows.filter("split = 'test'"))
    return scored.select("contest_id", "label", r6("probability").alias("probability"))

