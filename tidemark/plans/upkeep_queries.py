"""Registered queries for ingest, upkeep of tables, evidence, name resolution, folds and weights, each with its SQL twin."""

from __future__ import annotations

import datetime as dt

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates, capture, compare, contracts, evaluate, evidence, history, ingest, maintenance, models, names, pairs, ratings, shrinkage
from ..operators.graph import Steps
from ..streaming import twins
from .aggregate_queries import rating_sides, rating_sides_sql
from .contests import load, observations
from .queries import _CUTOFF, _FORE, _PAIRS, _STRICT, ID, PAIR_FEATURES, career_pairs, doubles, forecasts, query, r6, with_obs

# ingest: observations with planted faults


def faulty(spark: SparkSession, d: str) -> DataFrame:
    """Observations of which some lack an id, a day or a label, meet themselves, lie in the future or have impossible counts."""
    o, k = observations(spark, d), F.col("contest_id")
    return o.withColumns(
        {
            "entity_id": F.when(k % 101 != 0, F.col("entity_id")),
            "opponent_id": F.when(k % 97 == 0, F.col("entity_id")).otherwise(F.col("opponent_id")),
            "event_day": F.when(k % 89 != 0, F.col("event_day")),
            "result": F.when(k % 83 == 0, "tba").otherwise(F.col("result")),
            "won": F.when(k % 79 == 0, 1).otherwise(F.col("won")),
            "successes": F.when(k % 73 == 0, F.col("attempts") + 1).otherwise(F.col("successes")),
            "seconds": F.when(k % 71 == 0, -1.0).otherwise(F.col("seconds")),
        }
    )


_FAULTY = """fy AS (SELECT contest_id, CASE WHEN contest_id % 101 <> 0 THEN entity_id END AS entity_id, CASE WHEN contest_id % 97 = 0 THEN entity_id ELSE opponent_id END AS opponent_id, CASE WHEN contest_id % 89 <> 0 THEN event_day END AS event_day,
    CASE WHEN contest_id % 83 = 0 THEN 'tba' ELSE result END AS result, CASE WHEN contest_id % 79 = 0 THEN 1 ELSE won END AS won, attempts, CASE WHEN contest_id % 73 = 0 THEN attempts + 1 ELSE successes END AS successes, CASE WHEN contest_id % 71 = 0 THEN -1 ELSE seconds END AS seconds FROM obs),
    fo AS (SELECT contest_id, entity_id FROM obs),
    au AS (SELECT f.*, list_filter([CASE WHEN f.entity_id IS NULL THEN 'no_entity' END, CASE WHEN f.entity_id = f.opponent_id THEN 'same_sides' END, CASE WHEN event_day IS NULL THEN 'no_day' END, CASE WHEN event_day > DATE '1998-01-01' THEN 'future_day' END, CASE WHEN result = 'tba' THEN 'unknown_result' END,
        CASE WHEN won IS DISTINCT FROM (CASE result WHEN 'win' THEN 1 WHEN 'loss' THEN 0 END) THEN 'label_differs' END, CASE WHEN successes > attempts THEN 'more_successes' END, CASE WHEN seconds < 0 THEN 'negative' END], lambda x: x IS NOT NULL) AS reasons FROM fy f)"""
_TODAY = "1998-01-01"


@query(with_obs(f"{_FAULTY} SELECT code, count(*) AS rows, count(DISTINCT contest_id) AS contests FROM (SELECT contest_id, unnest(reasons) AS code FROM au) GROUP BY 1"))
def ingest_audit(spark: SparkSession, d: str) -> DataFrame:
    """Rows and contests by reason code."""
    return ingest.audit_summary(ingest.audit(faulty(spark, d), ingest.observation_rules(F.lit(_TODAY).cast("date"))))


@query(with_obs(f"{_FAULTY} SELECT 'kept' AS part, count(*) AS rows FROM au WHERE len(reasons) = 0 UNION ALL SELECT 'quarantined', count(*) FROM au WHERE len(reasons) > 0"))
def ingest_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Rows that may be added, and those kept back; a bad row doesn't stop the others."""
    kept, bad = ingest.quarantine(ingest.audit(faulty(spark, d), ingest.observation_rules(F.lit(_TODAY).cast("date"))))
    count = lambda df, part: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(part).alias("part"), "rows")
    return count(kept, "kept").unionByName(count(bad, "quarantined"))


@query(with_obs(f"""{_FAULTY}, g AS (SELECT contest_id, count(*) AS n, count(DISTINCT event_day) AS days, count(DISTINCT entity_id) AS e, count_if(result = 'win') AS w, count_if(result = 'loss') AS l, count(DISTINCT result) AS rs FROM fy WHERE contest_id % 11 <> 0 OR result <> 'loss' GROUP BY 1)
    SELECT contest_id, n, CASE WHEN n <> 2 THEN 'rows' WHEN days > 1 THEN 'days' WHEN e <> 2 THEN 'entities' ELSE 'outcome' END AS reason FROM g WHERE n <> 2 OR days > 1 OR e <> 2 OR w <> l OR w > 1 OR (w = 0 AND rs > 1)"""))
def ingest_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Contests whose rows don't fit together."""
    return contracts.pair_integrity(faulty(spark, d).filter("contest_id % 11 <> 0 or result <> 'loss'"))


@query("SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS event_day FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-03-01' AND DATE '1995-04-01' ORDER BY 2, 1 LIMIT 20")
def ingest_day_range(spark: SparkSession, d: str) -> DataFrame:
    """The range comes before the limit."""
    e = load(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").cast("date").alias("event_day"))
    day = lambda x: F.lit(x).cast("date")
    return ingest.select_days(e, day("1995-03-01"), day("1995-04-01"), 20)


@query(with_obs(f"{_PAIRS} SELECT contest_id, label FROM pairs WHERE event_day <= DATE '1997-05-31' AND label IS NOT NULL"))
def learnable_rows(spark: SparkSession, d: str) -> DataFrame:
    """The cutoff for a past contest is the day before; rows up to it, after the guards; later ones only where allowed."""
    cutoff = ingest.training_cutoff(dt.date(1997, 6, 1), dt.date(2000, 1, 1))
    return ingest.learnable(career_pairs(spark, d), F.lit(cutoff), allow_later=True, least_rows=20, least_contests=10).select("contest_id", "label")


@query("SELECT s_suppkey AS entity_id, 'known' AS status FROM supplier WHERE s_suppkey % 3 <> 0 UNION SELECT l_suppkey, 'missing' FROM lineitem WHERE l_suppkey % 3 = 0 OR l_suppkey NOT IN (SELECT s_suppkey FROM supplier)")
def new_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Ids that no profile has get a stub."""
    known = load(spark, d, "supplier").filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("entity_id"))
    return ingest.new_entities(load(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity_id")), known)


def recaptured(obs: DataFrame) -> DataFrame:
    """Some contests captured anew, with other attempts."""
    return obs.filter("contest_id % 10 = 0").withColumn("attempts", F.col("attempts") + F.when(F.col("contest_id") % 20 == 0, 1.0).otherwise(0.0))


@query(with_obs("SELECT contest_id, entity_id, 'corrected' AS change, 'attempts' AS \"column\" FROM obs WHERE contest_id % 20 = 0"))
def correction_preview(spark: SparkSession, d: str) -> DataFrame:
    """M03, ST3: what a recapture changes, after its integrity checks."""
    o = observations(spark, d)
    return ingest.preview_correction(o, recaptured(o), ["attempts", "successes"]).select("contest_id", "entity_id", "change", "column")


@query(with_obs("f AS (SELECT contest_id, entity_id, event_day, attempts + CASE WHEN contest_id % 20 = 0 THEN 1 ELSE 0 END AS attempts FROM obs) SELECT contest_id, entity_id, coalesce(sum(attempts) OVER (PARTITION BY entity_id ORDER BY event_day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS attempts_sum FROM f"))
def correction_applied(spark: SparkSession, d: str) -> DataFrame:
    """Derived rows after a correction: rebuilt from the first changed day on, equal to a full rebuild."""
    o = observations(spark, d)
    rebuild = lambda x: history.snapshots(x, [history.Spec("attempts_sum", "sum", F.col("attempts"))]).select(*ID, "event_day", "attempts_sum")
    return ingest.apply_correction(o, recaptured(o), ["attempts", "successes"], rebuild(o), rebuild)[1].drop("event_day")


# joins and profiles


@query(with_obs(f"{_PAIRS} SELECT contest_id, entity_a, entity_b, wins_a AS a_wins, wins_b AS b_wins FROM (SELECT contest_id, entity_a, entity_b, wins_a, wins_b FROM pairs)"))
def sides_attached(spark: SparkSession, d: str) -> DataFrame:
    """Both sides' snapshots joined to pairs under prefixed names."""
    snap = history.snapshots(observations(spark, d), history.career_specs()).select(*ID, F.col("wins").cast("double").alias("wins"))
    p = career_pairs(spark, d).select("contest_id", "entity_a", "entity_b")
    return pairs.attach_sides(p, snap)


_ASKED = "SELECT o_orderkey AS k, o_custkey AS entity_id FROM orders"


@query(f"""WITH a AS ({_ASKED}), p AS (SELECT c_custkey AS entity_id, c_name, row_number() OVER (PARTITION BY c_custkey % 50 ORDER BY c_custkey) AS rn FROM customer) SELECT a.k, a.entity_id, p.c_name FROM a LEFT JOIN (SELECT entity_id % 50 AS e, c_name FROM p WHERE rn = 1) p ON a.entity_id % 50 = p.e""")
def profile_join(spark: SparkSession, d: str) -> DataFrame:
    """The first of duplicate profiles, then a left join that has checked its keys."""
    profiles = contracts.first_by(load(spark, d, "customer").select((F.col("c_custkey") % 50).alias("e"), "c_custkey", "c_name"), ["e"], ["c_custkey"]).drop("c_custkey")
    asked = load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("entity_id"), (F.col("o_custkey") % 50).alias("e"))
    return contracts.checked_left_join(asked, profiles, ["e"]).drop("e")


@query("""WITH a AS (SELECT o_custkey AS k, arg_max(o_orderpriority, o_orderkey) FILTER (o_orderkey % 3 <> 0) AS p, arg_max(o_totalprice, o_orderkey) AS t FROM orders GROUP BY 1),
    b AS (SELECT o_custkey AS k, arg_max('late ' || o_orderstatus, o_orderkey) AS p FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1) SELECT coalesce(a.k, b.k) AS o_custkey, coalesce(b.p, a.p) AS p, a.t AS t FROM a FULL JOIN b ON a.k = b.k""")
def profile_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Of each field the last known value in the source of highest priority."""
    o, k = load(spark, d, "orders"), F.col("o_orderkey")
    low = o.select("o_custkey", k, F.when(k % 3 != 0, F.col("o_orderpriority")).alias("p"), F.col("o_totalprice").alias("t"))
    high = o.filter(k % 5 == 0).select("o_custkey", k, F.concat(F.lit("late "), "o_orderstatus").alias("p"), F.lit(None).cast("double").alias("t"))
    return names.overlay(low, high, key="o_custkey", order="o_orderkey", fields=["p", "t"])


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS x, c_mktsegment AS y, CAST(NULL AS VARCHAR) AS z FROM customer")
def absent_filled(spark: SparkSession, d: str) -> DataFrame:
    """Only columns that the snapshot lacks altogether come from the fallback, by alias if need be."""
    c = load(spark, d, "customer")
    snap = c.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("x"))
    return names.fill_absent(snap, c.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"), F.col("c_mktsegment").alias("old_y")), "k", ["x", "y", "z"], {"y": ["old_y"]})


# names: parts' names of two or three words

_NAMES = "SELECT DISTINCT p_name || CASE WHEN p_partkey % 4 = 0 THEN ' ' || p_brand ELSE '' END AS name FROM part"
_REQUESTS = "SELECT DISTINCT upper(string_split(p_name, ' ')[-1]) || ' ' || string_split(p_name, ' ')[1] || CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_brand ELSE '' END AS name FROM part WHERE p_partkey % 5 = 0"


def part_names(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select(F.concat("p_name", F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" "), "p_brand")).otherwise("")).alias("name")).distinct()


def part_requests(spark: SparkSession, d: str) -> DataFrame:
    w = F.split("p_name", " ")
    name = F.concat(F.upper(F.element_at(w, -1)), F.lit(" "), w[0], F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), "p_brand")).otherwise(""))
    return load(spark, d, "part").filter("p_partkey % 5 = 0").select(name.alias("name")).distinct()


_WORDS = f"""c AS (SELECT name, list_distinct(string_split(lower(name), ' ')) AS w FROM ({_NAMES})), q AS (SELECT name, list_distinct(string_split(lower(name), ' ')) AS w FROM ({_REQUESTS})),
    j AS (SELECT q.name AS request, c.name, len(list_intersect(q.w, c.w)) AS common, len(q.w) AS n, len(list_intersect(q.w, c.w)) / len(list_distinct(list_concat(q.w, c.w))) AS jaccard, lower(q.name) = lower(c.name) AS equal FROM q, c)"""


@query(f"WITH {_WORDS}, r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY jaccard DESC, name) AS i FROM j WHERE jaccard > 0.3) SELECT request, name, round(jaccard, 6) AS jaccard FROM r WHERE i <= 3")
def name_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """the names with most words in common."""
    return names.token_suggestions(part_requests(spark, d), part_names(spark, d), 0.3).withColumn("jaccard", r6("jaccard"))


@query(f"""WITH {_WORDS}, b AS (SELECT request AS name, count_if(equal) AS ne, max(CASE WHEN equal THEN name END) AS e, count_if(common = n) AS na, max(CASE WHEN common = n THEN name END) AS h, list_sort(list(jaccard) FILTER (common >= greatest(2, n - 1)), 'DESC') AS js,
    arg_max(name, (jaccard, name)) FILTER (common >= greatest(2, n - 1)) AS top FROM j WHERE common > 0 GROUP BY request),
    k AS (SELECT *, CASE WHEN ne = 1 THEN 'equal' WHEN ne = 0 AND na = 1 THEN 'holds' WHEN ne = 0 AND top IS NOT NULL AND (len(js) = 1 OR js[1] > js[2]) THEN 'overlap' ELSE 'unresolved' END AS how FROM b)
    SELECT q.name, coalesce(how, 'unresolved') AS how, CASE how WHEN 'equal' THEN e WHEN 'holds' THEN h WHEN 'overlap' THEN top END AS canonical FROM q LEFT JOIN k USING (name)""")
def name_tokens(spark: SparkSession, d: str) -> DataFrame:
    """An equal name, else the only one with all words, else the one with most of them."""
    return names.resolve_tokens(part_requests(spark, d), part_names(spark, d))


@query("""WITH r AS (SELECT p_partkey AS o, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE p_brand END AS canonical, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS display, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' A ' WHEN 2 THEN 'b' ELSE '' END AS route FROM part),
    n AS (SELECT o, i, coalesce(nullif(trim(canonical), ''), x) AS display, x FROM (SELECT o, canonical, unnest(list_filter([name, display, nullif(trim(canonical), '')], lambda v: v IS NOT NULL)) AS x, generate_subscripts(list_filter([name, display, nullif(trim(canonical), '')], lambda v: v IS NOT NULL), 1) AS i FROM r WHERE lower(trim(coalesce(route, ''))) IN ('', 'a'))),
    k AS (SELECT o, i, 0 AS j, display, x FROM n UNION ALL SELECT o, i, 1, display, display FROM n) SELECT lower(x) AS name_key, arg_max(display, (o, i, j, display)) AS display FROM k GROUP BY 1""")
def profile_names(spark: SparkSession, d: str) -> DataFrame:
    """Every name of a profile leads to its display name; rows of another route take no part."""
    k = F.col("p_partkey")
    p = load(spark, d, "part").select(k.alias("o"), F.when(k % 3 == 1, " ").when(k % 3 == 2, F.col("p_brand")).alias("canonical"), F.col("p_name").alias("name"), F.when(k % 2 == 0, F.col("p_type")).alias("display"), F.when(k % 5 == 0, None).when(k % 5 == 1, " A ").when(k % 5 == 2, "b").otherwise("").alias("route"))
    return evidence.profile_aliases(p, ["fighter", "name", "display", "canonical"], "o", "canonical", "route", ["a"])


@query("SELECT p_partkey FROM part WHERE lower(p_name) = lower((SELECT min(p_name) FROM part))")
def entity_history(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one entity by its normalised name."""
    p = load(spark, d, "part")
    return evidence.entity_rows(p, f"  {p.agg(F.upper(F.min('p_name'))).first()[0]} ", "p_name").select("p_partkey")


@query("""WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN '1996-02-30' ELSE '1996-02-28' END AS day, CASE WHEN o_orderkey % 5 = 0 THEN 'Nowhere' ELSE o_orderpriority END AS g, o_orderkey % 3 = 0 AS same FROM orders)
    SELECT k, CASE WHEN g <> 'Nowhere' AND g <> '5-LOW' THEN g END AS canonical_grp, CASE WHEN day = '1996-02-30' THEN 'bad_day' WHEN g IN ('Nowhere', '5-LOW') THEN 'unknown_group' WHEN same THEN 'same_entity' END AS problem FROM r""")
def request_checks(spark: SparkSession, d: str) -> DataFrame:
    """Day, group and two different entities of a request."""
    k = F.col("o_orderkey")
    other = F.when(k % 3 == 0, 1).otherwise(2)
    r = load(spark, d, "orders").select(k.alias("k"), F.when(k % 7 == 0, "1996-02-30").otherwise("1996-02-28").alias("day"), F.when(k % 5 == 0, "Nowhere").otherwise(F.upper(F.concat(F.lit(" "), "o_orderpriority"))).alias("grp"), F.lit("José  X").alias("a_name"), F.lit(1).alias("a_id"), F.lit("jose x").alias("b_name"), other.alias("b_id"))
    return evidence.checked_requests(r, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]).select("k", "canonical_grp", "problem")


# evidence


@query(
    with_obs("""s AS (SELECT contest_id, entity_id, CASE WHEN contest_id % 13 = 0 THEN successes + 60 ELSE successes END AS successes, CASE WHEN contest_id % 17 = 0 THEN -1 ELSE attempts END AS attempts, CASE WHEN contest_id % 5 = 0 AND entity_id > opponent_id THEN 777 ELSE 60 END AS seconds, CASE WHEN contest_id % 3 = 0 THEN 100 ELSE 30 END AS control FROM obs),
    r AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE contest_id % 11 = 0 AND entity_id % 2 = 0),
    n AS (SELECT o.contest_id, o.entity_id, o.opponent_id, count_if(r.entity_id = o.entity_id) AS n1, count_if(r.entity_id = o.opponent_id) AS n2 FROM obs o JOIN r ON r.contest_id = o.contest_id GROUP BY ALL),
    w AS (SELECT n.*, n1 = 1 AS u, n1 = 1 AND n2 = 1 AS paired, a.successes AS s1, a.attempts AS a1, a.seconds AS t1, a.control AS c1, b.successes AS s2, b.attempts AS a2, b.seconds AS t2 FROM n JOIN s a ON a.contest_id = n.contest_id AND a.entity_id = n.entity_id JOIN s b ON b.contest_id = n.contest_id AND b.entity_id = n.opponent_id),
    v AS (SELECT *, CASE WHEN u AND a1 >= 0 THEN a1 END AS a, CASE WHEN u THEN s1 END AS s, CASE WHEN paired AND t1 <> t2 THEN NULL WHEN u THEN t1 END AS duration FROM w)
    SELECT contest_id, entity_id, paired, CAST(duration AS DOUBLE) AS duration, CASE WHEN s > a THEN NULL ELSE s END AS successes, CASE WHEN s > a THEN NULL ELSE a END AS attempts, CAST(CASE WHEN u AND NOT coalesce(c1 > duration, false) THEN c1 END AS DOUBLE) AS control,
        CASE WHEN NOT paired THEN NULL WHEN a2 >= 0 AND s2 > a2 THEN NULL ELSE s2 END AS other_successes,
        CASE WHEN s > a THEN 'part_exceeds_whole' WHEN a IS NULL THEN 'missing_or_invalid' END AS attempts_issue, CASE WHEN u AND c1 > duration THEN 'longer_than_contest' WHEN NOT u THEN 'missing_or_invalid' END AS control_issue, CASE WHEN paired AND t1 <> t2 THEN 'durations_differ' END AS duration_issue FROM v""")
)
def contest_normalised(spark: SparkSession, d: str) -> DataFrame:
    """A contest's rows for description: unambiguous sides, counts that fit together, durations that agree; and why not."""
    o, k = observations(spark, d), F.col("contest_id")
    rows = o.select(*ID, F.when(k % 13 == 0, F.col("successes") + 60).otherwise(F.col("successes")).alias("successes"), F.when(k % 17 == 0, -1.0).otherwise(F.col("attempts")).alias("attempts"), F.when((k % 5 == 0) & (F.col("entity_id") > F.col("opponent_id")), 777.0).otherwise(60.0).alias("seconds"), F.when(k % 3 == 0, 100.0).otherwise(30.0).alias("control"))
    rows = rows.unionByName(rows.filter("contest_id % 11 = 0 and entity_id % 2 = 0"))
    n = evidence.normalised_contests(o, rows, ["successes", "attempts", "control"], [("successes", "attempts")], control="control")
    issue = lambda c: F.try_element_at("issues", F.lit(c)).alias(f"{c}_issue")
    return n.select(*ID, "paired", "duration", "own.successes", "own.attempts", "own.control", F.col("other.successes").alias("other_successes"), issue("attempts"), issue("control"), issue("duration"))


@query(with_obs("""SELECT contest_id, entity_id, attempts * 2 AS total, round(seconds / 60, 6) AS minutes, successes - CASE WHEN contest_id % 3 = 0 THEN 0 ELSE 2 END AS hit_diff, round(CASE WHEN seconds > 0 THEN (successes - CASE WHEN contest_id % 3 = 0 THEN 0 ELSE 2 END) / (seconds / 60) END, 6) AS hit_diff_per_minute,
    round(CASE WHEN seconds > 0 THEN (successes - CASE WHEN contest_id % 3 = 0 THEN 0 ELSE 2 END) / (seconds / 60) * 15 END, 6) AS hit_diff_per_15 FROM (SELECT * REPLACE (CASE WHEN contest_id % 7 = 0 THEN 0 ELSE seconds END AS seconds) FROM obs)"""))
def observations_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """totals from parts, fills, differences and their rates."""
    k = F.col("contest_id")
    o = observations(spark, d).withColumns({"head": F.col("attempts"), "body": F.col("attempts").cast("string"), "absorbed": F.when(k % 3 != 0, "2"), "seconds": F.when(k % 7 != 0, F.col("seconds"))})
    out = evidence.cleaned_observations(o, {"total": ["head", "body", "leg"], "attempts": ["nothing"]}, ["absorbed", "successes"], {"hit_diff": ("successes", "absorbed")}, ["hit_diff"], ["hit_diff"])
    return out.select(*ID, "total", r6("minutes").alias("minutes"), "hit_diff", r6("hit_diff_per_minute").alias("hit_diff_per_minute"), r6("hit_diff_per_15").alias("hit_diff_per_15"))


@query(with_obs(f"h AS (SELECT contest_id, entity_id, count(*) {_STRICT} AS contests, coalesce(sum(CASE WHEN won = 1 THEN 1 ELSE 0 END) {_STRICT}, 0) AS wins, coalesce(sum(CASE WHEN won = 0 THEN 1 ELSE 0 END) {_STRICT}, 0) AS losses FROM obs) SELECT contest_id, entity_id, contests AS experience, round(CASE WHEN contests > 0 THEN (wins + losses) / contests END, 6) AS decided_rate, round(pow(20 + entity_id % 20, 2), 2) AS age_squared, CAST(20 + entity_id % 20 > 35 AS INTEGER) AS over_35 FROM h"))
def snapshot_aliases(spark: SparkSession, d: str) -> DataFrame:
    """columns under further names, shares by method, ages."""
    snap = history.snapshots(observations(spark, d), history.career_specs()).withColumn("age", 20 + F.col("entity_id") % 20)
    out = evidence.alias_columns(snap, [("contests", "experience"), ("nothing", "else"), ("wins", "losses")], "age", {"decided_rate": ("wins", "losses")}, "contests")
    return out.select(*ID, "experience", r6("decided_rate").alias("decided_rate"), F.round("age_squared", 2).alias("age_squared"), "over_35")


_CHOSEN = {"wins": "Earlier wins", "attempts_sum": "Earlier attempts"}


@query(with_obs(f"{_PAIRS} " + " UNION ALL ".join(f"SELECT contest_id, '{m}' AS metric, '{label}' AS label, 'count' AS unit, {m}_a AS a, {m}_b AS b, 'earlier contests: a ' || CAST(contests_a AS BIGINT) || ', b ' || CAST(contests_b AS BIGINT) AS support FROM pairs" for m, label in _CHOSEN.items())))
def chart_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The metrics of the chart, with what they rest on."""
    p = career_pairs(spark, d)
    return evidence.evidence_rows(aggregates.metric_table(p, [(f, "count", [f]) for f in PAIR_FEATURES]), p, _CHOSEN)


@query(with_obs(f"{_PAIRS} " + " UNION ALL ".join(f"SELECT contest_id, CAST({i} AS BIGINT) AS place, '{m}' AS metric, {m}_a AS a, {m}_b AS b FROM pairs" for i, m in enumerate(("losses", "contests"), 1))))
def overview_rows(spark: SparkSession, d: str) -> DataFrame:
    """A fixed list of metrics in its order."""
    table = aggregates.metric_table(career_pairs(spark, d), [(f, "count", [f]) for f in PAIR_FEATURES])
    return evidence.overview(table, ["losses", "contests"]).select("contest_id", F.col("place").cast("bigint").alias("place"), "metric", "a", "b")


@query(with_obs(f"""{_PAIRS}, r AS (SELECT contest_id, list_filter([CASE WHEN wins_diff > 5 THEN 'more_wins' END, CASE WHEN contests_a < 3 OR contests_b < 3 THEN 'little_history' END, CASE WHEN abs(attempts_sum_diff) > 100 THEN 'activity' END, CASE WHEN label IS NULL THEN 'undecided' END], lambda x: x IS NOT NULL)[1:2] AS rules FROM pairs)
    SELECT contest_id, CAST(unnest(range(len(rules))) AS INTEGER) AS place, unnest(rules) AS rule FROM r"""))
def summary_rules(spark: SparkSession, d: str) -> DataFrame:
    """The first rules that hold, at most two for each contest."""
    rules = [("more_wins", F.col("wins_diff") > 5, "a has won more"), ("little_history", (F.col("contests_a") < 3) | (F.col("contests_b") < 3), "few contests"), ("activity", F.abs("attempts_sum_diff") > 100, "activity differs"), ("undecided", F.col("label").isNull(), "no winner")]
    return aggregates.observations_of(career_pairs(spark, d), rules, 2).select("contest_id", "place", "rule")


@query(with_obs(f"{_PAIRS}, s AS (SELECT contest_id FROM pairs ORDER BY md5(contest_id || '-7'), contest_id LIMIT 50) SELECT contest_id, entity_a, entity_b FROM pairs WHERE contest_id IN (SELECT contest_id FROM s)"))
def sampled_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same rows in every run; a sample is the feature here."""
    return aggregates.hash_sample(career_pairs(spark, d), "contest_id", 50, 7).select("contest_id", "entity_a", "entity_b")


@query(with_obs("SELECT entity_id, round(sum(CASE WHEN won IS NOT NULL AND attempts > 0 THEN won * attempts END) / sum(CASE WHEN won IS NOT NULL AND attempts > 0 THEN attempts END), 6) AS weighted FROM obs GROUP BY 1"))
def weighted_results(spark: SparkSession, d: str) -> DataFrame:
    """A mean over rows with a value and a positive weight."""
    return observations(spark, d).groupBy("entity_id").agg(r6(aggregates.weighted_mean(F.col("won"), F.col("attempts"))).alias("weighted"))


@query(with_obs("SELECT entity_id, event_day, round(avg(attempts), 6) AS attempts, arg_min(result, contest_id) AS result FROM obs GROUP BY 1, 2"))
def collapsed_days(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one key: numbers averaged, the rest from the first."""
    o = observations(spark, d).select("entity_id", "event_day", "contest_id", "attempts", "result")
    return aggregates.collapse(o, ["entity_id", "event_day"], ["contest_id"]).select("entity_id", "event_day", r6("attempts").alias("attempts"), "result")


@query(with_obs(f"{_PAIRS}, s AS (SELECT 'wins_diff' AS feature, 'ok' AS status, count(wins_diff) AS n_known FROM pairs UNION ALL SELECT 'void_diff', 'empty', 0 UNION ALL SELECT 'age_diff', 'missing', NULL UNION ALL SELECT 'late_diff', CASE WHEN count(*) = 0 THEN 'empty' ELSE 'ok' END, count(*) FROM pairs WHERE event_day >= DATE '2001-07-01') SELECT * FROM s"))
def model_input_status(spark: SparkSession, d: str) -> DataFrame:
    """Features that lack a column, or hold nothing but nulls, with how many values each has."""
    late = F.when(F.col("event_day") >= F.lit("2001-07-01").cast("date"), F.col("wins_diff"))
    rows = career_pairs(spark, d).withColumns({"void_diff": F.lit(None).cast("double"), "late_diff": late})
    there = ["wins_diff", "void_diff", "late_diff"]
    counts = rows.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.count(c).alias("n_known")) for c in there]).alias("c")).select(F.inline("c"))
    return evidence.input_status(rows, [*there, "age_diff"]).join(counts, "feature", "left")


@query(with_obs(f"""{_PAIRS} SELECT 'safe' AS list, f AS feature, count(x) AS n_known FROM pairs, (SELECT unnest(['attempts_sum_diff', 'contests_diff', 'losses_diff', 'successes_sum_diff', 'wins_diff']) AS f), LATERAL (SELECT CASE f WHEN 'attempts_sum_diff' THEN attempts_sum_diff WHEN 'contests_diff' THEN contests_diff WHEN 'losses_diff' THEN losses_diff WHEN 'successes_sum_diff' THEN successes_sum_diff ELSE wins_diff END AS x) q GROUP BY f
    UNION ALL SELECT 'leaking', 'result_diff', count(*) FROM pairs UNION ALL SELECT 'leaking', 'label', count(label) FROM pairs UNION ALL SELECT 'v1', 'contest_id', count(*) FROM pairs UNION ALL SELECT 'v1', 'wins_diff', count(wins_diff) FROM pairs"""))
def feature_lists(spark: SparkSession, d: str) -> DataFrame:
    """Features by suffix, by version, and those that hold the outcome, with how many values each has."""
    p = career_pairs(spark, d).withColumn("result_diff", F.lit(1.0))
    v1 = models.FeatureRegistry({"v1": ["wins_diff"]}).select(p, "v1", ["contest_id"])
    lists = {"safe": models.safe_features(p), "leaking": contracts.leaking_features(["wins_diff", "result_diff", "label"]), "v1": v1.columns}
    items = [F.struct(F.lit(n).alias("list"), F.lit(c).alias("feature"), F.count(c).alias("n_known")) for n, names_ in lists.items() for c in names_]
    return p.agg(F.array(*items).alias("x")).select(F.inline("x"))


# leaks, gates, versions


@query(with_obs("SELECT entity_id, event_day, count(DISTINCT contest_id) AS ratings FROM obs GROUP BY 1, 2 HAVING count(DISTINCT contest_id) > 1"))
def rating_leaks(spark: SparkSession, d: str) -> DataFrame:
    """A rating that moves within a day is found: here it is the contest's own id."""
    return contracts.same_day_rating_leaks(observations(spark, d).withColumn("rating", F.col("contest_id").cast("double")))


@query(with_obs(f"SELECT contest_id, entity_id FROM (SELECT *, max(event_day) {_STRICT} AS last_day FROM obs) WHERE last_day IS NOT NULL AND contest_id % 50 = 0"))
def history_day_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Histories that end on their own day; some are planted."""
    snap = history.snapshots(observations(spark, d), history.career_specs())
    planted = snap.withColumn("last_day", F.when(F.col("last_day").isNotNull() & (F.col("contest_id") % 50 == 0), F.col("event_day")).otherwise(F.col("last_day")))
    return contracts.history_leaks(planted).select(*ID)


@query(with_obs("SELECT 'duplicate_keys' AS \"check\", (SELECT count(*) FROM (SELECT contest_id FROM obs GROUP BY 1 HAVING count(*) > 1)) AS found UNION ALL SELECT 'ranges', (SELECT count(*) FROM obs WHERE attempts > 45) UNION ALL SELECT 'pairs', 0 UNION ALL SELECT 'orphans', (SELECT count(DISTINCT entity_id) FROM obs WHERE entity_id % 9 = 0)"))
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    """One report of all contracts; a gate raises where one has findings."""
    o = Steps(spark, "validated").write(observations(spark, d).select("contest_id", "event_day", "entity_id", "attempts", "result"))  # read by each contract
    profiles = load(spark, d, "supplier").filter("s_suppkey % 9 <> 0").select(F.col("s_suppkey").alias("entity_id"))
    found = {"duplicate_keys": contracts.duplicate_keys(o, ["contest_id"]), "ranges": contracts.range_violations(o, {"attempts": (0, 45)}, "contest_id"), "pairs": contracts.pair_integrity(o), "orphans": contracts.key_gaps(o, profiles, "entity_id").filter("side = 'left_only'")}
    contracts.require(found["pairs"], "pairs")
    parts = [df.agg(F.count(F.lit(1)).alias("found")).select(F.lit(n).alias("check"), "found") for n, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT 'reordered' AS pair, (SELECT count(*) FROM customer) AS rows, true AS same UNION ALL SELECT 'changed', (SELECT count(*) FROM customer), false UNION ALL SELECT 'repeated', (SELECT count(*) + 1 FROM customer), false")
def same_tables(spark: SparkSession, d: str) -> DataFrame:
    """Equality of tables as multisets, by the digests of both."""
    c = load(spark, d, "customer").select("c_custkey", "c_name")
    pairs_of = {"reordered": c.orderBy(F.desc("c_name")), "changed": c.withColumn("c_name", F.when(F.col("c_custkey") == 3, "x").otherwise(F.col("c_name"))), "repeated": c.unionByName(c.limit(1))}
    digests = reduce(DataFrame.unionByName, [maintenance.content_digest(x).withColumn("pair", F.lit(n)) for n, x in pairs_of.items()])
    own = maintenance.content_digest(c).select(F.col("rows").alias("own_rows"), F.col("digest").alias("own_digest"))  # one row
    return digests.crossJoin(own).select("pair", "rows", ((F.col("rows") == F.col("own_rows")) & (F.col("digest") == F.col("own_digest"))).alias("same"))


@query("""SELECT CAST(1 AS BIGINT) AS step, 'customer' AS name, CAST(1 AS BIGINT) AS version, (SELECT count(*) FROM customer) AS rows, 'first' AS note UNION ALL SELECT 1, 'orders', 1, (SELECT count(*) FROM orders), 'first'
    UNION ALL SELECT 2, 'orders', 2, (SELECT count(*) FROM orders WHERE o_orderkey % 7 <> 0), 'second' UNION ALL SELECT 3, 'prices', 3, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderkey % 7 <> 0), 'rebuild prices' UNION ALL SELECT 4, 'prices', NULL, NULL, 'undo'""")
def version_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of staged updates: unchanged tables get no version, a refused step none at all; a rebuild and an undo."""
    o, c = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), load(spark, d, "customer").select("c_custkey", "c_name")
    v = maintenance.Versions(spark, twins.shared_root(spark, "versions"))
    v.publish({"customer": c, "orders": o}, note="first")
    v.publish({"customer": c, "orders": o.filter("o_orderkey % 7 <> 0")}, note="second")
    try:
        v.publish({"customer": c.limit(1)}, [lambda t: contracts.require(t["customer"].filter("c_custkey is not null"), "refused")])
    except contracts.ContractError:
        v.rebuild([("prices", lambda s: s.read("orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top")))])
        v.undo()
    return v.manifest().select("step", "name", "version", "rows", "note")


def manifest_rows(spark: SparkSession, d: str) -> DataFrame:
    """Nations as tables of a manifest: step n makes version n of the nation n % 4."""
    n = load(spark, d, "nation")
    return n.select((F.col("n_nationkey") + 1).cast("bigint").alias("step"), (F.col("n_nationkey") % 4).cast("string").alias("name"), (F.col("n_nationkey") + 1).cast("bigint").alias("version"), F.lit(1).cast("bigint").alias("rows"), F.col("n_name").alias("digest"), F.lit("").alias("note"))


_MANIFEST = "m AS (SELECT CAST(n_nationkey + 1 AS BIGINT) AS step, CAST(n_nationkey % 4 AS VARCHAR) AS name, CAST(n_nationkey + 1 AS BIGINT) AS version FROM nation)"


@query(f"WITH {_MANIFEST}, l AS (SELECT max(step) - 5 AS s FROM m), n AS (SELECT name, version FROM m, l WHERE step > s UNION SELECT name, arg_max(version, step) FROM m, l WHERE step <= s GROUP BY name) SELECT name, version FROM m WHERE (name, version) NOT IN (SELECT name, version FROM n)")
def versions_to_prune(spark: SparkSession, d: str) -> DataFrame:
    """Versions that were current after none of the last six steps."""
    return maintenance.prunable_versions(manifest_rows(spark, d), 6)


@query(f"WITH {_MANIFEST}, f AS (SELECT name, version FROM m UNION ALL SELECT name, version + 100 FROM m WHERE version % 5 = 0) SELECT name, version FROM f WHERE (name, version) NOT IN (SELECT name, version FROM m)")
def versions_stray(spark: SparkSession, d: str) -> DataFrame:
    """Folders that no step names."""
    m = manifest_rows(spark, d)
    found = m.select("name", "version").unionByName(m.filter("version % 5 = 0").select("name", (F.col("version") + 100).alias("version")))
    return maintenance.stray_versions(m, found)


@query("SELECT 'first' AS call, CAST(1 AS BIGINT) AS computed, (SELECT count(*) FROM nation) AS rows UNION ALL SELECT 'same content', 1, (SELECT count(*) FROM nation) UNION ALL SELECT 'other content', 2, (SELECT count(*) FROM nation) - 1")
def cached_results(spark: SparkSession, d: str) -> DataFrame:
    """Results kept by the content of what they were computed from."""
    v, calls, n = maintenance.Versions(spark, twins.shared_root(spark, "cache")), [], load(spark, d, "nation").select("n_nationkey", "n_name")
    out = []
    for call, source in (("first", n), ("same content", n.orderBy(F.desc("n_name"))), ("other content", n.filter("n_nationkey <> 3"))):
        result = v.cached("copy", {"nation": source}, lambda s=source: calls.append(1) or s)
        out.append((call, len(calls), result.count()))
    return spark.createDataFrame(out, "call string, computed bigint, rows bigint")


_HALF = "(SELECT max(event_id) // 2 FROM events)"


@query(f"SELECT user_id, event_id, event_id = min(event_id) OVER (PARTITION BY user_id) AND user_id NOT IN (SELECT user_id FROM events WHERE event_id <= {_HALF}) AS first_of_chain, true AS intact FROM events WHERE event_id > {_HALF}")
def ledger_append(spark: SparkSession, d: str) -> DataFrame:
    """E18, ST6: rows to append to a hash-chained ledger: what is there already isn't appended again; every link holds."""
    e = load(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    half = F.lit(e.agg(F.floor(F.max("event_id") / 2)).first()[0])
    ledger = capture.chained(e.filter(F.col("event_id") <= half), "user_id", "event_id", ["event_type", "value"])
    new = maintenance.append_ledger(ledger, e.filter(F.col("event_id") > half / 2), "user_id", "event_id", ["event_type", "value"])
    whole = ledger.unionByName(new)
    broken = capture.broken_links(whole, "user_id", "event_id", ["event_type", "value"]).select("event_id", F.lit(False).alias("_ok"))
    return new.join(broken, "event_id", "left").select("user_id", "event_id", (F.col("previous_hash") == "").alias("first_of_chain"), F.coalesce("_ok", F.lit(True)).alias("intact"))


# folds, weights, models as formulas


@query(with_obs("SELECT contest_id FROM obs WHERE event_day < DATE '1996-01-01' INTERSECT SELECT contest_id FROM obs WHERE contest_id % 40 = 0"))
def split_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Contests that stand in both parts; some are planted."""
    o = observations(spark, d)
    train = o.filter(F.col("event_day") < F.lit("1996-01-01").cast("date"))
    return evaluate.split_overlap(train, o.filter((F.col("event_day") >= F.lit("1996-01-01").cast("date")) | (F.col("contest_id") % 40 == 0)).filter("contest_id % 40 = 0"))


@query(with_obs(f"{_PAIRS} SELECT contest_id, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(contest_id || '-42'), contest_id) - 1) % 5 AS INTEGER) AS fold FROM pairs WHERE label IS NOT NULL"))
def class_folds(spark: SparkSession, d: str) -> DataFrame:
    """Shuffled folds with every class dealt evenly."""
    return evaluate.stratified_folds(career_pairs(spark, d)).select("contest_id", "fold")


@query("SELECT * FROM (VALUES (9, 5), (4, 3), (2, 2), (1, NULL)) t(rarer, folds)")
def class_fold_counts(spark: SparkSession, d: str) -> DataFrame:
    """The number of folds by the rarer class."""
    o = load(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").limit(40).withColumn("i", F.row_number().over(Window.orderBy("o_orderkey")))
    parts = [evaluate.fold_count(o.withColumn("label", F.when(F.col("i") <= n, 1).otherwise(0))).select(F.lit(n).alias("rarer"), "folds") for n in (9, 4, 2, 1)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_LOSS = "-(label * ln(greatest(1e-6, least(1 - 1e-6, {p}))) + (1 - label) * ln(1 - greatest(1e-6, least(1 - 1e-6, {p}))))"


@query(with_obs(f"""{_FORE}, b AS (SELECT event_day, ntile(4) OVER (ORDER BY event_day) AS block FROM (SELECT DISTINCT event_day FROM fore)),
    l AS (SELECT block, avg({_LOSS.format(p='probability')}) AS rated, avg({_LOSS.format(p='0.5')}) AS even FROM fore JOIN b USING (event_day) WHERE label IS NOT NULL GROUP BY block),
    w AS (SELECT 1 / avg(rated) AS r, 1 / avg(even) AS e FROM l WHERE block > 1) SELECT 'probability' AS model, round(r / (r + e), 6) AS weight FROM w UNION ALL SELECT 'even', round(e / (r + e), 6) FROM w"""))
def ensemble_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights by one over the mean loss on later blocks of days."""
    f = pairs.canonical_rows(forecasts(spark, d)).withColumn("even", F.lit(0.5))
    cut = f.join(F.broadcast(evaluate.date_blocks(f)), "event_day").filter("block > 1")
    return models.inverse_loss_weights(models.block_losses(cut, ["probability", "even"])).select("model", r6("weight").alias("weight"))


@query(with_obs(f"{_PAIRS}, s AS (SELECT contest_id, (wins_a + 1) / (wins_a + wins_b + 3.1) AS p, (wins_b + 1) / (wins_a + wins_b + 3.1) AS q FROM pairs) SELECT contest_id, round(0.75 * (p + 1 - q) / 2 + 0.25 * 0.5, 6) AS probability FROM s"))
def scored_both_ways(spark: SparkSession, d: str) -> DataFrame:
    """An ensemble of formulas, scored from both sides: a model that favours its first side is corrected."""
    rated = models.Formula((F.col("wins_a") + 1) / (F.col("wins_a") + F.col("wins_b") + 3.1))
    both = models.Ensemble({"rated": rated, "even": models.Formula(F.lit(0.5))}, {"rated": 3.0, "even": 1.0})
    return models.score_both_ways(both, career_pairs(spark, d)).select("contest_id", r6("probability").alias("probability"))


@query(with_obs(f"{_PAIRS}, m AS (SELECT median(wins_diff) AS md FROM pairs WHERE contest_id % 3 <> 0), f AS (SELECT contest_id, CASE WHEN contest_id % 3 = 0 THEN md ELSE wins_diff END AS x FROM pairs, m) SELECT contest_id, round((x - (SELECT avg(x) FROM f)) / (SELECT stddev_pop(x) FROM f), 6) AS wins FROM f"))
def preprocessed_features(spark: SparkSession, d: str) -> DataFrame:
    """Missing numbers become the median, and are standardised by the population's deviation."""
    steps = Steps(spark, "preprocessed")  # fit and transform pass over the pairs three times
    p = steps.write(doubles(career_pairs(spark, d)).select("contest_id", F.when(F.col("contest_id") % 3 != 0, F.col("wins_diff")).alias("wins_diff")))
    return models.Preprocessor(["wins_diff"]).fit(p).transform(p).select("contest_id", r6("_x_wins_diff").alias("wins"))


@query(with_obs(f"{_PAIRS}, p AS (SELECT contest_id, event_day, CASE WHEN event_day < DATE '1995-01-01' THEN 'train' WHEN event_day < DATE '1997-01-01' THEN 'tune' ELSE 'test' END AS part FROM pairs) SELECT 'v1' AS protocol, part, count(DISTINCT contest_id) AS contests, count(*) AS rows, min(event_day) AS first_day, max(event_day) AS last_day FROM p GROUP BY part"))
def protocol_parts(spark: SparkSession, d: str) -> DataFrame:
    """The parts of a frozen evaluation."""
    return evaluate.register_protocol(career_pairs(spark, d), {"train": "1995-01-01", "tune": "1997-01-01", "test": ""}, "v1").drop("digest")


@query(with_obs("""dg AS (SELECT o.contest_id, o.entity_id, coalesce(sum(p.attempts), 0) AS den, CASE WHEN o.contest_id % 3 = 0 THEN ' GLOBAL' WHEN o.contest_id % 3 = 1 THEN 'group' ELSE 'neutral' END AS source FROM obs o LEFT JOIN obs p ON p.entity_id = o.entity_id AND p.event_day < o.event_day GROUP BY ALL)
    SELECT contest_id, entity_id, CASE WHEN den > 0 AND source = 'group' THEN 'group' WHEN den > 0 AND source = ' GLOBAL' THEN 'global' ELSE 'prior_only' END AS source FROM dg"""))
def prior_sources(spark: SparkSession, d: str) -> DataFrame:
    """A prior's source counts only with support."""
    o = shrinkage.prior_sums(observations(spark, d), "successes", "attempts")
    k = F.col("contest_id") % 3
    snap = history.snapshots(o, [history.Spec("den", "sum", F.col("attempts"))])
    return snap.select(*ID, shrinkage.supported_source(F.col("den"), F.when(k == 0, " GLOBAL").when(k == 1, "group").otherwise("neutral")).alias("source"))


# ratings


@query(with_obs(f"{rating_sides_sql('grp')} SELECT contest_id, entity_id, opponent_id, round(rating, 6) AS rating, round(opponent_rating, 6) AS opponent_rating FROM sides", recursive=True))
def rating_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Each side's rating before the contest, by contest and entity."""
    s = rating_sides(spark, d)
    return s.select("contest_id", "entity_id", "opponent_id", r6("rating").alias("rating"), r6("opponent_rating").alias("opponent_rating"))


@query(with_obs(f"{rating_sides_sql('grp')} SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY event_day, contest_id) AS place, contest_id, round(rating, 6) AS rating FROM sides WHERE event_day < DATE '{_CUTOFF}'", recursive=True))
def rating_points(spark: SparkSession, d: str) -> DataFrame:
    """Each entity's ratings over time before a day, as rows."""
    out = ratings.rating_series(rating_sides(spark, d), F.lit(_CUTOFF).cast("date"))
    return out.select("entity_id", "place", "contest_id", r6("rating").alias("rating"))
