"""Registered queries for the column functions: texts with every case of a rule, picked by order key, against the rule in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from .contests import load
from .queries import query, r6


def picked(values: list, key: str = "o_orderkey", step: int = 1) -> Column:
    """One of the values for each key."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(F.col(key) / step) % len(values) + 1).cast("int"))


def picked_sql(values: list, key: str = "o_orderkey", step: int = 1) -> str:
    items = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values)
    return f"([{items}])[(({key} // {step}) % {len(values)}) + 1]"


NUMBERS = ["12", " -3 ", "75%", "0.4", "--", "", None, "3 of 7", "1e2", "about 8.5 cm", "none", "99.5 %", ".5", "7."]
#: A number that a whole text is, else the first one in it.
_FLOAT = r"CASE WHEN y IN ('', '--', '---') THEN NULL ELSE coalesce(CASE WHEN regexp_full_match(trim(replace(y, '%', '')), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN TRY_CAST(trim(replace(y, '%', '')) AS DOUBLE) END, TRY_CAST(nullif(regexp_extract(replace(y, '%', ''), '-?\d+(\.\d+)?'), '') AS DOUBLE)) END"
_CLEAN = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


@query(rf"""WITH t AS (SELECT o_orderkey, {_CLEAN.format(picked_sql(NUMBERS))} AS y FROM orders), f AS (SELECT *, {_FLOAT} AS v FROM t)
    SELECT o_orderkey, CASE WHEN y NOT IN ('', '--', '---') THEN TRY_CAST(nullif(regexp_extract(y, '-?\d+'), '') AS BIGINT) END AS whole, v AS number, CASE WHEN v > 1 THEN v / 100 ELSE v END AS share FROM f""")
def scalar_numbers(spark: SparkSession, d: str) -> DataFrame:
    """whole numbers, numbers and shares of texts."""
    x = picked(NUMBERS)
    return load(spark, d, "orders").select("o_orderkey", S.parse_int(x).alias("whole"), S.parse_float(x).alias("number"), S.parse_percent(x).alias("share"))


CLOCKS = ["4:05", "1:02:03", "--", None, "95", "x:10", "0:00", "12:3", "1:2:3:4", "a 7 b"]


@query(rf"""WITH t AS (SELECT o_orderkey, {picked_sql(CLOCKS)} AS y FROM orders), p AS (SELECT *, string_split(y, ':') AS p FROM t),
    s AS (SELECT *, CASE WHEN y IN ('', '--', '---') THEN NULL WHEN NOT contains(y, ':') THEN TRY_CAST(nullif(regexp_extract(y, '-?\d+'), '') AS BIGINT) WHEN len(p) = 2 THEN TRY_CAST(p[1] AS BIGINT) * 60 + TRY_CAST(p[2] AS BIGINT)
        WHEN len(p) = 3 THEN TRY_CAST(p[1] AS BIGINT) * 3600 + TRY_CAST(p[2] AS BIGINT) * 60 + TRY_CAST(p[3] AS BIGINT) END AS seconds FROM p)
    SELECT o_orderkey, seconds, CASE WHEN seconds IS NOT NULL THEN greatest(0, (o_orderkey % 4 - 1) * 300 + seconds) END AS elapsed FROM s""")
def scalar_clocks(spark: SparkSession, d: str) -> DataFrame:
    """clock texts as seconds, and seconds since the start of the contest."""
    x = picked(CLOCKS)
    elapsed = F.when(S.clock_seconds(x).isNotNull(), S.elapsed_seconds(F.col("o_orderkey") % 4, x))
    return load(spark, d, "orders").select("o_orderkey", S.clock_seconds(x).alias("seconds"), elapsed.alias("elapsed"))


URLS = ["http://x.org/a/B-c_9/", "https://www.x.org/e?q=1&r=2", "plain", " http://y.org//z// ", ""]


@query(rf"""WITH t AS (SELECT o_orderkey, {picked_sql(URLS)} || CASE WHEN o_orderkey % 3 = 0 THEN repeat('/long-segment', 10) ELSE '' END AS y FROM orders)
    SELECT o_orderkey, list_last(string_split(regexp_replace({_CLEAN.format('y')}, '/+$', ''), '/')) AS id,
    left(regexp_replace(regexp_replace(y, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 80) || '_' || left(sha1(y), 16) || '.html' AS slug FROM t""")
def scalar_urls(spark: SparkSession, d: str) -> DataFrame:
    """the id in a URL, and a file name for it."""
    x = F.concat(picked(URLS), F.when(F.col("o_orderkey") % 3 == 0, "/long-segment" * 10).otherwise(""))
    return load(spark, d, "orders").select("o_orderkey", S.id_from_url(x).alias("id"), S.url_slug(x).alias("slug"))


SIZES = ["5' 11\"", "6'", "--", None, "5'3", "tall", "72\"", " 6 ' 0 \""]


@query(rf"""WITH t AS (SELECT o_orderkey, {_CLEAN.format(picked_sql(SIZES))} AS y FROM orders), m AS (SELECT *, regexp_extract(y, '(\d+)\s*''\s*(\d+)', 1) AS ft, regexp_extract(y, '(\d+)\s*''\s*(\d+)', 2) AS inch, {_FLOAT} AS v FROM t)
    SELECT o_orderkey, CASE WHEN ft <> '' THEN round((CAST(ft AS DOUBLE) * 12 + CAST(inch AS DOUBLE)) * 2.54, 2) END AS height, round(v * 2.54, 2) AS reach FROM m""")
def scalar_sizes(spark: SparkSession, d: str) -> DataFrame:
    """heights and reaches in centimetres."""
    x = picked(SIZES)
    return load(spark, d, "orders").select("o_orderkey", S.height_cm(x).alias("height"), S.reach_cm(x).alias("reach"))


TITLES = ["Heavy  Bout", "Women's Fly bout", "Open Weight", " Women's Catch Weight Bout", "", None, "Catch", "light HEAVY"]
TITLE_ALIASES = {"Women's Catch Weight": "Women's Catchweight"}
GROUP_ALIASES = {"light heavy": "LHW", "heavy": "Heavyweight"}


@query(rf"""WITH t AS (SELECT o_orderkey, coalesce({_CLEAN.format(picked_sql(TITLES))}, '') AS y FROM orders), n AS (SELECT *, replace(regexp_replace(y, '\s+[Bb]out$', ''), 'Women''s Catch Weight', 'Women''s Catchweight') AS name FROM t)
    SELECT o_orderkey, name, contains(lower(y), 'women') AS women, contains(lower(y), 'catch') OR contains(lower(y), 'open weight') AS no_class,
    CASE lower(name) WHEN 'light heavy' THEN 'LHW' WHEN 'heavy' THEN 'Heavyweight' WHEN '' THEN 'Unknown' ELSE list_aggregate(list_transform(string_split(lower(name), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') END AS key FROM n""")
def scalar_groups(spark: SparkSession, d: str) -> DataFrame:
    """Group names from titles, group predicates, and normalised keys."""
    name = S.group_name(picked(TITLES), aliases=TITLE_ALIASES)
    named = load(spark, d, "orders").select("o_orderkey", picked(TITLES).alias("x"), name.alias("name"))
    return named.select("o_orderkey", "name", S.names_group(F.col("x"), "women").alias("women"), S.names_group(F.col("x"), "catch", "openweight", "open weight").alias("no_class"), S.group_key(F.col("name"), GROUP_ALIASES).alias("key"))


MARKS = ["W", " win ", "Loser", "L", "draw", "D", "no_contest", "N/C", "nc", "--", None, "dq", "Lost", "NaN"]
_MARK = """CASE WHEN upper({0}) IN ('', '--', '---', 'NAN', 'NONE', 'NULL') OR {0} IS NULL THEN '' WHEN {1} IN ('W', 'WIN', 'WINNER') THEN 'W' WHEN {1} IN ('L', 'LOSS', 'LOSER', 'LOSE', 'LOST') THEN 'L'
    WHEN {1} IN ('D', 'DRAW') THEN 'D' WHEN {1} IN ('NC', 'N/C', 'N C', 'NO CONTEST', 'NOCONTEST') THEN 'NC' ELSE upper({0}) END"""
_WORDS = "trim(regexp_replace(replace(replace(upper({}), '_', ' '), '-', ' '), ' +', ' ', 'g'))"
_BOTH = f"""t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, {_CLEAN.format(picked_sql(MARKS))} AS x, {_CLEAN.format(picked_sql(MARKS, step=14))} AS y FROM orders),
    m AS (SELECT *, {_MARK.format('x', _WORDS.format('x'))} AS a, {_MARK.format('y', _WORDS.format('y'))} AS b FROM t)"""


@query(rf"""WITH {_BOTH} SELECT o_orderkey, a, b, CASE WHEN (a = 'L' AND b = 'W') OR (a = 'W' AND b = 'L') THEN 'win_loss' WHEN a = 'D' AND b = 'D' THEN 'draw' WHEN a = 'NC' AND b = 'NC' THEN 'no_contest' ELSE '' END AS outcome FROM m""")
def scalar_markers(spark: SparkSession, d: str) -> DataFrame:
    """Result markers by family, and the outcome of a pair of them."""
    m = load(spark, d, "orders").select("o_orderkey", S.outcome_marker(picked(MARKS)).alias("a"), S.outcome_marker(picked(MARKS, step=14)).alias("b"))
    return m.withColumn("outcome", S.outcome_of_pair(F.col("a"), F.col("b")))


@query(rf"""WITH {_BOTH}, r AS (SELECT *, CASE WHEN (a = 'W' AND b = '') OR (a = '' AND b = 'W') THEN CASE WHEN o_orderkey % 17 = 0 THEN 'missing_name' WHEN o_orderkey % 19 = 0 THEN 'unknown_day' WHEN day > DATE '1997-01-01' THEN 'future_day' WHEN o_orderkey % 5 = 0 THEN 'known_contest' ELSE 'blank_beside_win' END
        WHEN (a = 'W' AND b = 'L') OR (a = 'L' AND b = 'W') THEN 'complete' WHEN a = '' AND b = '' THEN 'both_blank' WHEN a IN ('D', 'NC') OR b IN ('D', 'NC') THEN 'draw_or_void' ELSE 'ambiguous' END AS reason FROM m)
    SELECT o_orderkey, CASE WHEN reason = 'blank_beside_win' AND a = '' THEN 'L' ELSE a END AS a, CASE WHEN reason = 'blank_beside_win' AND b = '' THEN 'L' ELSE b END AS b, reason FROM r""")
def scalar_inferred_markers(spark: SparkSession, d: str) -> DataFrame:
    """a blank beside a win becomes a loss where nothing speaks against it."""
    k = F.col("o_orderkey")
    m = load(spark, d, "orders").select("o_orderkey", S.outcome_marker(picked(MARKS)).alias("a"), S.outcome_marker(picked(MARKS, step=14)).alias("b"), F.when(k % 19 != 0, F.col("o_orderdate").cast("date")).alias("day"))
    return m.select("o_orderkey", S.inferred_markers(F.col("a"), F.col("b"), F.col("day"), F.lit("1997-01-01").cast("date"), k % 5 == 0, k % 17 != 0).alias("m")).select("o_orderkey", "m.*")


METHODS = ["U-DEC", "KO/TKO", "Submission (rear naked choke)", "Draw", "Overturned", None, "", "nan", "Split", "TKO - doctor stoppage", "guillotine", "NC", "DQ", "S DEC", "sub"]
DETAILS = ["", "punches", None, "heel hook", "dec"]
_METHOD = rf"""t AS (SELECT o_orderkey, o_custkey, {picked_sql(METHODS)} AS m, {picked_sql(DETAILS, step=15)} AS e FROM orders),
    n AS (SELECT *, trim(regexp_replace(lower(coalesce(m, '') || ' | ' || coalesce(e, '')), '[^a-z0-9]+', ' ', 'g')) AS x FROM t),
    f AS (SELECT *, x NOT IN ('', 'nan', 'none', 'null') AS known, regexp_matches(x, 'overturned|no contest|\b(nc|draw)\b') AS void, regexp_matches(x, '\b(decision|dec|[usm]\s*dec|unanimous|split|majority)\b') AS dc,
        regexp_matches(x, '\b(submission|sub)\b|armbar|choke|triangle|guillotine|kimura|keylock|kneebar|heel hook|twister|d arce|darce|anaconda|rear naked') AS sb, regexp_matches(x, '\b(ko|tko)\b|knockout|doctor stoppage|corner stoppage') AS ko FROM n)"""


@query(rf"""WITH {_METHOD} SELECT o_orderkey, CAST(known AS INTEGER) AS known, CASE WHEN known AND NOT void THEN CAST(dc AS INTEGER) END AS decision, CASE WHEN known AND NOT void THEN CAST(sb AS INTEGER) END AS submission,
    CASE WHEN known AND NOT void THEN CAST(ko AS INTEGER) END AS knockout, CASE WHEN known AND NOT void THEN CAST(sb OR ko AS INTEGER) END AS finish,
    CASE WHEN NOT known OR void THEN NULL WHEN sb THEN 'submission' WHEN ko THEN 'knockout' WHEN dc THEN 'decision' END AS class FROM f""")
def scalar_method_flags(spark: SparkSession, d: str) -> DataFrame:
    """method flags from several texts."""
    parts = (picked(METHODS), picked(DETAILS, step=15))
    return load(spark, d, "orders").select("o_orderkey", S.method_flags(*parts).alias("m"), S.method_class(*parts).alias("class")).select("o_orderkey", "m.*", "class")


@query(rf"""WITH {_METHOD} SELECT o_orderkey, CASE WHEN contains(upper(coalesce(m, '')), 'SUB') THEN 'submission' WHEN contains(upper(coalesce(m, '')), 'KO') THEN 'knockout' WHEN contains(upper(coalesce(m, '')), 'DEC') THEN 'decision' ELSE 'other' END AS family,
    CASE WHEN contains(lower(coalesce(m, '')), 'draw') THEN 'draw' WHEN contains(lower(coalesce(m, '')), 'no contest') OR contains(lower(coalesce(m, '')), 'overturned') THEN 'no_contest' WHEN o_custkey % 6 <> 0 THEN 'win_loss' ELSE 'unknown' END AS result FROM f""")
def scalar_results(spark: SparkSession, d: str) -> DataFrame:
    """contest results from method and winner, and coarse method classes."""
    winner = F.when(F.col("o_custkey") % 6 != 0, F.col("o_custkey"))
    return load(spark, d, "orders").select("o_orderkey", S.method_family(picked(METHODS)).alias("family"), S.contest_result(picked(METHODS), winner).alias("result"))


FORMATS = ["5 Rnd (5-5-5-5-5)", "rounds 3", "3", None, "4 rounds", "nan", "x5 rnd"]
LENGTHS = [None, 120.0, 901.0, 0.0, 900.0]


@query(rf"""WITH t AS (SELECT o_orderkey, lower(trim({picked_sql(FORMATS)})) AS y, {picked_sql(LENGTHS, step=7)} AS s FROM orders),
    p AS (SELECT *, coalesce(CASE WHEN o_orderkey % 23 = 0 THEN 4 END, CAST(nullif(regexp_extract(y, '\b([35])\s*(?:rnd|rounds|round)\b', 1), '') AS INTEGER), CAST(nullif(regexp_extract(y, '\b(?:rnd|rounds|round)\s*([35])\b', 1), '') AS INTEGER), CASE WHEN y IN ('3', '5') THEN CAST(y AS INTEGER) END, CASE WHEN s > 900 THEN 5 END) AS planned,
        CASE WHEN s > 0 THEN CAST(ceil(s / 300) AS INTEGER) END AS last FROM t)
    SELECT o_orderkey, planned, last, CAST(planned >= 5 AS INTEGER) AS planned_five, CAST(last >= 4 AS INTEGER) AS reached_late FROM p""")
def scalar_periods(spark: SparkSession, d: str) -> DataFrame:
    """planned and last periods."""
    seconds, number = picked(LENGTHS, step=7).cast("double"), F.when(F.col("o_orderkey") % 23 == 0, "4")
    p = load(spark, d, "orders").select("o_orderkey", S.planned_periods(picked(FORMATS), numbers=[number], seconds=seconds).alias("planned"), S.last_period(seconds).alias("last"))
    return p.withColumns(S.period_flags(F.col("planned"), F.col("last")))


@query("""WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 3 <> 0 THEN DATE '1960-02-29' + CAST(o_custkey AS INTEGER) END AS born, CASE WHEN o_orderkey % 4 <> 0 THEN 25 + o_custkey % 12 END AS known, DATE '1994-01-01' AS seen FROM orders),
    a AS (SELECT *, coalesce((day - born) / 365.25, known + (day - seen) / 365.25) AS age FROM t)
    SELECT o_orderkey, round(age, 6) AS age, round(age * age, 4) AS age_squared, CAST(age > 35 AS INTEGER) AS over_35, CAST(age < 25 AS INTEGER) AS under_25, CAST(age >= 26 AND age <= 34 AS INTEGER) AS prime_26_34 FROM a""")
def scalar_ages(spark: SparkSession, d: str) -> DataFrame:
    """ages, and what models take of them."""
    k, born = F.col("o_orderkey"), F.date_add(F.lit("1960-02-29").cast("date"), F.col("o_custkey").cast("int"))
    age = S.age_years(F.when(k % 3 != 0, born), F.col("o_orderdate").cast("date"), F.when(k % 4 != 0, 25 + F.col("o_custkey") % 12), F.lit("1994-01-01").cast("date"))
    out = load(spark, d, "orders").select("o_orderkey", age.alias("age")).withColumns(S.age_columns(F.col("age")))
    return out.withColumns({"age": r6("age"), "age_squared": F.round("age_squared", 4)})


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity - 25 AS a, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_linenumber - 1 END AS b FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN b <> 0 THEN a / b END, 6) AS ratio, round(coalesce(CASE WHEN b <> 0 THEN a / b END, -1), 6) AS with_default,
    round(CASE WHEN b > 0 THEN greatest(0.0, least(1.0, a / b)) ELSE 0.4 END, 6) AS clipped FROM t""")
def scalar_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Guarded ratios, and rates within [0, 1] with a fallback."""
    a, b = F.col("l_quantity") - 25, F.when(F.col("l_partkey") % 4 != 0, F.col("l_linenumber") - 1)
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(S.safe_div(a, b)).alias("ratio"), r6(S.safe_div(a, b, -1.0)).alias("with_default"), r6(S.clipped_rate(a, b, F.lit(0.4))).alias("clipped"))


@query("""WITH t AS (SELECT o_orderkey, 0.3 + (o_orderkey % 60) / 100.0 AS p FROM orders), s AS (SELECT *, 0.5 + 0.9 * (p - 0.5) AS q FROM t)
    SELECT o_orderkey, round(q, 6) AS shrunk, CASE WHEN greatest(p, 1 - p) >= 0.8 THEN 'very_high' WHEN greatest(p, 1 - p) >= 0.7 THEN 'high' WHEN greatest(p, 1 - p) >= 0.6 THEN 'medium' WHEN greatest(p, 1 - p) >= 0.55 THEN 'low' ELSE 'toss_up' END AS tier FROM s""")
def scalar_tiers(spark: SparkSession, d: str) -> DataFrame:
    """probabilities shrunk to one half, and their tiers."""
    p = (F.lit(0.3).cast("decimal(4,2)") + (F.col("o_orderkey") % 60).cast("decimal(4,2)") / F.lit(100)).cast("decimal(6,4)")
    return load(spark, d, "orders").select("o_orderkey", r6(S.shrink_to_half(p.cast("double"), 0.9)).alias("shrunk"), S.confidence_tier(p.cast("double")).alias("tier"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'NaN'::DOUBLE WHEN 2 THEN 'Infinity'::DOUBLE WHEN 3 THEN 0 ELSE (l_quantity - 25) / 7 END AS v FROM lineitem), g AS (SELECT *, CASE WHEN isfinite(v) THEN v END AS x FROM t)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN x IS NULL THEN 'N/A' ELSE printf('%.1f%%', x * 100) END AS percent, CASE WHEN x IS NULL THEN 'N/A' ELSE printf('%+.1f pp', x * 100) END AS percent_signed, CASE WHEN x IS NULL THEN 'N/A' ELSE printf('%.1f pp', x * 100) END AS points,
    CASE WHEN x IS NULL THEN 'N/A' ELSE printf('%.3f', x) END AS ratio, CASE WHEN x IS NULL THEN 'N/A' WHEN x <> 0 THEN 'Yes' ELSE 'No' END AS flag, CASE WHEN x IS NULL THEN 'N/A' ELSE printf('%+.2f', x) END AS signed, x AS json FROM g""")
def scalar_display(spark: SparkSession, d: str) -> DataFrame:
    """values as text in their units, and doubles that JSON can hold."""
    k = F.col("l_partkey") % 9
    v = F.when(k == 0, None).when(k == 1, float("nan")).when(k == 2, float("inf")).when(k == 3, 0.0).otherwise((F.col("l_quantity") - 25) / 7)
    named = {"percent": S.display(v, "percent"), "percent_signed": S.display(v, "percent", signed=True), "points": S.display(v, "points"), "ratio": S.display(v, "ratio"), "flag": S.display(v, "flag"), "signed": S.display(v, "number", signed=True), "json": S.json_safe(v)}
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[c.alias(n) for n, c in named.items()])
