"""Registered queries that run the column functions over the tables' own texts: documents, page URLs and titles, event properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import page_cache
from ..streaming import twins
from .contests import load
from .queries import query, r6
from .scalar_queries import _CLEAN, _FLOAT


@query(rf"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '[ \t\n\r\f]+'), lambda x: regexp_matches(x, '[0-9]'))) AS word FROM documents),
    t AS (SELECT doc_id, word, word AS y FROM w), f AS (SELECT *, {_FLOAT} AS v FROM t)
    SELECT doc_id, word, TRY_CAST(nullif(regexp_extract(y, '-?\d+'), '') AS BIGINT) AS whole, v AS number, CASE WHEN v > 1 THEN v / 100 ELSE v END AS share FROM f""")
def text_numbers(spark: SparkSession, d: str) -> DataFrame:
    """every word of the documents that holds a digit, as a whole number, a number and a share."""
    words = load(spark, d, "documents").select("doc_id", F.explode(F.filter(F.split("text", r"[ \t\n\r\f]+"), lambda x: x.rlike("[0-9]"))).alias("word"))
    x = F.col("word")
    return words.select("doc_id", "word", S.parse_int(x).alias("whole"), S.parse_float(x).alias("number"), S.parse_percent(x).alias("share"))


@query(rf"""SELECT page_id, list_last(string_split(regexp_replace({_CLEAN.format('url')}, '/+$', ''), '/')) AS id,
    left(regexp_replace(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 80) || '_' || left(sha1(url), 16) || '.html' AS slug, regexp_matches(url, '^https?://') AS has_scheme FROM pages""")
def page_url_ids(spark: SparkSession, d: str) -> DataFrame:
    """the id in every page's URL, a file name for it, and whether it needs a scheme."""
    p, url = load(spark, d, "pages"), F.col("url")
    return p.select("page_id", S.id_from_url(url).alias("id"), S.url_slug(url).alias("slug"), (S.with_scheme(url) == url).alias("has_scheme"))


@query("""WITH t AS (SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages)
    SELECT page_id, strip_accents(lower(regexp_replace(title, '\\s+', ' ', 'g'))) AS key FROM t""")
def page_title_keys(spark: SparkSession, d: str) -> DataFrame:
    """every page's title as a key for equality of names."""
    return load(spark, d, "pages").select("page_id", S.name_key(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("key"))


@query("""WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value FROM events),
    o AS (SELECT event_id, 1 + (100 + k) / 100.0 AS a, CASE WHEN value > 1 THEN CASE WHEN value >= 100 THEN 1 + value / 100 ELSE value END END AS b FROM e)
    SELECT event_id, round(a, 6) AS decimal_a, round(b, 6) AS decimal_b, round((1 / a) / (1 / a + 1 / b), 6) AS market_a FROM o""")
def event_odds(spark: SparkSession, d: str) -> DataFrame:
    """properties and values of events read as odds in both notations, and the market's probability without its margin."""
    e = load(spark, d, "events")
    a = S.decimal_odds(F.format_string("+%d", F.get_json_object("props", "$.k").cast("bigint") + 100))
    b = S.decimal_odds(F.col("value").cast("string"))
    return e.select("event_id", r6(a).alias("decimal_a"), r6(b).alias("decimal_b"), r6(S.no_vig(a, b)[0]).alias("market_a"))


_HOST = "lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


@query(f"SELECT page_id, {_HOST} AS host, length(html) AS n_chars FROM pages")
def page_cache_scan(spark: SparkSession, d: str) -> DataFrame:
    """All pages, written to a cache in two batches and read through the data source."""
    root, p = twins.shared_root(spark, "pages"), load(spark, d, "pages")
    for batch in (0, 1):
        page_cache.write_batch(p.filter(F.col("page_id") % 2 == batch), root, batch)
    return page_cache.page_cache(spark, root).select("page_id", "host", F.length("html").alias("n_chars"))


@query(f"SELECT {_HOST} AS host, count(*) AS pages, CAST(sum(length(html)) AS BIGINT) AS n_chars FROM pages GROUP BY 1")
def page_cache_stream(spark: SparkSession, d: str) -> DataFrame:
    """The cache's batches as a stream that stops after the first and goes on: each page once."""
    root, p = twins.shared_root(spark, "pages"), load(spark, d, "pages")
    for batch in (0, 1):
        page_cache.write_batch(p.filter(F.col("page_id") % 2 == batch), f"{root}/cache", batch)
        live = page_cache.page_cache(spark, f"{root}/cache", stream=True).select("page_id", "host", F.length("html").alias("n_chars"))
        twins.run_into(live, root)
    seen = twins.read_or_empty(spark, f"{root}/table", live.schema)
    return seen.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum("n_chars").cast("bigint").alias("n_chars"))
