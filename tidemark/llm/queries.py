"""The numbered queries over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage
from .ctw import lm_scores
from .exact_dedup import exact_dedup
from .jaccard import jaccard_components
from .language import identify_languages
from .media import text_media_report
from .mixing import mixing_rates
from .packing import pack
from .quality import quality_scores
from .ranked import ranked_search
from .suffix import repeated_passages
from .trie import prefix_trie, turn_digests, with_shared_starts
from .url_filter import url_filter
from .winnowing import edited_fingerprints

#: host, path, verdict
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media_report(table(spark, sf_dir, "documents"))


#: Shares of the mixture's words.
LANGUAGE_TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def graded(labels: DataFrame) -> DataFrame:
    """Ratings as grades: 0 toxic, 1 poor, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def language_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rated documents with their language as the domain."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id"), "doc_id", "left_semi")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), graded(table(spark, sf_dir, "labels")), n_grades=3, accept=2)
    return scored.drop("text")


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), language_labels(spark, sf_dir), LANGUAGE_TARGETS)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = Stage(spark, "turns").write(turn_digests(table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie(with_shared_starts(turns))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_suffix_array_dedup, op2_quality_classifier, op3_best_fit_packing, op4_ngram_jaccard_join, op5_mixing_sources, op6_exact_dedup, op7_url_filter, op8_media_columns, op9_language_id, op10_lm_scoring, op11_conversation_prefix_trie, op12_document_fingerprints, op13_ranked_lexical_search)}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op6_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_FOLD} AS x FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY x)""",
    "op7_url_filter": f"""
        WITH rules(host, path, verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
        u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id,
                     translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM u)
        SELECT p.page_id, p.host, p.path,
               arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
               coalesce(arg_max(r.verdict, length(r.host || r.path)), 'allow') AS verdict
        FROM p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
        GROUP BY p.page_id, p.host, p.path""",
    "op4_ngram_jaccard_join": f"""
        WITH RECURSIVE w AS MATERIALIZED (
            SELECT doc_id, list_filter(regexp_split_to_array({_FOLD}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS MATERIALIZED (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [ws] ELSE list_transform(range(1, len(ws) - 3), lambda i: ws[i:i+4]) END) AS g FROM w),
        h AS MATERIALIZED (SELECT doc_id, hash(g) AS g FROM s),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
        e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a)
        SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id
        FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op11_conversation_prefix_trie": """
        WITH t AS (
            SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
            FROM conversations WHERE conv_id IS NOT NULL),
        crc AS (  -- after each byte eight steps, marked by -1
            SELECT c, xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(c::VARCHAR, ''), lambda b: [ascii(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
                          lambda a, y: CASE WHEN y >= 0 THEN xor(a, y) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % 6 AS h
            FROM (SELECT DISTINCT c FROM t)),
        u AS (SELECT c, 1 AS part, i, r, x FROM t JOIN crc USING (c) WHERE i > h
              UNION ALL SELECT crc.c, 0, i, r, x FROM crc JOIN t ON t.c = crc.c - crc.c % 100 AND i <= h
              UNION ALL SELECT c, -1, 0, '', '' FROM crc),
        p AS MATERIALIZED (
            SELECT c, row_number() OVER w - 1 AS depth, x, count(*) OVER (PARTITION BY c) - 1 AS len,
                   sha256(string_agg(length(r) || ' ' || r || length(x) || ' ' || x, '') OVER w) AS k
            FROM u WINDOW w AS (PARTITION BY c ORDER BY part, i)),
        p2 AS MATERIALIZED (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY depth) AS pk FROM p),
        n AS MATERIALIZED (
            SELECT depth, k, any_value(pk) AS pk, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(length(x)) AS saved,
                   sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (depth = len), '')) AS ends_sha256
            FROM p2 GROUP BY depth, k),
        ch AS (SELECT pk AS k, count(*) AS n_children FROM n WHERE pk IS NOT NULL GROUP BY pk),
        nn AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (k)),
        s AS (SELECT p2.k, count(*) FILTER (nn.n_children = 0) AS n_leaves, CAST(sum(nn.saved) AS BIGINT) AS saved_tokens
              FROM nn JOIN p2 ON p2.c = nn.conv_id AND p2.depth <= nn.depth GROUP BY p2.k)
        SELECT nn.conv_id, nn.depth, up.conv_id AS parent_conv_id, nn.n_convs, nn.n_children, n_leaves, saved_tokens, nn.ends_sha256
        FROM nn JOIN s USING (k) LEFT JOIN nn up ON up.k = nn.pk""",
    "op13_ranked_lexical_search": r"""
        WITH d AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
        f AS MATERIALIZED (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM d) GROUP BY ALL),
        df AS (SELECT t, count(*) AS df FROM f GROUP BY t),
        s AS MATERIALIZED (SELECT count(*) FILTER (len(ts) > 0) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d),
        m AS (SELECT doc_id, 100 - 50 + (50 * len(ts) * s.n) // s.l AS m FROM d, s WHERE len(ts) > 0),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
        w AS (SELECT item_id, q.t, CAST(floor(1000 * ln((2 * s.n + 2) / (2 * df.df + 1))) AS BIGINT) AS w FROM q JOIN df USING (t), s),
        r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM w JOIN f USING (t) JOIN m USING (doc_id) GROUP BY ALL),
        k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
        SELECT * FROM k WHERE rank <= 50""",
}
