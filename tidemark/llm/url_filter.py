"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

A rule is (host, path): it fits the host and all its subdomains where the URL's path starts with the rule's.
A URL's candidates are its host suffixes joined with the leading parts of its path that are as long as some
rule's path. The filter lets candidates through that may be listed; a hash join with the list removes false
positives; of the rules that fit, the longest wins. All of it is DataFrame expressions and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: A block is one cache line: 8 words of 64 bits. A key sets one bit in each word.
BLOCK_WORDS = 8


def canonical(url, at: int):
    """Host and path of a URL column: after the first '://', up to '/', '?', '#' or the end."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", at)
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(rest, UPPER, LOWER) if at == 1 else rest


def _bits(key: Column) -> list[Column]:
    """The bit of each word that a key sets."""
    g = F.xxhash64(key, F.lit(7))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(BLOCK_WORDS)]


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0 .. w7): the blocks that some key is in; combines on the map side. At most n_blocks rows of 72 bytes."""
    key = F.col("key")
    return keys.groupBy(_block(key, n_blocks).alias("block")).agg(*[F.bit_or(bit).alias(f"w{i}") for i, bit in enumerate(_bits(key))])


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", bits_per_key: int = 16, max_blocks: int = 1 << 17) -> DataFrame:
    """One row per page: id, host, path, rule (host + path of the longest rule that fits, else null), verdict.

    rules has host, path and verdict; rows with a null host are ignored, a null path counts as empty, and of
    rules with the same host and path the one that blocks wins. Of rules of the same length (host and path together) that
    fit, one that blocks wins, then the one with the longer host. A null URL or one without '://' has an empty
    host and path and gets the default verdict, as has every URL that no rule fits. Repeated pages give
    repeated rows. The filter has at most max_blocks blocks of 64 bytes (8 MB), so it can be broadcast; a longer list only makes
    it pass more candidates to the join, which Spark broadcasts when the list is small and shuffles otherwise.
    """
    listed = rules.filter("host is not null").select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    blocks_first = F.max_by("verdict", F.when(F.col("verdict") == "block", 1).otherwise(0))
    listed = listed.groupBy("host", "path").agg(blocks_first.alias("listed_verdict")).withColumn("key", F.concat_ws("\n", "host", "path"))
    shape = listed.agg(F.count(F.lit(1)), F.sort_array(F.collect_set(F.length("path"))), F.sort_array(F.collect_set(F.size(F.split("host", r"\."))))).first()
    n_rules, path_lengths, label_counts = shape[0], list(shape[1]), list(shape[2])
    n_blocks = int(min(max_blocks, max(1, n_rules * bits_per_key // 512 + 1)))

    labels = F.split("host", r"\.")
    lengths = F.array(*[F.lit(int(n)) for n in path_lengths]) if path_lengths else F.array().cast("array<int>")
    counts = F.array(*[F.lit(int(n)) for n in label_counts]) if label_counts else F.array().cast("array<int>")
    suffixes = F.transform(F.filter(counts, lambda n: n <= F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    heads = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    candidates = F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda p: F.concat_ws("\n", s, p))))

    split = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", canonical(F.col("url"), 1).alias("host"), canonical(F.col("url"), 2).alias("path"))
    # a page without a candidate keeps one row; the same page more than once is one group, whose copies are counted at its first candidate
    asked = split.select("id", "host", "path", F.posexplode_outer(candidates).alias("at", "key")).withColumn("at", F.coalesce("at", F.lit(0)))
    bloom = F.broadcast(bloom_blocks(listed, n_blocks))  # 72 bytes for each of n_blocks at most
    inside = F.lit(True)
    for i, bit in enumerate(_bits(F.col("key"))):
        inside = inside & (F.col(f"w{i}").bitwiseAND(bit) != 0)
    tested = asked.join(bloom, _block(F.col("key"), n_blocks) == F.col("block"), "left").withColumn("listed", F.coalesce(F.col("key").isNotNull() & inside, F.lit(False)))
    passed = tested.filter("listed or at = 0").select("id", "host", "path", "at", F.when(F.col("listed"), F.col("key")).alias("key"))
    # the exact join has only keys that passed; what has none goes round it
    fits = passed.filter("key is not null").join(listed.select("key", F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "listed_verdict"), "key", "left").drop("key")
    fits = fits.unionByName(passed.filter("key is null").drop("key"), allowMissingColumns=True)
    rule = F.concat("rule_host", "rule_path")
    order = F.struct(F.length(rule).alias("length"), (F.col("listed_verdict") == "block").alias("blocks"), F.length("rule_host").alias("host_length"), rule.alias("rule"), "listed_verdict")
    best = fits.groupBy("id", "host", "path").agg(F.max(F.when(rule.isNotNull(), order)).alias("best"), F.count_if(F.col("at") == 0).alias("copies"))
    named = best.select("id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.listed_verdict"), F.lit(default)).alias("verdict"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    return named.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict")
