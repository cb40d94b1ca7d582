"""Name resolution: exact keys, token sets, close matches, search."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.scalars import name_key, token_jaccard


@pandas_udf(T.DoubleType())
def close_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two keys."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def resolve(requests: DataFrame, catalog: DataFrame, name: str = "name", key: str = "entity_id") -> DataFrame:
    """requests with the entity whose name key is equal, and status: resolved, ambiguous or not_found."""
    known = catalog.groupBy(name_key(F.col(name)).alias("_k")).agg(F.count_distinct(key).alias("_n"), F.min(key).alias("_id"))
    joined = requests.join(known, name_key(requests[name]) == known["_k"], "left")
    status = F.when(F.col("_n").isNull(), "not_found").when(F.col("_n") > 1, "ambiguous").otherwise("resolved")
    return joined.select(*requests.columns, F.when(F.col("_n") == 1, F.col("_id")).alias(key), status.alias("status"))


def _rare_first(names: DataFrame, counts: DataFrame, keep: Column) -> DataFrame:
    """names (_key and others) with `word`: of each name's distinct words the `keep` rarest ones, by how many catalog names have them."""
    words = names.withColumn("word", F.explode(F.array_distinct(F.split("_key", " "))))
    ranked = words.join(counts, "word", "left").groupBy(*names.columns).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("_ws"))  # a name's words
    return ranked.select(*names.columns, F.explode(F.slice("_ws", 1, F.greatest(F.lit(1), keep(F.size("_ws"))))).alias("_w")).select(*names.columns, F.col("_w.word").alias("word"))


def _word_counts(catalog: DataFrame, name: str) -> DataFrame:
    return catalog.select(name_key(F.col(name)).alias("k")).distinct().select(F.explode(F.array_distinct(F.split("k", " "))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def token_suggestions(requests: DataFrame, catalog: DataFrame, least: float = 0.0, n: int = 3, name: str = "name") -> DataFrame:
    """(request, name, jaccard): the n catalog names with most words in common, where more than `least` of all words are.

    Names are compared that share one of their rarest words: with k words, k - least * k + 1 of them cannot all be missed. So a common
    word meets few names unless least is 0.
    """
    counts = _word_counts(catalog, name)
    keep = lambda k: k - F.ceil(k * F.lit(least)).cast("int") + 1
    side = lambda df, a: _rare_first(df.select(name_key(F.col(name)).alias("_key"), F.col(name).alias(f"{a}_name")).distinct(), counts, keep).withColumnRenamed("_key", a)
    pairs = side(requests, "q").join(side(catalog, "c"), "word").select("q", "c", "q_name", "c_name").distinct()
    scored = pairs.withColumn("jaccard", token_jaccard(F.col("q"), F.col("c"))).filter(F.col("jaccard") > least)
    w = Window.partitionBy("q_name").orderBy(F.desc("jaccard"), "c_name")
    return scored.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).select(F.col("q_name").alias("request"), F.col("c_name").alias(name), "jaccard")


def close_matches(catalog: DataFrame, request: str, cutoff: float = 0.6, n: int = 3, name: str = "name") -> DataFrame:
    """The n names most similar to one request, over the whole catalog, by similarity and then name.

    Twice the letters in common (each as often as both have it) over all letters bounds the similarity, so only names that can reach the
    cutoff go to the Python function.
    """
    plain = catalog.sparkSession.range(1).select(name_key(F.lit(request))).first()[0]
    key = name_key(F.col(name))
    common = F.lit(0)
    for letter in sorted(set(plain)):
        common = common + F.least(F.lit(plain.count(letter)), F.length(key) - F.length(F.replace(key, F.lit(letter), F.lit(""))))
    possible = catalog.select(name).distinct().filter(2 * common >= F.lit(cutoff) * (F.length(key) + len(plain)) - 1e-9)
    scored = possible.withColumn("ratio", close_ratio(key, F.lit(plain)))
    return scored.filter(F.col("ratio") >= cutoff).orderBy(F.desc("ratio"), name).limit(n)


def _letters(key: Column) -> Column:
    """A key's letters, each with how often it came before: two keys share as many of these as they have letters in common."""
    letters = F.split(key, "")
    return F.transform(letters, lambda x, i: F.concat(x, F.size(F.filter(F.slice(letters, 1, i), lambda y: y == x)).cast("string")))


def close_matches_all(requests: DataFrame, catalog: DataFrame, cutoff: float = 0.6, n: int = 3, name: str = "name") -> DataFrame:
    """(request, name, ratio): for each request the n catalog names most similar to it, of `cutoff` at least, by similarity and then name.

    Similarity c of keys with a and b letters needs c (a + b) / 2 letters in common, so c a / (2 - c) at least. Hence two such keys share one of the rarest
    a - ceil(c a / (2 - c)) + 1 numbered letters of each: these are the inverted index. What it finds must agree in length and in common letters, and where similarity
    asks for them in pairs of neighbouring letters, before the similarity itself is computed, once for each pair of keys.
    """
    key = name_key(F.col(name))
    q = requests.select(F.col(name).alias("request"), key.alias("_key")).filter("_key <> ''").distinct()
    c = catalog.select(F.col(name), key.alias("_key")).filter("_key <> ''").distinct()
    shape = lambda df: df.select("_key").distinct().withColumns({"_l": _letters(F.col("_key")), "_p": F.transform(F.sequence(F.lit(1), F.greatest(F.length("_key") - 1, F.lit(1))), lambda i: F.substring(F.col("_key"), i, F.lit(2)))})
    known, asked = shape(c), shape(q)
    counts = known.select(F.explode("_l").alias("letter")).groupBy("letter").agg(F.count(F.lit(1)).alias("n"))
    least = lambda size: F.ceil(F.lit(cutoff / (2 - cutoff)) * size - 1e-9).cast("int")

    def index(df: DataFrame, p: str) -> DataFrame:
        spelled = df.withColumn("letter", F.explode("_l")).join(counts, "letter", "left")
        ranked = spelled.groupBy("_key", "_l", "_p").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "letter"))).alias("_r"))  # a name's letters
        rare = F.slice("_r", 1, F.size("_r") - least(F.size("_r")) + 1)
        return ranked.select(*[F.col(x).alias(f"{p}{x}") for x in ("_key", "_l", "_p")], F.explode(rare).alias("_x")).select(f"{p}_key", f"{p}_l", f"{p}_p", F.col("_x.letter").alias("letter"))

    met = index(asked, "q").join(index(known, "c"), "letter")
    a, b = F.size("q_l"), F.size("c_l")
    met = met.filter(2 * F.least(a, b) >= F.lit(cutoff) * (a + b) - 1e-9).dropDuplicates(["q_key", "c_key"])
    common = 2 * F.size(F.array_intersect("q_l", "c_l")) >= F.lit(cutoff) * (a + b) - 1e-9
    in_pairs = F.size(F.filter("q_p", lambda x: F.array_contains("c_p", x))) >= (a + b) * (1.5 * cutoff - 1) - 1 - 1e-9
    close = met.filter(common & in_pairs).select("q_key", "c_key").withColumn("ratio", close_ratio(F.col("c_key"), F.col("q_key"))).filter(F.col("ratio") >= cutoff)
    named = close.join(q, close.q_key == q._key).select("request", "c_key", "ratio").join(c, F.col("c_key") == c._key).select("request", name, "ratio")
    w = Window.partitionBy("request").orderBy(F.desc("ratio"), name)
    return named.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def resolve_or_suggest(requests: DataFrame, catalog: DataFrame, cutoff: float = 0.6, n: int = 3, name: str = "name", key: str = "entity_id") -> DataFrame:
    """resolve(), with `suggestions`: for names that aren't found the n closest ones, best first; else an empty array."""
    found = resolve(requests, catalog, name, key)
    close = close_matches_all(found.filter("status = 'not_found'").select(name), catalog, cutoff, n, name)
    best = close.groupBy(F.col("request").alias(name)).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("ratio")).alias("r"), F.col(name).alias("s")))), lambda x: x["s"]).alias("suggestions"))  # n at most
    return found.join(best, name, "left").select(*found.columns, F.coalesce("suggestions", F.array().cast("array<string>")).alias("suggestions"))


def search_or_close(catalog: DataFrame, text: str, n: int = 10, cutoff: float = 0.6, name: str = "name") -> DataFrame:
    """(name, how): what search() finds; where that is nothing, the closest names."""
    hits = search(catalog, text, n, name).withColumn("how", F.lit("holds"))
    asked = catalog.sparkSession.createDataFrame([(text,)], f"`{name}` string")
    close = close_matches_all(asked, catalog, cutoff, n, name).select(name, F.lit("close").alias("how"))
    both = hits.unionByName(close).withColumn("_best", F.max("how").over(Window.partitionBy(F.lit(0))))  # 2 n rows; holds sorts after close
    return both.filter("how = _best").drop("_best")


def search(catalog: DataFrame, text: str, n: int = 10, name: str = "name") -> DataFrame:
    """Names that hold the text: exact ones first, then those that start with it, then by name. Fewer than two letters find nothing."""
    k, q = name_key(F.col(name)), name_key(F.lit(text))
    hit = k.contains(q) & (F.length(q) >= 2)
    return catalog.select(name).distinct().filter(hit).orderBy(k != q, ~k.startswith(q), name).limit(n)


def majority_ids(rows: DataFrame, name: str = "name", key: str = "entity_id") -> DataFrame:
    """(name key, entity, n): for each key the entity seen most often, the smaller id of equals."""
    counts = rows.groupBy(name_key(F.col(name)).alias("name_key"), key).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("name_key").agg(F.max(F.struct("n", (-F.col(key)).alias("_o"), key)).alias("b"))
    return best.select("name_key", F.col(f"b.{key}").alias(key), "b.n")


def overlay(*sources: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """One row for each key: each field's last value that isn't null in the source of highest priority (the last one) that has any."""
    parts = [s.groupBy(key).agg(*[F.max_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), F.col(order))).alias(f"{f}_{i}") for f in fields]) for i, s in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, key, "full_outer")
    pick: list[Column] = [F.coalesce(*[F.col(f"{f}_{i}") for i in reversed(range(len(sources)))]).alias(f) for f in fields]
    return out.select(key, *pick)


def resolve_tokens(requests: DataFrame, catalog: DataFrame, name: str = "name") -> DataFrame:
    """requests with `canonical` and `how`: an equal key; else the only name whose words hold all of the request's; else the one
    name with the greatest share of common words, of which it needs all but one and two at least. Otherwise null and unresolved.

    A name with all but one of the request's words has one of its two rarest ones: only such names are compared.
    """
    words = lambda c: F.array_distinct(F.split(c, " "))
    q = _rare_first(requests.select(F.col(name).alias("_q"), name_key(F.col(name)).alias("_key")).distinct(), _word_counts(catalog, name), lambda k: F.lit(2))
    c = catalog.select(F.col(name).alias("_c"), name_key(F.col(name)).alias("_ck")).distinct()
    pairs = q.withColumnRenamed("_key", "_qk").join(c.withColumn("word", F.explode(words(F.col("_ck")))), "word").drop("word").distinct()
    common = F.size(F.array_intersect(words(F.col("_qk")), words(F.col("_ck"))))
    n = F.size(words(F.col("_qk")))
    facts = pairs.withColumns({"_all": common == n, "_equal": F.col("_qk") == F.col("_ck"), "_j": token_jaccard(F.col("_qk"), F.col("_ck")), "_ok": common >= F.greatest(F.lit(2), n - 1)})
    best = facts.groupBy("_q").agg(
        F.count_if("_equal").alias("n_equal"),
        F.max(F.when(F.col("_equal"), F.col("_c"))).alias("equal"),
        F.count_if("_all").alias("n_all"),
        F.max(F.when(F.col("_all"), F.col("_c"))).alias("holds"),
        F.max(F.when(F.col("_ok"), F.struct("_j", "_c"))).alias("top"),
        F.sort_array(F.collect_list(F.when(F.col("_ok"), F.col("_j"))), asc=False).alias("js"),
    )
    only_top = F.col("top").isNotNull() & ((F.size("js") == 1) | (F.try_element_at("js", F.lit(1)) > F.try_element_at("js", F.lit(2))))
    how = F.when(F.col("n_equal") == 1, "equal").when((F.col("n_equal") == 0) & (F.col("n_all") == 1), "holds").when((F.col("n_equal") == 0) & only_top, "overlap").otherwise("unresolved")
    found = best.select("_q", how.alias("how"), F.when(how == "equal", F.col("equal")).when(how == "holds", F.col("holds")).when(how == "overlap", F.col("top._c")).alias("canonical"))
    return requests.join(found, requests[name] == found["_q"], "left").select(*[requests[x] for x in requests.columns], "canonical", F.coalesce("how", F.lit("unresolved")).alias("how"))


def fill_absent(snapshot: DataFrame, fallback: DataFrame, key: str, wanted: list[str], aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """snapshot with the wanted columns that it doesn't have at all, from the fallback; a null in a column it has is a statement and stays.

    A wanted name that the fallback lacks too is taken from the first of its aliases there, else it is null.
    """
    lacking = [c for c in wanted if c not in snapshot.columns]
    source = {c: next((a for a in [c, *(aliases or {}).get(c, [])] if a in fallback.columns), None) for c in lacking}
    found = fallback.select(key, *[F.col(s).alias(c) if s else F.lit(None).cast("string").alias(c) for c, s in source.items()]).dropDuplicates([key])
    return snapshot.join(found, key, "left")
