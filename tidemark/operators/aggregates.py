"""Descriptive aggregates over observations, with their missing-value rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import blankish, finite_non_negative
from .history import before, if_dated, last_before

#: name, numerator, denominator, factor
METRICS = (("accuracy", "successes", "attempts", 1.0), ("successes_per_minute", "successes", "seconds", 60.0), ("attempts_per_15", "attempts", "seconds", 900.0))


def pooled_ratios(obs: DataFrame, by: Sequence[str], metrics: Sequence[tuple[str, str, str, float]] = METRICS) -> DataFrame:
    """(by, metric, value, eligible, missing): factor * sum(numerator) / sum(denominator) over rows that have both; the others are counted as missing.

    This differs from the cumulative features, where a missing number counts as 0.
    """
    aggs = []
    for name, num, den, factor in metrics:
        n, d = finite_non_negative(F.col(num)), finite_non_negative(F.col(den))
        ok = n.isNotNull() & d.isNotNull()
        total = F.sum(F.when(ok, d))
        aggs += [F.when(total > 0, factor * F.sum(F.when(ok, n)) / total).alias(f"{name}|value"), F.count_if(ok).alias(f"{name}|eligible"), F.count_if(~ok).alias(f"{name}|missing")]
    wide = obs.groupBy(*by).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(m[0]).alias("metric"), *[F.col(f"`{m[0]}|{c}`").alias(c) for c in ("value", "eligible", "missing")]) for m in metrics])
    return wide.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def form(obs: DataFrame, cutoff: Column, sizes: Sequence[int] = (3, 5), metrics=METRICS, key: str = "entity_id") -> DataFrame:
    """(key, metric, scope, value) for the last few contests before the cutoff and for all of them; scope is last_<n> or career."""
    w = Window.partitionBy(key).orderBy(F.desc("event_day"), F.desc("contest_id"))
    old = obs.filter(F.col("event_day") < cutoff).withColumn("_n", F.row_number().over(w))
    scopes = F.filter(F.array(F.lit("career"), *[F.when(F.col("_n") <= n, F.lit(f"last_{n}")) for n in sizes]), lambda s: s.isNotNull())
    return pooled_ratios(old.withColumn("scope", F.explode(scopes)), [key, "scope"], metrics).select(key, "metric", "scope", "value")


def weighted_mean(value: Column, weight: Column) -> Column:
    """Over rows with a value and a positive weight."""
    ok = value.isNotNull() & (weight > 0)
    return F.when(F.sum(F.when(ok, weight)) > 0, F.sum(F.when(ok, value * weight)) / F.sum(F.when(ok, weight)))


def opponent_strength(sides: DataFrame, key: str = "entity_id", day: str = "event_day") -> DataFrame:
    """Rating sides (with opponent_rating) and the mean, the greatest and the number of earlier opponents' ratings; null for undated rows."""
    w = before(key, day)
    named = {"opponents_mean": F.avg, "opponents_max": F.max, "opponents": F.count}
    return sides.withColumns({name: if_dated(f("opponent_rating").over(w), day) for name, f in named.items()})


def rating_weighted_form(sides: DataFrame, key: str = "entity_id", day: str = "event_day", value: str = "value") -> DataFrame:
    """sides with weighted_form: the mean of earlier values, weighted by the opponents' ratings; null for undated rows."""
    w = before(key, day)
    ok = F.col(value).isNotNull() & (F.col("opponent_rating") > 0)
    total = F.sum(F.when(ok, F.col("opponent_rating"))).over(w)
    mean = F.sum(F.when(ok, F.col(value) * F.col("opponent_rating"))).over(w) / total
    return sides.withColumn("weighted_form", if_dated(F.when(total > 0, mean), day))


def rating_trend(sides: DataFrame, n: int = 3, key: str = "entity_id", day: str = "event_day", tie: str = "contest_id") -> DataFrame:
    """sides with trend: the rating less the one n contests before, or as many as there are; 0 at the first, null for undated rows."""
    w = Window.partitionBy(key).orderBy(F.col(day).asc_nulls_last(), tie)
    base = F.coalesce(F.lag("rating", n).over(w), F.first("rating").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return sides.withColumn("trend", if_dated(F.col("rating") - base, day))


def method_mix(obs: DataFrame, key: str = "entity_id", day: str = "event_day") -> DataFrame:
    """obs with the shares of earlier wins by method, and finish_loss_rate.

    All are null where a decisive earlier contest's method is unknown, and for undated rows.
    """
    w = before(key, day)
    total = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)).over(w), F.lit(0))
    won, lost, m = F.col("won") == 1, F.col("won") == 0, F.upper(F.col("method"))
    known = total(F.col("won").isNotNull() & blankish(F.col("method"))) == 0
    wins, losses = total(won), total(lost)
    share = lambda part, whole: if_dated(F.when(known & (whole > 0), part / whole), day)
    finish = m.contains("KO") | m.contains("SUB")
    return obs.withColumns(
        {
            "knockout_share": share(total(won & m.contains("KO")), wins),
            "submission_share": share(total(won & m.contains("SUB")), wins),
            "decision_share": share(total(won & m.contains("DEC")), wins),
            "finish_loss_rate": share(total(lost & finish), losses),
        }
    )


def after_loss(obs: DataFrame, key: str = "entity_id", day: str = "event_day", tie: str = "contest_id") -> DataFrame:
    """obs with after_loss and after_finish_loss: what the last contest of an earlier day was; null without one."""
    finish = F.coalesce(F.upper("method").contains("KO") | F.upper("method").contains("SUB"), F.lit(False))
    last = last_before(F.struct(F.coalesce(F.col("won") == 0, F.lit(False)).alias("lost"), finish.alias("finish")), F.lit(True), key, day, tie)
    out = obs.withColumn("_l", if_dated(last, day))
    return out.withColumns({"after_loss": F.col("_l.lost").cast("int"), "after_finish_loss": (F.col("_l.lost") & F.col("_l.finish")).cast("int")}).drop("_l")


def outcome_counts(obs: DataFrame) -> DataFrame:
    """(result, contests): contests by outcome, decisive ones as win_loss; one aggregation by contest and one by outcome."""
    per = obs.groupBy("contest_id").agg(F.max(F.when(F.col("result").isin("win", "loss"), "win_loss").otherwise(F.col("result"))).alias("result"))
    return per.groupBy(F.coalesce("result", F.lit("unknown")).alias("result")).agg(F.count(F.lit(1)).alias("contests"))


def identity_cardinality(rows: DataFrame, key: str = "entity_id", name: str = "name") -> DataFrame:
    """One row: entities, names, the most names of an entity and the most entities of a name."""
    pairs = rows.select(key, name).distinct()
    a = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("entities"), F.max("n").alias("most_names"))
    b = pairs.groupBy(name).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("names"), F.max("n").alias("most_entities"))
    return a.crossJoin(b)


def before_after(old: DataFrame, new: DataFrame, key: Sequence[str], day: str, label: str | None = None) -> DataFrame:
    """(state, rows, keys, duplicates, last_day, unlabelled) of a table before and after an update."""
    def facts(df: DataFrame, state: str) -> DataFrame:
        gone = F.count_if(F.col(label).isNull()) if label else F.lit(None).cast("bigint")
        return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(*key).alias("keys"), F.max(day).alias("last_day"), gone.alias("unlabelled")).select(F.lit(state).alias("state"), "rows", "keys", (F.col("rows") - F.col("keys")).alias("duplicates"), "last_day", "unlabelled")

    return facts(old, "before").unionByName(facts(new, "after"))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows chosen by a hash of their key: the same rows in every run, and on every engine that has MD5."""
    return df.orderBy(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key).limit(n)


def metric_table(snapshot: DataFrame, specs: Sequence[tuple[str, str, Sequence[str]]], key: str = "contest_id") -> DataFrame:
    """(key, metric, unit, a, b, diff): each spec is (metric, unit, candidate base names); the first candidate that both sides have is used."""
    items = []
    for metric, unit, candidates in specs:
        found = [c for c in candidates if f"{c}_a" in snapshot.columns and f"{c}_b" in snapshot.columns]
        a = F.coalesce(*[F.col(f"{c}_a").cast("double") for c in found]) if found else F.lit(None).cast("double")
        b = F.coalesce(*[F.col(f"{c}_b").cast("double") for c in found]) if found else F.lit(None).cast("double")
        items.append(F.struct(F.lit(metric).alias("metric"), F.lit(unit).alias("unit"), a.alias("a"), b.alias("b"), (a - b).alias("diff")))
    return snapshot.select(key, F.explode(F.array(*items)).alias("m")).select(key, "m.*")


def observations_of(table: DataFrame, rules: Sequence[tuple[str, Column, str]], limit: int = 3, key: str = "contest_id") -> DataFrame:
    """(key, place, rule, text) of the first rules that hold, in the rules' order, at most `limit` for each row."""
    items = F.filter(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(text).alias("text"))) for name, when, text in rules]), lambda x: x.isNotNull())
    return table.select(key, F.posexplode(F.slice(items, 1, limit)).alias("place", "o")).select(key, "place", "o.rule", "o.text")


def parity(batch: DataFrame, live: DataFrame, keys: Sequence[str], features: Sequence[str], tolerance: float = 1e-8) -> DataFrame:
    """(feature, n, mismatches, status): the same features from two paths, compared within a tolerance; a null equals only a null."""
    both = batch.select(*keys, *[F.col(f).cast("double").alias(f"_x_{f}") for f in features]).join(live.select(*keys, *[F.col(f).cast("double").alias(f"_y_{f}") for f in features]), list(keys))
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_x_{f}").alias("x"), F.col(f"_y_{f}").alias("y")) for f in features])
    long = both.select(F.explode(items).alias("i")).select("i.*")
    bad = (F.col("x").isNull() != F.col("y").isNull()) | (F.abs(F.col("x") - F.col("y")) > tolerance)
    out = long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(bad, F.lit(False))).alias("mismatches"))
    return out.withColumn("status", F.when(F.col("mismatches") == 0, "PASS").when(F.col("mismatches") < F.col("n"), "PARTIAL").otherwise("FAIL"))


def collapse(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: numbers are averaged, other values are those of the first row in the stated order."""
    numbers = {c for c, t in df.dtypes if t in ("int", "bigint", "double", "float")}
    rest = [c for c in df.columns if c not in keys]
    first = lambda c: F.min_by(c, F.struct(*order)).alias(c)
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) if c in numbers else first(c) for c in rest]).select(*df.columns)
