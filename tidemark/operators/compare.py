"""The as-of comparison of two entities, and comparisons of saved reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import expected_score, shrink_to_half
from .history import as_of, career_rates, career_specs

METRICS = ("contests", "wins", "losses", "win_rate", "accuracy", "per_minute", "days_since_last")


def infer_group(obs: DataFrame, a, b, cutoff: Column) -> DataFrame:
    """One row, `grp` and `warning`: the group both sides last met in; one side's if the other has none; else Unknown."""
    last = obs.filter((F.col("event_day") < cutoff) & F.col("entity_id").isin(a, b)).groupBy().agg(
        *[F.max_by("grp", F.when(F.col("entity_id") == e, F.struct("event_day", "contest_id"))).alias(n) for e, n in ((a, "a"), (b, "b"))]
    )
    grp = F.when(F.col("a") == F.col("b"), F.col("a")).when(F.col("b").isNull(), F.col("a")).when(F.col("a").isNull(), F.col("b"))
    warning = F.when(F.col("a").isNull() & F.col("b").isNull(), "no_history").when(F.col("a").isNull() | F.col("b").isNull(), "one_side_only").when(F.col("a") != F.col("b"), "groups_differ")
    return last.select(F.coalesce(grp, F.lit("Unknown")).alias("grp"), warning.alias("warning"))


def compare(obs: DataFrame, a, b, cutoff: Column) -> DataFrame:
    """(metric, a, b, diff) of two entities from what was known before the cutoff. The entity filter reaches the scan's side of the plan."""
    sides = career_rates(as_of(obs.filter(F.col("entity_id").isin(a, b)), career_specs(), cutoff).withColumn("event_day", cutoff))
    long = sides.select("entity_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS])).alias("m")).select("entity_id", "m.*")
    pick = lambda e: F.max(F.when(F.col("entity_id") == e, F.col("value")))
    return long.groupBy("metric").agg(pick(a).alias("a"), pick(b).alias("b")).withColumn("diff", F.col("a") - F.col("b"))


def with_probability(ratings: DataFrame, shrink: float = 0.9) -> DataFrame:
    """Rating snapshots with the probability that side a wins, shrunk to one half."""
    return ratings.withColumn("probability", shrink_to_half(expected_score(F.col("rating_a"), F.col("rating_b")), shrink))


def coverage(obs: DataFrame, cutoff: Column, group: str) -> DataFrame:
    """(entity, contests, last_day, last_grp, in_group) from what was known before the cutoff."""
    old = obs.filter(F.col("event_day") < cutoff)
    return old.groupBy("entity_id").agg(F.count(F.lit(1)).alias("contests"), F.max("event_day").alias("last_day"), F.max_by("grp", F.struct("event_day", "contest_id")).alias("last_grp"), F.count_if(F.col("grp") == group).alias("in_group"))


def compare_reports(old: DataFrame, new: DataFrame, key: str = "metric", value: str = "value", same: Sequence[str] = ("version", "unit")) -> DataFrame:
    """(key, status, delta): a delta only where both reports have the metric in the same version and unit."""
    o = old.select(key, F.col(value).alias("_o"), *[F.col(c).alias(f"_o_{c}") for c in same], F.lit(1).alias("_in_o"))
    n = new.select(key, F.col(value).alias("_n"), *[F.col(c).alias(f"_n_{c}") for c in same], F.lit(1).alias("_in_n"))
    both = o.join(n, key, "full_outer")
    alike = F.lit(True)
    for c in same:
        alike = alike & F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}"))
    status = F.when(F.col("_in_o").isNull(), "added").when(F.col("_in_n").isNull(), "removed").when(~alike, "not_comparable").when(F.col("_o").eqNullSafe(F.col("_n")), "same").otherwise("changed")
    return both.select(key, status.alias("status"), F.when(alike, F.col("_n") - F.col("_o")).alias("delta"))


def reliability(df: DataFrame, penalties: dict[str, tuple[Column, int]]) -> DataFrame:
    """df with reliability_score (100 less the penalties that apply, 0 at least), reliability and reliability_reasons."""
    score = F.lit(100)
    for when, points in penalties.values():
        score = score - F.when(F.coalesce(when, F.lit(False)), points).otherwise(0)
    score = F.greatest(F.lit(0), score)
    reasons = F.filter(F.array(*[F.when(F.coalesce(w, F.lit(False)), F.lit(n)) for n, (w, _) in penalties.items()]), lambda x: x.isNotNull())
    return df.withColumns({"reliability_score": score, "reliability": F.when(score >= 75, "High").when(score >= 55, "Medium").otherwise("Low"), "reliability_reasons": reasons})
