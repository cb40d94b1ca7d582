"""Dataset contracts: keys, ranges, leakage, missing values, profiles. Each gives a DataFrame; `require` makes one an assertion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import blankish


class ContractError(ValueError):
    """A table breaks its contract."""


def require(violations: DataFrame, what: str) -> None:
    """Raises if there is any row; reads one."""
    if row := violations.head():
        raise ContractError(f"{what}: {row.asDict()}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n) of keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def checked_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join after the assertion that right has each key once."""
    require(duplicate_keys(right.filter(F.coalesce(*[F.col(k).isNotNull() for k in keys])), keys), f"{', '.join(keys)} must be unique")
    return left.join(right, list(keys), "left")


def key_gaps(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that one table has and the other lacks."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left_only")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right_only")))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row for each column: rows, missing, zeros, distinct values, least, greatest, mean and a class of usability.

    One pass over the table for everything but the distinct values.
    """
    names = list(columns or df.columns)
    numeric = {n for n, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal")}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in names:
        x = F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")
        gone = F.col(c).isNull() if c in numeric else blankish(F.col(c).cast("string"))
        aggs += [F.count_if(gone).alias(f"{c}|missing"), F.count_if(x == 0).alias(f"{c}|zeros"), F.count_distinct(c).alias(f"{c}|distinct"), F.min(x).alias(f"{c}|low"), F.max(x).alias(f"{c}|high"), F.avg(x).alias(f"{c}|mean")]
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("rows"), *[F.col(f"`{c}|{m}`").alias(m) for m in ("missing", "zeros", "distinct", "low", "high", "mean")]) for c in names]))
    out = one.select(rows.alias("r")).select("r.*")
    share = F.col("missing") / F.greatest(F.col("rows"), F.lit(1))
    usable = F.when(F.col("rows") == F.col("missing"), "empty").when(F.col("distinct") <= 1, "constant").when(share > 0.5, "sparse").when(share > 0.05, "partial").otherwise("good")
    return out.withColumn("missing_share", share).withColumn("usability", usable)


def date_profile(df: DataFrame, column: str, today: Column | None = None) -> DataFrame:
    """valid, invalid and future counts, first and last day of a text or date column."""
    text = F.col(column).cast("string")
    day = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")
    gone = blankish(text)
    late = day > (today if today is not None else F.current_date())
    return df.agg(
        F.count_if(day.isNotNull()).alias("valid"),
        F.count_if(day.isNull() & ~gone).alias("invalid"),
        F.count_if(F.coalesce(late, F.lit(False))).alias("future"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts by value; blank values are Unknown."""
    x = F.col(column).cast("string")
    return df.groupBy(F.when(blankish(x), "Unknown").otherwise(x).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def same_day_rating_leaks(ratings: DataFrame, key: str = "entity_id", day: str = "event_day", rating: str = "rating") -> DataFrame:
    """Days on which an entity has more than one rating from before."""
    return ratings.groupBy(key, day).agg(F.count_distinct(rating).alias("ratings")).filter("ratings > 1")


def history_leaks(df: DataFrame, day: str = "event_day", last: str = "last_day") -> DataFrame:
    """Rows whose history ends on or after their own day."""
    return df.filter(F.col(last) >= F.col(day))


def range_violations(df: DataFrame, rules: dict[str, tuple[float | None, float | None]], key: str) -> DataFrame:
    """(key, column, value) of values outside [low, high]; null passes."""
    checks = []
    for c, (low, high) in rules.items():
        x = F.col(c).cast("double")
        bad = F.lit(False)
        bad = bad | (x < low) if low is not None else bad
        bad = bad | (x > high) if high is not None else bad
        checks.append(F.when(F.coalesce(bad | F.isnan(x), F.lit(False)), F.struct(F.lit(c).alias("column"), x.alias("value"))))
    found = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return df.select(key, F.explode(found).alias("v")).select(key, "v.column", "v.value")


def pair_integrity(obs: DataFrame, contest: str = "contest_id") -> DataFrame:
    """Contests whose observations don't fit together, with the first reason found.

    Least and greatest values tell whether two rows differ, so nothing is expanded to count distinct values; with a null beside it a value is alone.
    """
    ends = {c: (F.min(c).alias(f"_least_{c}"), F.max(c).alias(f"_most_{c}")) for c in ("event_day", "entity_id", "result")}
    g = obs.groupBy(contest).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("result") == "win").alias("wins"), F.count_if(F.col("result") == "loss").alias("losses"), *[x for pair in ends.values() for x in pair])
    differ = lambda c: F.coalesce(F.col(f"_least_{c}") < F.col(f"_most_{c}"), F.lit(False))
    reason = F.when(F.col("n") != 2, "rows").when(differ("event_day"), "days").when(~differ("entity_id"), "entities").when((F.col("wins") != F.col("losses")) | (F.col("wins") > 1), "outcome").when((F.col("wins") == 0) & differ("result"), "outcome")
    return g.select(contest, "n", reason.alias("reason")).filter("reason is not null")


def leaking_features(columns: Sequence[str], tokens: Sequence[str] = ("result", "won", "winner", "label", "method")) -> list[str]:
    """Feature names that hold the outcome of the contest itself."""
    return [c for c in columns if any(t in c.lower().split("_") for t in tokens)]


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key in a stated order; ties are broken by all other columns."""
    rest = [c for c in df.columns if c not in {*keys, *order}]
    w = Window.partitionBy(*keys).orderBy(*order, *rest)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
