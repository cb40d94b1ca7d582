"""Mergeable sketches by day: distinct counts and quantiles of any window from the days' sketches, without going back to the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_sketches(df: DataFrame, day: str, key: str, value: str, by: Sequence[str] = (), log_k: int = 12, k: int = 400) -> DataFrame:
    """(day, by, n, keys, amounts): for each day (and group) its rows, an HLL sketch of the keys and a KLL sketch of the values.

    A sketch has a few kilobytes whatever the number of rows, and is built before the shuffle. Nulls are in neither; undated rows in no day.
    """
    amount = F.col(value).cast("double")
    return df.filter(F.col(day).isNotNull()).groupBy(day, *by).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(key, log_k).alias("keys"), F.kll_sketch_agg_double(F.when(~F.isnan(amount), amount), k).alias("amounts"))


def as_of_windows(daily: DataFrame, asked: DataFrame, days: int, day: str, by: Sequence[str] = (), at: Sequence[float] = (0.5,)) -> DataFrame:
    """(as_of, by, n, keys, quantile_<q>): for each asked day (column as_of) the rows, distinct keys and quantiles of the `days` days before it.

    Each day's sketch goes to the asked days whose window holds it, and sketches merge before the shuffle. A window without days has no row.
    """
    reached = daily.withColumn("as_of", F.explode(F.sequence(F.date_add(day, 1), F.date_add(day, days))))
    found = reached.join(asked.select("as_of").distinct(), "as_of", "left_semi")
    merged = found.groupBy("as_of", *by).agg(F.sum("n").alias("n"), F.hll_union_agg("keys").alias("k"), F.kll_merge_agg_double("amounts").alias("a"))
    some = F.kll_sketch_get_n_double("a") > 0
    quantiles = [F.when(some, F.kll_sketch_get_quantile_double("a", F.lit(float(q)))).alias(f"quantile_{q}".replace(".", "_")) for q in at]
    return merged.select("as_of", *by, "n", F.hll_sketch_estimate("k").alias("keys"), *quantiles)
