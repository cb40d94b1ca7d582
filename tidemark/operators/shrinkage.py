"""Empirical-Bayes shrinkage of rates towards global and group priors that were known before the day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .history import before, if_dated


def valid_pair(num: Column, den: Column) -> Column:
    """An observation counts only if 0 <= num <= den and den > 0."""
    return num.isNotNull() & den.isNotNull() & ~F.isnan(num) & ~F.isnan(den) & (den > 0) & (num >= 0) & (num <= den)


def day_totals(obs: DataFrame, num: str, den: str, day: str = "event_day", group: str = "grp") -> tuple[DataFrame, DataFrame]:
    """Sums of all earlier days: (day, g_num, g_den) and (day, group, d_num, d_den).

    Rows are summed by day and by day and group in one pass, with grouping sets; the running windows see one row for each day (and group), not each
    observation. Undated rows are in no sum.
    """
    ok = valid_pair(F.col(num), F.col(den))
    sums = [F.sum(F.when(ok, F.col(c)).otherwise(0.0)).alias(a) for a, c in (("n", num), ("d", den))]
    daily = obs.filter(F.col(day).isNotNull()).groupingSets([[F.col(day)], [F.col(day), F.col(group)]], F.col(day), F.col(group)).agg(F.grouping(group).alias("_all"), *sums)
    so_far = Window.partitionBy("_all", group).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    running = daily.select(day, group, "_all", *[F.coalesce(F.sum(c).over(so_far), F.lit(0.0)).alias(c) for c in "nd"])
    overall = running.filter("_all = 1").select(day, F.col("n").alias("g_num"), F.col("d").alias("g_den"))
    grouped = running.filter("_all = 0").select(day, group, F.col("n").alias("d_num"), F.col("d").alias("d_den"))
    return overall, grouped


def prior_ladder(obs: DataFrame, num: str, den: str, least: float, neutral: float, day: str = "event_day", group: str = "grp") -> DataFrame:
    """obs with prior, prior_source (group, global or neutral) and prior_den: the group's rate if it has support, else the global, else neutral."""
    overall, grouped = day_totals(obs, num, den, day, group)
    out = obs.join(grouped, [day, group], "left").join(overall, day, "left")
    use_group, use_global = F.col("d_den") >= least, F.col("g_den") > 0
    return out.withColumns(
        {
            "prior": F.when(use_group, F.col("d_num") / F.col("d_den")).when(use_global, F.col("g_num") / F.col("g_den")).otherwise(F.lit(neutral)),
            "prior_source": F.when(use_group, "group").when(use_global, "global").otherwise("neutral"),
            "prior_den": F.when(use_group, F.col("d_den")).when(use_global, F.col("g_den")).otherwise(F.lit(0.0)),
        }
    ).drop("d_num", "d_den", "g_num", "g_den")


def prior_sums(obs: DataFrame, num: str, den: str, key: str = "entity_id", day: str = "event_day") -> DataFrame:
    """obs with own_num and own_den: the entity's valid sums of earlier days; null for undated rows."""
    ok, w = valid_pair(F.col(num), F.col(den)), before(key, day)
    total = lambda c: if_dated(F.coalesce(F.sum(F.when(ok, F.col(c))).over(w), F.lit(0.0)), day)
    return obs.withColumns({"own_num": total(num), "own_den": total(den)})


def smoothed(num: Column, den: Column, prior: Column, strength: Column) -> Column:
    """(num + strength * prior) / (den + strength), within [0, 1]; null unless den >= 0, strength > 0 and num and prior are known."""
    value = (num + strength * prior) / (den + strength)
    return F.when((den >= 0) & (strength > 0) & value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def supported_source(den: Column, source: Column) -> Column:
    """group or global where there is support of one's own; else prior_only."""
    name = F.lower(F.trim(F.coalesce(source, F.lit(""))))
    return F.when((F.coalesce(den, F.lit(0.0)) > 0) & name.isin("group", "global"), name).otherwise("prior_only")


def support_scaled(den: Column, strength: float) -> Column:
    """Strength that falls with support, between a third of it (10 at least, 20 at most) and itself."""
    low = min(max(10.0, strength / 3), 20.0)
    support = F.greatest(F.lit(0.0), F.coalesce(den, F.lit(0.0)))
    return F.greatest(F.lit(min(low, strength)), F.least(F.lit(float(strength)), F.lit(float(strength) ** 2) / (support + strength)))


def mom_strength(sum_x: Column, sum_n: Column, sum_n2: Column, sum_x2n: Column, count: Column, fallback: float) -> Column:
    """Beta-binomial prior strength by the method of moments, from sums over entities; within [5, 500].

    Fewer than 30 entities, no attempts, a pooled rate of 0 or 1, or a denominator that isn't above 0 give the fallback.
    """
    p = F.when(sum_n > 0, sum_x / sum_n)
    spread = sum_x2n - sum_n * p * p
    scale = F.when((p > 0) & (p < 1), p * (1 - p))
    rest = sum_n - F.when(sum_n > 0, sum_n2 / sum_n) - (count - 1)
    rho = F.when(rest > 0, (spread / scale - (count - 1)) / rest)
    strength = F.when(rho <= 0, 500.0).when(rho >= 1, 5.0).otherwise(F.greatest(F.lit(5.0), F.least(F.lit(500.0), (1 - rho) / rho)))
    return F.when((count < 30) | rho.isNull() | F.isnan(rho), F.lit(float(fallback))).otherwise(strength)


def population_moments(obs: DataFrame, num: str, den: str, key: str = "entity_id", day: str = "event_day") -> DataFrame:
    """(day, sum_x, sum_n, sum_n2, sum_x2n, entities): moments over entities' totals before each day.

    An entity's new totals replace its old ones. So each day adds the differences to the totals before, summed per day, and
    a running sum over days gives the moments: no join of days with entities. Undated rows are in none of them.
    """
    dated = obs.filter(F.col(day).isNotNull())
    daily = dated.filter(valid_pair(F.col(num), F.col(den))).groupBy(key, day).agg(F.sum(num).alias("x"), F.sum(den).alias("n"))
    w = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    total = daily.select(key, day, F.sum("x").over(w).alias("x"), F.sum("n").over(w).alias("n"))
    parts = {"sum_x": F.col("x"), "sum_n": F.col("n"), "sum_n2": F.col("n") * F.col("n"), "sum_x2n": F.col("x") * F.col("x") / F.col("n"), "entities": F.lit(1.0)}
    last = Window.partitionBy(key).orderBy(day)
    change = total.select(day, *[(v - F.coalesce(F.lag(v).over(last), F.lit(0.0))).alias(k) for k, v in parts.items()])
    per_day = change.groupBy(day).agg(*[F.sum(k).alias(k) for k in parts])
    days = dated.select(day).distinct().join(per_day, day, "left")
    so_far = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are days
    return days.select(day, *[F.coalesce(F.sum(k).over(so_far), F.lit(0.0)).alias(k) for k in parts])


def smoothing_family(obs: DataFrame, num: str, den: str, strength: float, least: float, neutral: float, fallback: float = 50.0) -> DataFrame:
    """Raw rate, support, prior and its source, and three shrunk rates: fixed, support-scaled and by the population's moments."""
    out = prior_ladder(prior_sums(obs, num, den), num, den, least, neutral)
    moments = population_moments(obs, num, den)
    out = out.join(moments, "event_day", "left")
    k = mom_strength(F.col("sum_x"), F.col("sum_n"), F.col("sum_n2"), F.col("sum_x2n"), F.col("entities"), fallback)
    n, d, p = F.col("own_num"), F.col("own_den"), F.col("prior")
    out = out.withColumns(
        {
            "raw_rate": F.when(d > 0, n / d),
            "fixed_rate": smoothed(n, d, p, F.lit(float(strength))),
            "scaled_rate": smoothed(n, d, p, support_scaled(d, strength)),
            "mom_strength": k,
            "mom_rate": smoothed(n, d, p, k),
            "low_support": F.when(d < least, 1).otherwise(0),
            "source_label": supported_source(d, F.col("prior_source")),
        }
    )
    return out.drop("sum_x", "sum_n", "sum_n2", "sum_x2n", "entities")
