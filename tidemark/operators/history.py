"""Point-in-time history: what was known of an entity strictly before a day.

A Spec declares a feature once. `snapshots` compiles a list of specs to window expressions over one shuffle and sort per
entity; `as_of` compiles the same list to a filtered aggregation for one cutoff. Rows of the same day never see one another,
whatever their order, unless the row-shift policy is asked for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clean_text


@dataclass(frozen=True)
class Spec:
    """name, aggregate (sum, count, max, min, avg) of a column expression over earlier rows; months limits how far back."""

    name: str
    agg: str
    value: Column
    months: int | None = None

    def over(self, frame) -> Column:
        out = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "avg": F.avg}[self.agg](self.value)
        out = out.over(frame) if frame is not None else out
        return F.coalesce(out, F.lit(0)) if self.agg in ("sum", "count") else out


def day_number(day: str) -> Column:
    return F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))


def before(key: str | Sequence[str], day: str) -> Window:
    """All rows of earlier days. Undated rows sort last, so dated ones never see them."""
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(day_number(day).asc_nulls_last()).rangeBetween(Window.unboundedPreceding, -1)


def if_dated(value: Column, day: str) -> Column:
    """value, or null where the row has no day."""
    return F.when(F.col(day).isNotNull(), value)


def snapshots(obs: DataFrame, specs: Sequence[Spec], key: str = "entity_id", day: str = "event_day") -> DataFrame:
    """obs with one column for each spec. Undated rows see nothing and are seen by none: they get null."""
    plain = [s for s in specs if s.months is None]
    out = obs.withColumns({s.name: if_dated(s.over(before(key, day)), day) for s in plain})
    for months in sorted({s.months for s in specs if s.months}):
        out = _calendar(out, [s for s in specs if s.months == months], key, day, months)
    return out


def snapshots_by_day(obs: DataFrame, specs: Sequence[Spec], key: str = "entity_id", day: str = "event_day") -> DataFrame:
    """The rows of `snapshots` where one entity may have a large share of all rows: no task holds an entity's rows.

    Rows are added up by entity and day before they are shuffled. The windows run over one row for each entity and day, so the largest
    has as many rows as there are days. What they give meets the rows in a join by entity and day, where adaptive execution splits a day that is
    hot itself. obs is read twice: write it first if it is dear. Sums of doubles are added in another order than in `snapshots`, so their last digits may differ.
    Undated rows get null. Rows with a null key are one entity, as there. An empty table gives an empty result; further columns stay as they are, but for those with the name of a spec, which it replaces.
    """
    if any(s.months and s.agg not in ("sum", "count") for s in specs):
        raise ValueError("calendar windows take sums and counts")
    if not specs:
        return obs
    kinds = dict(obs.agg(*[s.over(None).alias(s.name) for s in specs]).dtypes)
    halves = {s.name: ("sum", "count") if s.agg == "avg" else (s.agg,) for s in specs}
    part = lambda s, half: {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[half](s.value).alias(f"{half}_{s.name}")
    dated = obs.filter(F.col(f"`{day}`").isNotNull())
    days = dated.groupBy(F.col(f"`{key}`").alias("_key"), F.col(f"`{day}`").alias("_day")).agg(*[part(s, half) for s in specs for half in halves[s.name]])
    earlier = before("_key", "_day")

    def seen(s: Spec) -> Column:
        if s.months:  # up to and with the day, less the day
            own = F.coalesce(F.col(f"`{s.agg}_{s.name}`"), F.lit(0))
            frame = f"(PARTITION BY _key ORDER BY _day RANGE BETWEEN INTERVAL '{s.months}' MONTH PRECEDING AND CURRENT ROW)"
            return F.coalesce(F.expr(f"sum(`{s.agg}_{s.name}`) OVER {frame}"), F.lit(0)) - own
        if s.agg in ("max", "min"):
            return {"max": F.max, "min": F.min}[s.agg](f"`{s.agg}_{s.name}`").over(earlier)
        total = lambda half: F.sum(f"`{half}_{s.name}`").over(earlier)
        return F.try_divide(total("sum"), total("count")) if s.agg == "avg" else F.coalesce(total(s.agg), F.lit(0))

    state = days.select("_key", "_day", *[seen(s).cast(kinds[s.name]).alias(s.name) for s in specs])
    met = obs.alias("o").join(state.alias("s"), F.col(f"o.`{key}`").eqNullSafe(F.col("s._key")) & (F.col(f"o.`{day}`") == F.col("s._day")), "left")
    names = {s.name for s in specs}
    return met.select(*[F.col(f"o.`{c}`") for c in obs.columns if c not in names], *[F.col(f"s.`{s.name}`") for s in specs])


def _calendar(obs: DataFrame, specs: Sequence[Spec], key: str, day: str, months: int) -> DataFrame:
    """Trailing calendar months, the day itself left out: the frame up to and with the day, less the day's own rows. Both share the entity's shuffle."""
    if any(s.agg not in ("sum", "count") for s in specs):
        raise ValueError("calendar windows take sums and counts")
    held = obs.withColumns({f"_v_{s.name}": s.value for s in specs})
    frame = f"(PARTITION BY `{key}` ORDER BY `{day}` ASC NULLS LAST RANGE BETWEEN INTERVAL '{months}' MONTH PRECEDING AND CURRENT ROW)"
    part = lambda s, over: F.coalesce(F.expr(f"{s.agg}(`_v_{s.name}`) OVER {over}"), F.lit(0))
    one = lambda s: F.when(F.col(day).isNotNull(), part(s, frame) - part(s, f"(PARTITION BY `{key}`, `{day}`)"))
    return held.withColumns({s.name: one(s) for s in specs}).drop(*[f"_v_{s.name}" for s in specs])


def as_of(obs: DataFrame, specs: Sequence[Spec], cutoff: Column, key: str = "entity_id", day: str = "event_day") -> DataFrame:
    """One row for each entity with rows before the cutoff. Equal to `snapshots` at a row of that day."""
    old = obs.filter(F.col(day) < cutoff)
    aggs = []
    for s in specs:
        value = F.when(F.col(day) >= F.add_months(cutoff, -s.months), s.value) if s.months else s.value
        aggs.append(Spec(s.name, s.agg, value).over(None).alias(s.name))
    return old.groupBy(key).agg(*aggs)


def career_specs() -> list[Spec]:
    """Cumulative counts that the rates are made of."""
    won = F.col("won")
    return [
        Spec("contests", "count", F.lit(1)),
        Spec("wins", "sum", F.when(won == 1, 1).otherwise(0)),
        Spec("losses", "sum", F.when(won == 0, 1).otherwise(0)),
        Spec("draws", "sum", F.when(F.col("result") == "draw", 1).otherwise(0)),
        Spec("attempts_sum", "sum", F.coalesce("attempts", F.lit(0.0))),
        Spec("successes_sum", "sum", F.coalesce("successes", F.lit(0.0))),
        Spec("seconds_sum", "sum", F.coalesce("seconds", F.lit(0.0))),
        Spec("last_day", "max", F.col("event_day")),
        Spec("last_win_day", "max", F.when(won == 1, F.col("event_day"))),
        Spec("last_loss_day", "max", F.when(won == 0, F.col("event_day"))),
    ]


def career_rates(df: DataFrame, draws_as_losses: bool = False) -> DataFrame:
    """Rates from the cumulative counts of `career_specs`. With draws_as_losses every contest that isn't won counts as lost."""
    losses = F.col("contests") - F.col("wins") if draws_as_losses else F.col("losses")
    ratio = lambda a, b: F.when(b > 0, a / b)
    return df.withColumns(
        {
            "win_rate": ratio(F.col("wins"), F.col("wins") + losses),
            "accuracy": ratio(F.col("successes_sum"), F.col("attempts_sum")),
            "per_minute": ratio(F.col("successes_sum"), F.col("seconds_sum") / 60),
            "per_15": ratio(F.col("attempts_sum"), F.col("seconds_sum") / 60) * 15,
            "days_since_last": F.datediff("event_day", "last_day").cast("bigint"),
            "days_since_win": F.datediff("event_day", "last_win_day").cast("bigint"),
            "days_since_loss": F.datediff("event_day", "last_loss_day").cast("bigint"),
        }
    )


def recent(obs: DataFrame, n: int, columns: Sequence[str], name: str, key: str = "entity_id", day: str = "event_day", tie: str = "contest_id") -> DataFrame:
    """obs with `name`: the last n rows before the day as an array of structs, newest last.

    The frame is by day and n by rows, and the rows of one day are unordered for the frame. So each day first keeps its own last n
    rows; the last n before a day are among those of the last n days that have any. Nothing longer than n * n is ever built.
    """
    row = F.struct(F.col(day).alias("_d"), F.col(tie).alias("_t"), *[F.col(c) for c in columns])
    ranked = obs.filter(F.col(day).isNotNull()).withColumn("_rn", F.row_number().over(Window.partitionBy(key, day).orderBy(F.col(tie).desc()))).filter(F.col("_rn") <= n)
    days = ranked.groupBy(key, day).agg(F.collect_list(row).alias("_rows"))
    last_days = F.flatten(F.collect_list("_rows").over(Window.partitionBy(key).orderBy(day).rowsBetween(-n, -1)))
    last = days.select(key, day, F.slice(F.reverse(F.array_sort(last_days)), 1, n).alias("_last")).select(key, day, F.reverse("_last").alias(name))
    return obs.join(last, [key, day], "left").withColumn(name, F.coalesce(name, F.array().cast(dict(last.dtypes)[name])))


def pooled(rows: Column, num: str, den: str) -> Column:
    """Sum of num over sum of den of an array of structs; null if there is nothing to divide by."""
    add = lambda field: F.aggregate(rows, F.lit(0.0), lambda a, r: a + F.coalesce(r[field].cast("double"), F.lit(0.0)))
    d = add(den)
    return F.when(d > 0, add(num) / d)


def last_before(value: Column, when: Column, key: str, day: str, tie: str) -> Column:
    """value of the last row of an earlier day where `when` is true; days first, then the tie-breaker, decide which is last."""
    return F.max_by(value, F.when(when & F.col(day).isNotNull(), F.struct(day, tie))).over(before(key, day))


def streaks(obs: DataFrame, key: str = "entity_id", day: str = "event_day", tie: str = "contest_id") -> DataFrame:
    """obs with win_streak and loss_streak before the day. Draws end both; contests without a result leave both as they are.

    Runs are islands between resets; each row reads the run that stood at the end of the last earlier day. All windows
    share one shuffle by entity. Undated rows get null.
    """
    up_to = Window.partitionBy(key).orderBy(F.col(day).asc_nulls_last(), tie).rowsBetween(Window.unboundedPreceding, 0)
    counts = F.col("result") != "no_contest"
    out = obs
    for name, hit in (("win", 1), ("loss", 0)):
        same = F.coalesce(F.col("won") == hit, F.lit(False))
        out = out.withColumn(f"_g_{name}", F.sum(F.when(counts & ~same, 1).otherwise(0)).over(up_to))
        run = Window.partitionBy(key, f"_g_{name}").orderBy(F.col(day).asc_nulls_last(), tie).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"_{name}", F.sum(F.when(counts & same, 1).otherwise(0)).over(run))
    known = last_before(F.struct("_win", "_loss"), counts, key, day, tie)
    out = out.withColumn("_last", known)
    named = {f"{n}_streak": if_dated(F.coalesce(F.col("_last")[f"_{n}"], F.lit(0)).cast("bigint"), day) for n in ("win", "loss")}
    return out.withColumns(named).drop("_g_win", "_win", "_g_loss", "_loss", "_last")


def row_shift(obs: DataFrame, columns: Sequence[str], key: str = "entity_id", day: str = "event_day", tie: str = "contest_id") -> DataFrame:
    """Cumulative sums shifted by one row: a second contest of the same day sees the first. Undated rows get null and are seen by none."""
    frame = Window.partitionBy(key).orderBy(F.col(day).asc_nulls_last(), tie).rowsBetween(Window.unboundedPreceding, -1)
    return obs.withColumns({f"prior_{c}": if_dated(F.coalesce(F.sum(c).over(frame), F.lit(0.0)), day) for c in columns})


def group_experience(obs: DataFrame, key: str = "entity_id", day: str = "event_day", tie: str = "contest_id") -> DataFrame:
    """Earlier contests in the row's group, and in how many groups the entity was seen before: earlier rows that were the first of their group.

    Undated rows get null.
    """
    first = F.row_number().over(Window.partitionBy(key, "grp").orderBy(F.col(day).asc_nulls_last(), tie)) == 1
    out = obs.withColumn("_first", first.cast("int"))
    out = out.withColumn("groups_seen", if_dated(F.coalesce(F.sum("_first").over(before(key, day)), F.lit(0)), day)).drop("_first")
    group = before([key, "grp"], day)
    wins = F.coalesce(F.sum(F.when(F.col("won") == 1, 1).otherwise(0)).over(group), F.lit(0))
    return out.withColumns({"in_group_contests": if_dated(F.count(F.lit(1)).over(group), day), "in_group_wins": if_dated(wins, day)})


def previous_group(obs: DataFrame, ranks: Mapping[str, float], key: str = "entity_id", day: str = "event_day", tie: str = "contest_id") -> DataFrame:
    """previous_grp, the group of the last earlier contest, and movement: how the row's group compares with it by rank.

    Groups that differ are changed_unknown_direction unless both have a rank. Undated rows get null in both columns.
    """
    now, old = clean_text(F.col("grp")), clean_text(F.col("previous_grp"))
    known = F.create_map(*[x for g, r in ranks.items() for x in (F.lit(g), F.lit(float(r)))]) if ranks else F.create_map().cast("map<string,double>")
    step = F.try_element_at(known, now) - F.try_element_at(known, old)
    movement = F.when(F.coalesce(old, F.lit("")) == "", "debut_or_unknown").when(now.eqNullSafe(old) | (step == 0), "same")
    movement = movement.when(step > 0, "up").when(step < 0, "down").otherwise("changed_unknown_direction")
    last = if_dated(last_before(F.col("grp"), F.lit(True), key, day, tie), day)
    return obs.withColumn("previous_grp", last).withColumn("movement", if_dated(movement, day))


def group_spells(obs: DataFrame, key: str = "entity_id", day: str = "event_day", tie: str = "contest_id") -> DataFrame:
    """(key, place, grp, since, until, contests): each entity's dated rows in order, cut where the group changes; until is the last day in the group."""
    order = Window.partitionBy(key).orderBy(day, tie)
    rows = obs.filter(F.col(day).isNotNull()).withColumn("_new", F.when(F.col("grp").eqNullSafe(F.lag("grp").over(order)) & (F.row_number().over(order) > 1), 0).otherwise(1))
    rows = rows.withColumn("place", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "place").agg(F.any_value("grp").alias("grp"), F.min(day).alias("since"), F.max(day).alias("until"), F.count(F.lit(1)).alias("contests"))


def as_of_lookup(left: DataFrame, right: DataFrame, key: str, left_day: str, right_day: str, columns: Sequence[str], strict: bool = True) -> DataFrame:
    """left with the columns of the last row of right before (or, unless strict, on) its day: union and one window, no range join.

    Rows of right on the same day are taken in the order of the columns' values; the largest wins.
    """
    value = F.struct(*columns)
    facts = right.groupBy(F.col(key).alias("_k"), F.col(right_day).alias("_d")).agg(F.max(value).alias("_v")).withColumn("_side", F.lit(1 if strict else 0))
    asked = left.select(F.col(key).alias("_k"), F.col(left_day).alias("_d")).distinct().withColumn("_v", F.lit(None).cast(dict(facts.dtypes)["_v"])).withColumn("_side", F.lit(0 if strict else 1))
    w = Window.partitionBy("_k").orderBy("_d", "_side").rowsBetween(Window.unboundedPreceding, 0)
    known = facts.unionByName(asked).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).filter(F.col("_side") == (0 if strict else 1)).select("_k", "_d", "_last")
    return left.join(known, (left[key] == known["_k"]) & (left[left_day] == known["_d"]), "left").select(*[left[c] for c in left.columns], *[F.col("_last")[c].alias(c) for c in columns])
