"""Ingest: bounded selection of days, row audits with reason codes, quarantine, guards against the future, correction previews."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .capture import first_changed_day, keyed_diff, rebuild_suffix, upsert
from .contracts import ContractError, pair_integrity, require


def training_cutoff(contest_day: dt.date, today: dt.date, explicit: dt.date | None = None) -> dt.date:
    """Last day that may be learned from: the explicit one, else today for a contest to come, else the day before the contest."""
    if explicit is not None:
        if explicit >= contest_day:
            raise ContractError("the cutoff must lie before the contest")
        return explicit
    return today if contest_day > today else contest_day - dt.timedelta(days=1)


def learnable(df: DataFrame, cutoff: Column, label: str = "label", day: str = "event_day", contest: str = "contest_id", least_rows: int = 200, least_contests: int = 100, allow_later: bool = False) -> DataFrame:
    """Labelled rows up to the cutoff, after the assertions that there are enough of them, of both classes, and none later."""
    old = df.filter((F.col(day) <= cutoff) & F.col(label).isNotNull())
    facts = df.agg(
        F.count_if((F.col(day) <= cutoff) & F.col(label).isNotNull()).alias("n"),
        F.count_distinct(F.when(F.col(day) <= cutoff, F.col(contest))).alias("contests"),
        F.count_distinct(F.when(F.col(day) <= cutoff, F.col(label))).alias("classes"),
        F.count_if(F.col(day) > cutoff).alias("later"),
    ).first()
    if facts.later and not allow_later:
        raise ContractError(f"{facts.later} rows lie after the cutoff")
    if facts.n < least_rows or facts.contests < least_contests or facts.classes < 2:
        raise ContractError(f"too little to learn from: {facts.asDict()}")
    return old


def select_days(events: DataFrame, cutoff: Column, today: Column, most: int | None = None, day: str = "event_day", key: str = "event_id") -> DataFrame:
    """Events within [cutoff, today], the first `most` of them. The range comes first, so that later ones don't use up the limit."""
    found = events.filter(F.col(day).between(cutoff, today))
    return found.orderBy(day, key).limit(most) if most is not None else found


def audit(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with `reasons`: the codes of the rules a row breaks; a rule is a condition that is true where the row is bad."""
    return df.withColumn("reasons", F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in rules.items()]), lambda x: x.isNotNull()))


def quarantine(audited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without reasons, and the others."""
    return audited.filter(F.size("reasons") == 0).drop("reasons"), audited.filter(F.size("reasons") > 0)


def audit_summary(audited: DataFrame, contest: str = "contest_id") -> DataFrame:
    """(code, rows, contests) of each reason."""
    return audited.select(contest, F.explode("reasons").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(contest).alias("contests"))


def observation_rules(today: Column) -> dict[str, Column]:
    """Rules for observations that are to be added."""
    c = F.col
    return {
        "no_contest_id": c("contest_id").isNull(),
        "no_entity": c("entity_id").isNull(),
        "no_opponent": c("opponent_id").isNull(),
        "same_sides": c("entity_id") == c("opponent_id"),
        "no_day": c("event_day").isNull(),
        "future_day": c("event_day") > today,
        "unknown_result": ~F.coalesce(c("result"), F.lit("")).isin("win", "loss", "draw", "no_contest"),
        "label_differs": ~c("won").eqNullSafe(F.when(c("result") == "win", 1).when(c("result") == "loss", 0)),
        "more_successes": c("successes") > c("attempts"),
        "negative": F.least("attempts", "successes", "seconds") < 0,
    }


def new_entities(rows: DataFrame, profiles: DataFrame, key: str = "entity_id") -> DataFrame:
    """Ids that rows have and profiles lack, as stub profiles with the status missing."""
    stubs = rows.select(key).filter(F.col(key).isNotNull()).distinct().join(profiles.select(key), key, "left_anti").withColumn("status", F.lit("missing"))
    return profiles.withColumn("status", F.lit("known")).unionByName(stubs, allowMissingColumns=True)


def preview_correction(current: DataFrame, captured: DataFrame, columns: Sequence[str], contest: str = "contest_id", entity: str = "entity_id") -> DataFrame:
    """What a recapture of some contests would change, after the assertions that it is consistent in itself and lacks none of their observations."""
    require(pair_integrity(captured, contest), "captured contests don't fit together")
    same = current.join(captured.select(contest).distinct(), contest, "left_semi")
    lost = same.select(contest, entity).join(captured.select(contest, entity), [contest, entity], "left_anti")
    require(lost, "captured contests lack known observations")
    return keyed_diff(same, captured, [contest, entity], columns)


def apply_correction(current: DataFrame, captured: DataFrame, columns: Sequence[str], derived: DataFrame, rebuild, contest: str = "contest_id", entity: str = "entity_id", day: str = "event_day") -> tuple[DataFrame, DataFrame]:
    """(observations, derived rows) after a correction: the contests are replaced, and derived rows from the first changed day on are computed anew.

    rebuild maps observations to derived rows. If nothing changes, both tables come back as they are.
    """
    diff = preview_correction(current, captured, columns, contest, entity)
    first = first_changed_day(diff, current, captured, [contest, entity], day).first()["day"]
    if first is None:
        return current, derived
    fresh = upsert(current, captured, [contest])
    return fresh, rebuild_suffix(derived, rebuild(fresh), F.lit(first).cast("date"), day)
