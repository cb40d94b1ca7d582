"""Upkeep of a derived view by what changed: which rows read a changed contest, directly or through others, and only these anew.

The view has a row for each side of a contest: the side's own history before the day, its opponent's, and the mean of what earlier opponents had
won when they met. A changed row is read by later rows of its entity, these by their opponents' rows in the same contests, and these by later
rows of the opponents. Every step is a join on the entities touched so far, each with its first touched day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import Steps
from .history import Spec, before, if_dated, snapshots

KEYS = ["contest_id", "entity_id"]
OWN = ["contests", "wins", "attempts_sum"]
OTHERS = [f"opponent_{c}" for c in OWN]
ROW = [*KEYS, "opponent_id", "event_day"]
VIEW = [*ROW, *OWN, *OTHERS, "opponents_wins"]


def _parts() -> dict[str, Column]:
    """What each row adds to the own columns of later ones."""
    return {"contests": F.lit(1), "wins": F.when(F.col("won") == 1, 1).otherwise(0), "attempts_sum": F.coalesce("attempts", F.lit(0.0))}


def _own(obs: DataFrame) -> DataFrame:
    return snapshots(obs, [Spec(c, "sum", v) for c, v in _parts().items()]).select(*ROW, *OWN)


def _of_opponents(rows: DataFrame) -> DataFrame:
    """rows with the opponents' own columns, from their rows in the same contests. One shuffle by contest; rows without a contest meet none."""
    sides = F.collect_list(F.struct("entity_id", *OWN)).over(Window.partitionBy("contest_id"))
    met = F.get(F.filter(F.col("_sides"), lambda x: x["entity_id"] == F.col("opponent_id")), F.lit(0))
    found = rows.withColumn("_sides", sides).withColumn("_other", F.when(F.col("contest_id").isNotNull(), met))
    return found.withColumns({f"opponent_{c}": F.col("_other")[c] for c in OWN}).drop("_sides", "_other")


def contest_view(obs: DataFrame) -> DataFrame:
    """The whole view of observations with unique keys. Undated rows see nothing and are seen by none. Three shuffles: by entity, by contest, by entity."""
    mean = if_dated(F.avg("opponent_wins").over(before("entity_id", "event_day")), "event_day")
    return _of_opponents(_own(obs)).withColumn("opponents_wins", mean).select(*VIEW)


def _touched(*rows: DataFrame) -> DataFrame:
    """(entity_id, from_day): entities with the first day on which a row of theirs is among the given ones; undated rows touch nothing."""
    out = rows[0].select("entity_id", "event_day")
    for r in rows[1:]:
        out = out.unionByName(r.select("entity_id", "event_day"))
    return out.filter("event_day is not null").groupBy("entity_id").agg(F.min("event_day").alias("from_day"))


def changed_rows(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """(keys, event_day) of rows that were added, removed or corrected, with each day that they have in either table."""
    side = lambda df, p: df.select(*KEYS, F.struct("event_day", *[c for c in columns if c not in ROW[:2] and c != "event_day"]).alias(p))
    both = side(old, "old").join(side(new, "new"), KEYS, "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    return both.select(*KEYS, F.explode(F.array_distinct(F.array("old.event_day", "new.event_day"))).alias("event_day"))


def _earlier(rows: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """One row for each entity of rows (with its from_day): the totals of all before that day, dated the day before it. It stands for them in windows."""
    old = rows.filter("event_day < from_day").groupBy("entity_id", "from_day").agg(*[F.sum(v).alias(k) for k, v in totals.items()])
    return old.withColumn("event_day", F.date_sub("from_day", 1)).withColumn("_earlier", F.lit(True))


def _own_since(new: DataFrame, first: DataFrame) -> DataFrame:
    """The own columns of the entities' rows from their first touched day on."""
    told = new.join(first, "entity_id")
    parts = {f"_{c}": v for c, v in _parts().items()}
    late = told.filter("event_day >= from_day").select(*ROW, "from_day", F.lit(False).alias("_earlier"), *[v.alias(k) for k, v in parts.items()])
    rows = late.unionByName(_earlier(told, parts), allowMissingColumns=True)
    return snapshots(rows, [Spec(c, "sum", F.col(f"_{c}")) for c in OWN]).filter("not _earlier").select(*ROW, *OWN, "from_day")


def maintained(view: DataFrame, old: DataFrame, new: DataFrame, steps: Steps | None = None) -> DataFrame:
    """contest_view(new), from view = contest_view(old), with `recomputed`: which rows were computed anew. All others are taken from the view as they are.

    A changed row touches its entity from its day on, so rows of earlier days are taken as they are, or added up to one row for each entity, before anything
    is shuffled by row. What is shuffled whole is the comparison of old and new and, where the contests touched are many, the view's rows by contest.
    """
    steps = steps or Steps(new.sparkSession, "upkeep")
    columns = [*ROW, "won", "attempts"]
    new = new.select(*columns)
    changed = steps.write(changed_rows(old.select(*columns), new, columns))
    keys = changed.select(*KEYS).distinct()

    # the entities' own columns, after the changed rows and in them
    first = steps.write(_touched(changed))
    own = _own_since(new, first).join(keys.withColumn("_changed", F.lit(True)), KEYS, "left").filter((F.col("event_day") > F.col("from_day")) | F.col("_changed")).select(*ROW, *OWN)
    undated = new.filter("event_day is null").join(keys, KEYS, "left_semi").select(*ROW, *[F.lit(None).cast(t).alias(c) for c, t in own.dtypes if c in OWN])
    own = steps.write(own.unionByName(undated).dropDuplicates(KEYS))

    # opponents' columns: of rows whose own columns are new, of the rows that stand against them, and of all that is left of the changed contests
    touched = own.select("contest_id", F.lit(False).alias("_all")).unionByName(changed.select("contest_id", F.lit(True).alias("_all"))).groupBy("contest_id").agg(F.max("_all").alias("_all"))
    still = view.select(*ROW, *OWN).join(touched, "contest_id").join(keys.unionByName(own.select(*KEYS)), KEYS, "left_anti").withColumn("_own", F.lit(False))
    here = still.unionByName(own.join(touched, "contest_id").withColumn("_own", F.lit(True)))
    anew = F.collect_list(F.when(F.col("_own"), F.col("entity_id"))).over(Window.partitionBy("contest_id"))
    met = _of_opponents(here.withColumn("_anew", anew)).filter(F.col("_own") | F.col("_all") | F.array_contains("_anew", F.col("opponent_id")))
    met = steps.write(met.select(*ROW, *OWN, *OTHERS))

    # the means of those whose earlier opponents' columns are new
    second = steps.write(_touched(met, changed))
    gone = keys.unionByName(met.select(*KEYS))
    seen = view.join(second, "entity_id")
    mean = {"_sum": F.col("opponent_wins"), "_n": F.when(F.col("opponent_wins").isNotNull(), 1).otherwise(0)}
    late = seen.filter("event_day >= from_day").join(gone, KEYS, "left_anti").withColumn("_met", F.lit(False))
    late = late.unionByName(met.join(second, "entity_id", "left").withColumn("_met", F.lit(True)), allowMissingColumns=True).select(*ROW, *OWN, *OTHERS, "from_day", "_met", F.lit(False).alias("_earlier"), *[v.alias(k) for k, v in mean.items()])
    before_day = before("entity_id", "event_day")
    means = late.unionByName(_earlier(seen, mean), allowMissingColumns=True).withColumn("opponents_wins", if_dated(F.try_divide(F.sum("_sum").over(before_day), F.sum("_n").over(before_day)), "event_day"))
    anew = steps.write(means.filter(~F.col("_earlier") & ((F.col("event_day") > F.col("from_day")) | F.col("_met"))).select(*VIEW))

    split = view.join(second, "entity_id", "left")
    rest = split.filter("event_day is null or event_day = from_day").join(gone, KEYS, "left_anti")
    kept = split.filter("event_day is not null and (from_day is null or event_day < from_day)").unionByName(rest).select(*VIEW, F.lit(False).alias("recomputed"))
    return kept.unionByName(anew.withColumn("recomputed", F.lit(True)))
