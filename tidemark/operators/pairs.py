"""Pair rows: both sides of a contest in one row, their mirror images, and audits of the symmetry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import reverse_pair_text
from .history import Spec, snapshots


def opponent_columns(obs: DataFrame, columns: Sequence[str], contest: str = "contest_id", entity: str = "entity_id") -> DataFrame:
    """obs with opponent_<column> from the other row of a contest of exactly two rows, else null. One shuffle by contest, no self-join."""
    by, both = Window.partitionBy(contest).orderBy(entity), Window.partitionBy(contest)
    out = obs.withColumn("_n", F.count(F.lit(1)).over(both))
    for c in columns:
        out = out.withColumn(f"opponent_{c}", F.when(F.col("_n") == 2, F.coalesce(F.lag(c).over(by), F.lead(c).over(by))))
    return out.drop("_n")


def pair_rows(snapshots: DataFrame, features: Sequence[str], contest: str = "contest_id", order: Sequence[str] = ("entity_id",), keep: Sequence[str] = ("event_day", "grp")) -> DataFrame:
    """One row for each contest of exactly two rows: side a is the one that sorts first. <f>_a, <f>_b and <f>_diff = a - b.

    label is 1 if a won, 0 if b did, else null. One aggregation by contest.
    """
    sides = F.array_sort(F.collect_list(F.struct(*order, "entity_id", "won", *features)) if "entity_id" not in order else F.collect_list(F.struct(*order, "won", *features)))
    rows = snapshots.groupBy(contest, *keep).agg(sides.alias("s"), F.count(F.lit(1)).alias("n")).filter("n = 2")
    a, b = F.col("s")[0], F.col("s")[1]
    out = [contest, *keep, a["entity_id"].alias("entity_a"), b["entity_id"].alias("entity_b"), a["won"].alias("label")]
    for f in features:
        out += [a[f].alias(f"{f}_a"), b[f].alias(f"{f}_b"), (a[f] - b[f]).alias(f"{f}_diff")]
    return rows.select(*out)


def swapped(pairs: DataFrame, texts: Sequence[str] = ()) -> DataFrame:
    """The same pairs seen from side b: sides exchanged, differences negated, label 1 - label, pair texts reversed."""
    out: list[Column] = []
    for c in pairs.columns:
        if c.endswith("_a") and f"{c[:-2]}_b" in pairs.columns:
            out.append(F.col(f"{c[:-2]}_b").alias(c))
        elif c.endswith("_b") and f"{c[:-2]}_a" in pairs.columns:
            out.append(F.col(f"{c[:-2]}_a").alias(c))
        elif c.endswith("_diff"):
            out.append((F.lit(0) - F.col(c)).alias(c))  # never -0.0
        elif c == "label":
            out.append((1 - F.col(c)).alias(c))
        elif c in texts:
            out.append(reverse_pair_text(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return pairs.select(*out)


def mirrored(pairs: DataFrame, texts: Sequence[str] = ()) -> DataFrame:
    """Both orientations, named in row_direction."""
    return pairs.withColumn("row_direction", F.lit("a_minus_b")).unionByName(swapped(pairs, texts).withColumn("row_direction", F.lit("b_minus_a")))


def canonical_rows(df: DataFrame, contest: str = "contest_id") -> DataFrame:
    """The a_minus_b rows, or the first row of each contest where there is no direction."""
    if "row_direction" in df.columns:
        return df.filter(F.col("row_direction") == "a_minus_b")
    w = Window.partitionBy(contest).orderBy(*[c for c in df.columns if c != contest])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def mirror_audit(rows: DataFrame, contest: str = "contest_id", tolerance: float = 1e-8) -> DataFrame:
    """One row for each contest with how its two orientations disagree: counts of violations by kind, and the number of rows."""
    diffs = [c for c in rows.columns if c.endswith("_diff")]
    sides = [c[:-2] for c in rows.columns if c.endswith("_a") and f"{c[:-2]}_b" in rows.columns]
    pick = lambda c, d: F.max(F.when(F.col("row_direction") == d, F.col(c)))
    cols = [*diffs, "label", *[f"{s}_{x}" for s in sides for x in "ab"]]
    wide = rows.groupBy(contest).agg(F.count(F.lit(1)).alias("n_rows"), *[pick(c, d).alias(f"{c}__{i}") for c in cols for i, d in enumerate(("a_minus_b", "b_minus_a"))])
    bad = lambda x, y, ok: F.when(x.isNull() != y.isNull(), 1).when(x.isNotNull() & ~ok, 1).otherwise(0)
    total = lambda parts: sum(parts, F.lit(0))
    c = F.col
    sign = total([bad(c(f"{d}__0"), c(f"{d}__1"), F.abs(c(f"{d}__0") + c(f"{d}__1")) <= tolerance) for d in diffs])
    swap = total([bad(c(f"{s}_a__0"), c(f"{s}_b__1"), c(f"{s}_a__0") == c(f"{s}_b__1")) + bad(c(f"{s}_b__0"), c(f"{s}_a__1"), c(f"{s}_b__0") == c(f"{s}_a__1")) for s in sides])
    label = bad(c("label__0"), c("label__1"), c("label__0") + c("label__1") == 1)
    return wide.select(contest, "n_rows", sign.alias("sign_errors"), swap.alias("swap_errors"), label.alias("label_errors"))


def top_differences(pairs: DataFrame, n: int = 12, key: str = "contest_id") -> DataFrame:
    """The n largest absolute differences of each row: (key, feature, diff, place). Sorted within the row, without a shuffle."""
    diffs = [c for c in pairs.columns if c.endswith("_diff")]
    items = F.array(*[F.struct(F.abs(F.col(c).cast("double")).alias("size"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("diff")) for c in diffs])
    some = F.filter(items, lambda x: x["diff"].isNotNull())
    ranked = F.array_sort(some, lambda x, y: F.when(x["size"] > y["size"], -1).when(x["size"] < y["size"], 1).when(x["feature"] < y["feature"], -1).when(x["feature"] > y["feature"], 1).otherwise(0))
    return pairs.select(key, F.posexplode(F.slice(ranked, 1, n)).alias("at", "x")).select(key, "x.feature", "x.diff", (F.col("at") + 1).cast("bigint").alias("place"))


def prefixed(df: DataFrame, side: str, keys: Sequence[str]) -> DataFrame:
    """df with every column but the keys renamed to <side>_<column>."""
    return df.select(*[F.col(c) if c in keys else F.col(c).alias(f"{side}_{c}") for c in df.columns])


def attach_sides(pairs_df: DataFrame, snapshots: DataFrame, on: Sequence[str] = ("contest_id",), entity: str = "entity_id") -> DataFrame:
    """Pairs with both sides' snapshots as a_<column> and b_<column>, by two left joins on the keys and the side's entity."""
    out = pairs_df
    for side in ("a", "b"):
        out = out.join(prefixed(snapshots, side, [*on, entity]).withColumnRenamed(entity, f"entity_{side}"), [*on, f"entity_{side}"], "left")
    return out


def increment(dataset: DataFrame, obs: DataFrame, specs: Sequence[Spec], features: Sequence[str], contest: str = "contest_id") -> DataFrame:
    """The rows that `dataset`, mirrored pair rows, lacks: both orientations of each contest of obs that it doesn't have, with exactly its columns and types.

    Only the histories of the new contests' entities are read; a column that isn't computed here is null.
    """
    new = obs.join(dataset.select(contest).distinct(), contest, "left_anti")
    own = obs.join(new.select("entity_id").distinct(), "entity_id", "left_semi")
    rows = snapshots(own, specs).join(new.select(contest).distinct(), contest, "left_semi")
    made = mirrored(pair_rows(rows, features, contest))
    return made.select(*[(F.col(c) if c in made.columns else F.lit(None)).cast(t).alias(c) for c, t in dataset.dtypes])
