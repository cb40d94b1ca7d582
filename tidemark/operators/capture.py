"""Change capture: keyed diffs, upserts, bounded rebuilds, import classes, retention, hash-chained ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import canonical_value, fingerprint


def keyed_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, change, column, old_value, new_value): added and removed keys, and each corrected value in canonical text form.

    Keys must be unique in both tables. Values are brought to their text form only where the values as they are differ.
    """
    side = lambda df, p: df.select(*[F.col(k) for k in keys], *[F.col(c).cast("string").alias(f"{p}{c}") for c in columns], F.lit(True).alias(f"{p}here"))
    both = side(old, "_o_").join(side(new, "_n_"), list(keys), "full_outer")
    added, removed = F.col("_o_here").isNull(), F.col("_n_here").isNull()
    item = lambda kind, c, o, n: F.struct(F.lit(kind).alias("change"), F.lit(c).cast("string").alias("column"), o.alias("old_value"), n.alias("new_value"))
    none = F.lit(None).cast("string")
    raw = [(c, F.col(f"_o_{c}"), F.col(f"_n_{c}")) for c in columns]
    differ = [F.when(~o.eqNullSafe(n), F.when(~canonical_value(o).eqNullSafe(canonical_value(n)), item("corrected", c, canonical_value(o), canonical_value(n)))) for c, o, n in raw]
    fixes = F.filter(F.array(*differ), lambda x: x.isNotNull())
    changes = F.when(added, F.array(item("added", None, none, none))).when(removed, F.array(item("removed", None, none, none))).otherwise(fixes)
    return both.select(*keys, F.explode(changes).alias("c")).select(*keys, "c.change", "c.column", "c.old_value", "c.new_value")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of new, and the rows of old whose keys new hasn't. Columns that one side lacks are null there."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def rebuild_suffix(old: DataFrame, recomputed: DataFrame, first_changed: Column, day: str = "event_day") -> DataFrame:
    """Keeps what lies before the first changed day and takes everything from it on anew."""
    return old.filter(F.col(day) < first_changed).unionByName(recomputed.filter(F.col(day) >= first_changed), allowMissingColumns=True)


def first_changed_day(diff: DataFrame, old: DataFrame, new: DataFrame, keys: Sequence[str], day: str = "event_day") -> DataFrame:
    """One row, `day`: the earliest day of any changed key in either table."""
    touched = diff.select(*keys).distinct()
    days = old.join(touched, list(keys), "left_semi").select(day).unionByName(new.join(touched, list(keys), "left_semi").select(day))
    return days.agg(F.min(day).alias("day"))


def import_classes(have: DataFrame, incoming: DataFrame, key: str, columns: Sequence[str], valid: Column) -> DataFrame:
    """(key, class) of incoming rows: invalid, new, duplicate (same content) or conflict (other content under the same key)."""
    a = have.select(F.col(key), fingerprint(columns).alias("_have"))
    b = incoming.select(F.col(key), fingerprint(columns).alias("_new"), F.coalesce(valid, F.lit(False)).alias("_ok"))
    kind = F.when(~F.col("_ok"), "invalid").when(F.col("_have").isNull(), "new").when(F.col("_have") == F.col("_new"), "duplicate").otherwise("conflict")
    return b.join(a, key, "left").select(key, kind.alias("class"))


def retain_newest(df: DataFrame, newest_first: Sequence[Column], size: str, most_rows: int, most_size: float, by: str | None = None) -> DataFrame:
    """The newest rows within a budget of rows and of total size, whole table or for each value of `by`.

    Without `by` the newest most_rows rows are taken first, so the running sum sees no more than those.
    """
    if by is None:
        df = df.orderBy(*newest_first).limit(most_rows)
    w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy(*newest_first)
    out = df.withColumn("_n", F.row_number().over(w)).withColumn("_s", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.filter((F.col("_n") <= most_rows) & (F.col("_s") <= most_size)).drop("_n", "_s")


def chained(df: DataFrame, chain: str, order: str, payload: Sequence[str]) -> DataFrame:
    """Ledger rows: payload_hash, and the hash of the row before it in its chain (empty for the first)."""
    w = Window.partitionBy(chain).orderBy(order)
    hashed = df.withColumn("payload_hash", fingerprint([chain, order, *payload]))
    return hashed.withColumn("previous_hash", F.coalesce(F.lag("payload_hash").over(w), F.lit("")))


def broken_links(ledger: DataFrame, chain: str, order: str, payload: Sequence[str]) -> DataFrame:
    """Ledger rows whose content or link doesn't match, with the reason."""
    w = Window.partitionBy(chain).orderBy(order)
    now = ledger.withColumn("_hash", fingerprint([chain, order, *payload])).withColumn("_before", F.coalesce(F.lag("payload_hash").over(w), F.lit("")))
    reason = F.when(F.col("_hash") != F.col("payload_hash"), "content").when(F.col("_before") != F.col("previous_hash"), "link")
    return now.withColumn("reason", reason).filter("reason is not null").drop("_hash", "_before")


def contest_fingerprints(obs: DataFrame, columns: Sequence[str], contest: str = "contest_id") -> DataFrame:
    """(contest, sha): SHA-256 over the contest's observations in a fixed order."""
    rows = F.array_sort(F.collect_list(F.struct(*sorted(columns))))
    return obs.groupBy(contest).agg(F.sha2(F.to_json(rows), 256).alias("sha"))
