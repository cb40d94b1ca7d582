"""Exact dedup by distributed MSD radix partitioning.

Documents are split by successive runs of bytes (digits) of their normalised text until a group is a
single document or its text has ended. Digits get longer from round to round, so the number of rounds
grows with the logarithm of the longest text. Equality is the equality of all digits; no digest takes part.

Each round is one aggregation by (group, digit), which combines on the map side, and one join back, whose
large partitions adaptive execution can split: a group that holds a third of all rows never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Stage, numbered

FIRST_DIGIT, GROWTH = 24, 20


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_digit: int = FIRST_DIGIT, growth: int = GROWTH) -> DataFrame:
    """One row per input row: id, keep_id (largest id among equal texts), group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; a null text counts as empty. Nulls sort
    below every id, so keep_id is null only if all ids of a group are. Of repeated rows (same id, same text)
    exactly one is kept. An empty table gives an empty result; other columns are ignored.
    """
    stage = Stage(df.sparkSession, "exact-dedup")
    docs = df.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).cast("binary").alias("bytes"))
    head = F.substring("bytes", 1, first_digit)
    shared = stage.write(docs.groupBy(head.alias("digit")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digit").withColumn("gid", F.monotonically_increasing_id()), "shared")
    # one pass over the texts; a merge join, so that a small list of shared digits doesn't change how the work grows
    split = docs.join(shared.hint("merge"), head == shared.digit, "left").select(
        F.monotonically_increasing_id().alias("rid"), "id", "gid", F.sha2("bytes", 256).alias("sha"), F.when(F.col("gid").isNotNull(), F.substring("bytes", first_digit + 1, 2**31 - 1)).alias("rest"), (F.length("bytes") < first_digit).alias("ended")
    )
    split = stage.write(split, "split", "zstd")
    lone = split.filter("gid is null").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    live = split.filter("gid is not null")
    done, size, k = [lone], first_digit, 0
    while not live.isEmpty():
        k, size = k + 1, size * growth
        ended = F.length("rest") < size
        cut = live.select("rid", "id", "gid", "sha", F.substring("rest", 1, size).alias("digit"), F.substring("rest", size + 1, 2**31 - 1).alias("tail"), ended.alias("ended"))
        groups = cut.groupBy("gid", "digit").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "rid")).alias("keep")).withColumn("next", F.monotonically_increasing_id())
        groups = stage.write(groups, f"groups{k}", "zstd")
        joined = stage.write(cut.join(groups.hint("merge"), ["gid", "digit"]).select("rid", "id", F.col("next").alias("gid"), "sha", "n", "keep", "ended", F.col("tail").alias("rest")), f"live{k}", "zstd")
        stage.drop(f"groups{k}")
        over = F.col("ended") | (F.col("n") == 1)
        settled = joined.filter(over).select("id", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("keep.rid") == F.col("rid")).alias("kept"), F.col("sha").alias("text_sha256"))
        done.append(stage.write(settled, f"done{k}"))
        if k > 1:
            stage.drop(f"live{k - 1}")
        live = joined.filter(~over).select("rid", "id", "gid", "sha", "rest", "ended")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("id", id_col)


def keep_first_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that exact dedup keeps, with all their columns. Rows with a null id are kept once per text."""
    stage = Stage(df.sparkSession, "keep-first")
    rows = numbered(df, stage)
    keyed = rows.select(F.struct(F.col("doc")[id_col].alias("id"), "row").alias("key"), F.col("doc")[text_col].alias("text"))
    kept = exact_dedup(keyed, "key", "text").filter("kept").select("key.row")
    return rows.join(kept, "row", "left_semi").select("doc.*")
