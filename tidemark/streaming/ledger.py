"""An append-only hash chain as a stream's sink, and forecasts met by their outcomes within an interval."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.capture import chained
from .twins import latest_version, read_or_empty, run_available


def ledger_batches(path: str, chain: str, order: str, payload: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends rows to a ledger, each exactly once, linked to the row before it in its chain.

    Batch k writes rows/batch=k and, as tails/vk, each chain's last number and hash. Both follow from batch k and the tails before it alone, so a batch
    that is run again writes the same rows again. A row whose number isn't above its chain's last one is there already, or comes too late: it goes to
    skipped/batch=k. A chain's rows of one batch meet in one task. A new checkpoint on an old ledger is refused.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        tail_schema = f"{_field(batch, chain)}, last {_kind(batch, order)}, last_hash string"
        newest = latest_version(spark, f"{path}/tails")
        if newest is not None and newest > number:
            raise ValueError(f"batch {number} comes after batch {newest}: go on with the checkpoint that the ledger was written with")
        before = latest_version(spark, f"{path}/tails", below=number)
        tails = read_or_empty(spark, f"{path}/tails/v{before}", tail_schema)
        new = batch.select(chain, order, *payload).dropDuplicates([chain, order]).join(tails, chain, "left")
        there = F.col(order) <= F.col("last")
        new.filter(there).select(chain, order, *payload).write.mode("overwrite").parquet(f"{path}/skipped/batch={number}")
        fresh = chained(new.filter(F.coalesce(~there, F.lit(True))), chain, order, payload)
        fresh = fresh.withColumn("previous_hash", F.when(F.col("previous_hash") == "", F.coalesce("last_hash", F.lit(""))).otherwise(F.col("previous_hash")))
        fresh.drop("last", "last_hash").write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        rows = spark.read.schema(fresh.drop("last", "last_hash").schema).parquet(f"{path}/rows/batch={number}")
        ends = rows.groupBy(chain).agg(F.max(order).alias("last"), F.max_by("payload_hash", order).alias("last_hash"))
        tails.join(ends, chain, "left_anti").unionByName(ends).write.mode("overwrite").parquet(f"{path}/tails/v{number}")

    return step


def _kind(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def _field(df: DataFrame, c: str) -> str:
    return f"{c} {_kind(df, c)}"


def run_ledger(stream: DataFrame, path: str, chain: str, order: str, payload: Sequence[str]) -> DataFrame:
    """The ledger after all that is there: chain, order, payload, payload_hash, previous_hash."""
    run_available(stream, "ledger", checkpoint=f"{path}/checkpoint", sink=ledger_batches(path, chain, order, payload))
    fields = [_field(stream, c) for c in (chain, order, *payload)]
    return read_or_empty(stream.sparkSession, f"{path}/rows", ", ".join([*fields, "payload_hash string", "previous_hash string"]))


def settled(forecasts: DataFrame, outcomes: DataFrame, key: str = "forecast_id", made: str = "made_at", seen: str = "seen_at", within: str = "2 days", delay: str = "1 day") -> DataFrame:
    """forecasts with the columns of their outcomes that were seen no earlier than the forecast was made, and at most `within` later; null where there is none.

    On two streams, a forecast without an outcome is given out when the watermark says that none can come any more, and state holds no row for longer. On tables
    it is the same join. Outcomes outside the interval count as none. key and `made` may not be columns of outcomes, but for key itself.
    """
    f, o = forecasts, outcomes.withColumnRenamed(key, "_outcome_of")
    if forecasts.isStreaming:
        f, o = f.withWatermark(made, delay), o.withWatermark(seen, delay)
    meets = (F.col(key) == F.col("_outcome_of")) & (F.col(seen) >= F.col(made)) & (F.col(seen) <= F.col(made) + F.expr(f"INTERVAL {within}"))
    return f.join(o, meets, "left_outer").drop("_outcome_of")


def chain_lengths(ledger: DataFrame, chain: str) -> DataFrame:
    """(chain, rows, firsts): a whole chain has one row without a predecessor."""
    return ledger.groupBy(chain).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("previous_hash") == "").alias("firsts"))


def in_two_parts(df: DataFrame, later, root: str) -> tuple[Callable[[], None], Callable[[], None]]:
    """Two functions that put the rows of df into the folder root/in, first those that aren't `later`, then the others: as files that a stream finds."""
    put = lambda cond: lambda: df.filter(cond).write.mode("append").parquet(f"{root}/in")
    return put(~F.coalesce(later, F.lit(False))), put(F.coalesce(later, F.lit(False)))


def stream_of(spark: SparkSession, root: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).parquet(f"{root}/in")
