"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def stamped(events: DataFrame, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Events with an instant in UTC as `ts` and a watermark; rows from the future are dropped, not kept waiting."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).filter(F.col(ts) <= F.current_timestamp()).withWatermark(ts, delay)


def tumbling(events: DataFrame, every: str = "1 day", key: str = "event_type", value: str = "value", ts: str = "ts") -> DataFrame:
    """(start, key, n, total) for each window; works on a stream and on a table."""
    return events.groupBy(F.window(ts, every), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def sliding(events: DataFrame, length: str = "2 days", every: str = "1 day", key: str = "event_type", value: str = "value", ts: str = "ts") -> DataFrame:
    """(start, end, key, n, total) for each window of `length` that begins every `every`: an event lies in several."""
    w = events.groupBy(F.window(ts, length, every), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """(key, start, end, n) of runs of events with no pause longer than the gap."""
    return events.groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def distinct_events(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Each key once within the watermark."""
    return events.dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


HISTORY = "user_id bigint, event_id bigint, day date, events_before bigint, value_before double"


def day_frozen_history(events: DataFrame, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """For each event, how many events of its key lie on earlier days, and their value: the streaming twin of the strict-before history.

    State of a key: totals up to the last closed day, and the open day's events, in order. A day closes when an event of a later day
    comes. Events of days already closed come too late and are left to the correction path: they give no row here.
    One key's rows of a micro-batch meet in one task; frozen_history_batches gives the same rows where a key may have very many.
    """

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, day, day_n, day_total = state.get if state.exists else (0, 0.0, "", 0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["day", "event_id"])  # one key's rows of one micro-batch
        rows = rows.assign(iso=rows["day"].map(lambda d: d.isoformat()), value=rows["value"].fillna(0.0))
        rows = rows[rows["iso"] >= day]
        if len(rows):
            days = rows.groupby("iso")["value"].agg(["size", "sum"])
            if days.index[0] == day:  # the open day goes on
                days.loc[day] += (day_n, day_total)
            else:
                n, total = n + day_n, total + day_total
            opening = n + days["size"].cumsum() - days["size"], total + days["sum"].cumsum() - days["sum"]
            n, total, day, (day_n, day_total) = int(opening[0].iloc[-1]), float(opening[1].iloc[-1]), days.index[-1], days.iloc[-1]
            rows = rows.assign(events_before=rows["iso"].map(opening[0]).astype("int64"), value_before=rows["iso"].map(opening[1]), user_id=keys[0])
        else:
            rows = rows.assign(events_before=pd.Series(dtype="int64"), value_before=pd.Series(dtype="float64"), user_id=keys[0])
        state.update((n, total, day, int(day_n), float(day_total)))
        yield rows[["user_id", "event_id", "day", "events_before", "value_before"]]

    rows = events.select(F.col(key).alias("user_id"), "event_id", F.col(ts).cast("timestamp").cast("date").alias("day"), "value").filter("day is not null")
    return rows.groupBy("user_id").applyInPandasWithState(step, HISTORY, "n bigint, total double, day string, day_n bigint, day_total double", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None, sink: Callable | None = None) -> DataFrame | None:
    """Runs a stream over what is there and stops. To a Parquet table in the shared folder, or through `sink` for each micro-batch.

    Rows go from the executors to the table; in complete mode each micro-batch writes it anew, beside the one before, and the last one counts.
    The checkpoint lies beside it, unless one is given.
    """
    spark = stream.sparkSession
    root = shared_root(spark, name)
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{root}/checkpoint")
    if sink:
        writer = writer.foreachBatch(sink)
    elif mode == "complete":
        writer = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/table/v{number}"))
    else:
        writer = writer.format("parquet").option("path", f"{root}/table")
    writer.start().awaitTermination()
    if sink:
        return None
    last = f"/v{latest_version(spark, f'{root}/table')}" if mode == "complete" else ""
    return read_or_empty(spark, f"{root}/table{last}", stream.schema)


def run_into(stream: DataFrame, root: str) -> dict[str, int]:
    """Runs a stream in append mode over what is there into root/table, going on from root/checkpoint. late_rows, dropped by the watermark, and state_rows left."""
    q = stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint").format("parquet").option("path", f"{root}/table").start()
    q.awaitTermination()
    said = [s for p in q.recentProgress for s in p.stateOperators]
    return {"late_rows": sum(s.numRowsDroppedByWatermark for s in said), "state_rows": said[-1].numRowsTotal if said else 0}


def shared_root(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share. Without one, a session in one process gets a temporary folder, as in tests; a cluster's raises."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        path = spark.sparkContext.getCheckpointDir()
    return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A Parquet table; without rows where nothing was written."""
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def _exists(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def latest_version(spark: SparkSession, path: str, below: int | None = None) -> int | None:
    """The largest n (below a bound) of the folders path/vn that were written whole; None if there is none."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    numbers = [int(f.getPath().getParent().getName()[1:]) for f in found]
    return max((n for n in numbers if below is None or n < below), default=None)


TOTALS = "user_id bigint, n bigint, total double, day date, day_n bigint, day_total double"


def frozen_history_batches(path: str, key: str = "user_id", ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that gives the rows of day_frozen_history, without bringing one key's events together.

    Events are summed by key and day first; only these sums meet key by key, and each day's opening totals are joined back to
    its events. Batch k writes its rows to rows/batch=k and the totals of all keys to totals/vk, so a repeat changes nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        value = F.coalesce(F.nanvl(F.col("value").cast("double"), F.lit(0.0)), F.lit(0.0))
        rows = batch.select(F.col(key).alias("user_id"), "event_id", F.col(ts).cast("timestamp").cast("date").alias("day"), value.alias("value")).filter("day is not null")
        old = read_or_empty(spark, f"{path}/totals/v{number - 1}", TOTALS)
        new = rows.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("day_n"), F.sum("value").alias("day_total")).select("user_id", F.lit(0).alias("n"), F.lit(0.0).alias("total"), "day", "day_n", "day_total")
        whole = Window.partitionBy("user_id")
        # the totals known so far lie on the open day; earlier days of this batch come too late
        days = old.withColumn("open", F.col("day")).unionByName(new.withColumn("open", F.lit(None).cast("date"))).withColumn("open", F.max("open").over(whole)).filter("open is null or day >= open")
        days = days.groupBy("user_id", "day").agg(*[F.sum(c).alias(c) for c in ("n", "total", "day_n", "day_total")])
        before, start = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
        opening = [(F.sum(base).over(start) + F.coalesce(F.sum(add).over(before), F.lit(0))).alias(base) for base, add in (("n", "day_n"), ("total", "day_total"))]
        days.select("user_id", *opening, "day", "day_n", "day_total", F.max("day").over(whole).alias("latest")).write.mode("overwrite").parquet(f"{path}/days")
        days = spark.read.schema(TOTALS + ", latest date").parquet(f"{path}/days")
        d = days.select(F.col("user_id").alias("k"), F.col("day").alias("opened"), "n", "total")
        out = rows.join(d.hint("merge"), rows.user_id.eqNullSafe(d.k) & (rows.day == d.opened)).select("user_id", "event_id", "day", F.col("n").alias("events_before"), F.col("total").alias("value_before"))
        out.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        days.filter("day = latest").drop("latest").write.mode("overwrite").parquet(f"{path}/totals/v{number}")

    return step


def run_frozen_history(events: DataFrame, name: str, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Rows of day_frozen_history for all that is there, by micro-batches in the shared folder."""
    spark = events.sparkSession
    root = shared_root(spark, name)
    run_available(events, name, checkpoint=f"{root}/checkpoint", sink=frozen_history_batches(root, key, ts))
    return read_or_empty(spark, f"{root}/rows", HISTORY).drop("batch")


def corrections(state_path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that replaces rows by key in a Parquet table: each batch writes a version above the newest one there is.

    A batch that is run again replaces the same rows by the same rows, and a new checkpoint goes on from what is there.
    """

    def merge(batch: DataFrame, number: int) -> None:
        from ..operators.capture import upsert
        from ..operators.contracts import first_by

        spark = batch.sparkSession
        new = first_by(batch, keys, [])
        newest = latest_version(spark, state_path)
        if newest is None:
            new.write.mode("overwrite").parquet(f"{state_path}/v{number}")
        else:
            upsert(spark.read.parquet(f"{state_path}/v{newest}"), new, keys).write.mode("overwrite").parquet(f"{state_path}/v{max(newest + 1, number)}")

    return merge
