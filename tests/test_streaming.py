import datetime as dt

from pyspark.sql import functions as F
from tidemark.streaming import twins

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def write(spark, path, name, items):
    rows = [(i, dt.datetime(2024, 1, d, h), u, "t", v, "") for i, d, h, u, v in items]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/{name}")


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(path)


def test_history_survives_restarts_and_leaves_late_days_out(spark, tmp_path):
    data, point = str(tmp_path / "in"), str(tmp_path / "point")
    got = []
    sink = lambda batch, _: got.extend(tuple(r) for r in batch.collect())
    write(spark, data, "a", [(1, 1, 5, 7, 2.0), (2, 1, 3, 7, 3.0), (3, 2, 1, 7, 1.0)])
    twins.run_available(twins.day_frozen_history(stream(spark, data)), "h", checkpoint=point, sink=sink)
    write(spark, data, "b", [(4, 2, 9, 7, 4.0), (5, 1, 9, 7, 9.0), (6, 3, 1, 7, 1.0), (7, 3, 1, 8, 1.0)])
    twins.run_available(twins.day_frozen_history(stream(spark, data)), "h", checkpoint=point, sink=sink)
    assert {(r[1], r[3], r[4]) for r in got} == {(1, 0, 0.0), (2, 0, 0.0), (3, 2, 5.0), (4, 2, 5.0), (6, 4, 10.0), (7, 0, 0.0)}


def test_windows_are_the_same_on_streams_and_tables(spark, tmp_path):
    data = str(tmp_path / "in")
    write(spark, data, "a", [(i, 1 + i % 3, i % 24, i % 2, float(i)) for i in range(50)])
    table = spark.read.option("recursiveFileLookup", True).parquet(data)
    live = twins.run_available(twins.tumbling(twins.stamped(stream(spark, data))), "tumbling_test", "complete")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, twins.tumbling(table).collect()))
    live = twins.run_available(twins.sessions(twins.stamped(stream(spark, data)), "2 hours"), "sessions_test", "complete")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, twins.sessions(table, "2 hours").collect()))


def test_future_rows_are_dropped(spark):
    df = spark.createDataFrame([(1, dt.datetime(2020, 1, 1)), (2, dt.datetime(2999, 1, 1))], "event_id int, ts timestamp")
    assert [r.event_id for r in twins.stamped(df).collect()] == [1]


def test_corrections_replace_by_key(spark, tmp_path):
    merge = twins.corrections(str(tmp_path / "t"), ["k"])
    merge(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), 0)
    batch = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    merge(batch, 1)
    merge(batch, 1)
    merge(spark.createDataFrame([(3, "d")], "k int, v string"), 0)  # by a new checkpoint
    newest = twins.latest_version(spark, str(tmp_path / "t"))
    out = spark.read.parquet(str(tmp_path / "t" / f"v{newest}"))
    assert {tuple(r) for r in out.collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_deduplication(spark):
    df = spark.createDataFrame([(1, dt.datetime(2020, 1, 1)), (1, dt.datetime(2020, 1, 1))], "event_id int, ts timestamp").withColumn("x", F.lit(1))
    assert twins.distinct_events(df).count() == 1


def test_outputs_lie_in_the_shared_folder(spark, tmp_path):
    data, shared = str(tmp_path / "in"), spark.conf.get("spark.checkpoint.dir")
    write(spark, data, "a", [(i % 30, 1 + i % 3, i % 24, i % 2, float(i)) for i in range(60)])
    out = [
        twins.run_available(twins.distinct_events(twins.stamped(stream(spark, data), delay="100 days")).select("event_id", "user_id"), "shared_dedupe"),
        twins.run_available(twins.tumbling(twins.stamped(stream(spark, data))), "shared_tumbling", "complete"),
        twins.run_frozen_history(stream(spark, data), "shared_history"),
    ]
    assert [df.count() for df in out] == [30, 3, 60]
    assert all(df.inputFiles() and all(shared in f for f in df.inputFiles()) for df in out)


def test_history_by_batches_keeps_totals_over_restarts(spark, tmp_path):
    data, path = str(tmp_path / "in"), str(tmp_path / "history")
    run = lambda: twins.run_available(stream(spark, data), "h", checkpoint=f"{path}/checkpoint", sink=twins.frozen_history_batches(path))
    write(spark, data, "a", [(1, 1, 5, 7, 2.0), (2, 1, 3, 7, 3.0), (3, 2, 1, 7, 1.0), (8, 1, 1, None, 1.0), (9, 2, 1, None, None)])
    run()
    write(spark, data, "b", [(4, 2, 9, 7, 4.0), (5, 1, 9, 7, 9.0), (6, 3, 1, 7, 1.0), (7, 3, 1, 8, 1.0), (10, 3, 1, None, 1.0)])
    run()
    got = spark.read.schema(twins.HISTORY).parquet(f"{path}/rows").collect()
    assert {(r.event_id, r.events_before, r.value_before) for r in got} == {(1, 0, 0.0), (2, 0, 0.0), (3, 2, 5.0), (4, 2, 5.0), (6, 4, 10.0), (7, 0, 0.0), (8, 0, 0.0), (9, 1, 1.0), (10, 2, 1.0)}
    assert len(got) == 9
