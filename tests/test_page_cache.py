from pyspark.sql import functions as F
from tidemark.sources import page_cache
from tidemark.streaming import twins


def test_cache_reads_back_prunes_and_streams(spark, tmp_path):
    root = str(tmp_path / "cache")
    rows = [(i, f"https://h{i % 9}.example.org/p/{i}?q=1", f"<p>{i}</p>") for i in range(60)] + [(60, None, "no url"), (61, "plain text", None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert page_cache.page_cache(spark, root).count() == 0  # nothing is there yet
    page_cache.write_batch(df.filter("page_id < 30"), root, 0)
    page_cache.write_batch(df.filter("page_id >= 30"), root, 1)
    page_cache.write_batch(df.filter("page_id >= 30"), root, 1)  # again
    all_ = page_cache.page_cache(spark, root)
    assert sorted((r.page_id, r.url or "", r.html or "") for r in all_.collect()) == sorted((i, u or "", h or "") for i, u, h in rows)
    one = all_.filter("host = 'h3.example.org'")
    assert {r.page_id for r in one.collect()} == set(range(3, 60, 9))
    assert one.rdd.getNumPartitions() < all_.rdd.getNumPartitions()  # other shards aren't opened
    bucket = one.first().bucket
    assert {r.page_id for r in all_.filter(F.col("bucket").isin(bucket, 99)).collect()} >= {r.page_id for r in one.collect()}
    assert all_.filter("bucket = 77").count() == 0
    wanted = spark.createDataFrame([("https://h3.example.org/p/3?q=1",), ("https://new.example.org/",)], "url string")
    assert [r.url for r in page_cache.missing(wanted, all_).collect()] == ["https://new.example.org/"]
    run = lambda: twins.run_into(page_cache.page_cache(spark, root, stream=True).select("page_id", "host"), str(tmp_path / "out"))
    run()
    page_cache.write_batch(df.filter("page_id < 5").withColumn("page_id", F.col("page_id") + 100), root, 2)
    run()
    assert sorted(r.page_id for r in spark.read.parquet(str(tmp_path / "out" / "table")).collect()) == [*range(62), *range(100, 105)]
