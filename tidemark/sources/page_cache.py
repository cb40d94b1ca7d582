"""A cache of web pages as a Spark data source: batches of pages in shards by host, read by partition, pruned by pushed-down filters, or followed as a stream.

The folder is written by Spark (`write_batch`), the reader opens its shards in the tasks, by any file system that pyarrow knows by URI. Fetching pages isn't
part of it: `missing` says which of the wanted ones the cache lacks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from ..functions.scalars import url_slug

SCHEMA = "page_id bigint, url string, host string, slug string, html string, bucket int"
FORMAT = "tidemark_pages"
BUCKETS = 16


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def write_batch(pages: DataFrame, root: str, batch: int, buckets: int = BUCKETS) -> None:
    """Puts pages (page_id, url, html) into the cache as one batch. A batch that is written again replaces itself.

    Rows are dealt by bucket, and adaptive execution cuts buckets beyond its advisory size into several tasks, and so files: a host with most pages is no single task.
    """
    host = host_of(F.col("url"))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", host.alias("host"), url_slug(F.col("url")).alias("slug"), "html")
    shards = rows.withColumn("bucket", (F.crc32(F.col("host").cast("binary")) % buckets).cast("int"))
    shards.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/batch={batch}")


def missing(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """The wanted pages (with url) that the cache lacks, by the file name that a URL has."""
    return wanted.withColumn("slug", url_slug(F.col("url"))).join(cache.select("slug"), "slug", "left_anti")


@dataclass
class Shard(InputPartition):
    path: str
    bucket: int


def _shards(root: str, batches: Sequence[int] | None, buckets: set[int] | None) -> list[Shard]:
    """The files of whole batches (those that Spark has marked as written), of the given batches and buckets."""
    store, base = fs.FileSystem.from_uri(root)
    out = []
    for n in _batches(root) if batches is None else batches:
        for f in store.get_file_info(fs.FileSelector(f"{base}/batch={n}", recursive=True)):
            folder = f.path.rsplit("/", 2)[-2]
            if f.type == fs.FileType.File and folder.startswith("bucket=") and f.path.endswith(".parquet"):
                bucket = int(folder.removeprefix("bucket="))
                if buckets is None or bucket in buckets:
                    out.append(Shard(f.path, bucket))
    return sorted(out, key=lambda s: s.path)


def _batches(root: str) -> list[int]:
    store, base = fs.FileSystem.from_uri(root)
    found = [f.path for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.type == fs.FileType.Directory and f.base_name.startswith("batch=")]
    done = store.get_file_info([f"{p}/_SUCCESS" for p in found]) if found else []
    return sorted(int(p.rpartition("batch=")[2]) for p, f in zip(found, done, strict=True) if f.type == fs.FileType.File)


def _read(root: str, shard: Shard) -> Iterator[pa.RecordBatch]:
    store, _ = fs.FileSystem.from_uri(root)
    with store.open_input_file(shard.path) as f:
        for b in pq.ParquetFile(f).iter_batches(1024, columns=["page_id", "url", "host", "slug", "html"]):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([shard.bucket] * b.num_rows, pa.int32())], ["page_id", "url", "host", "slug", "html", "bucket"])


class PageReader(DataSourceReader):
    """Reads shards in tasks. Conditions on bucket are fully pushed down; one host, or several, leave out all other buckets and are checked again by Spark."""

    def __init__(self, root: str, buckets: int):
        self.root, self.n, self.wanted = root, buckets, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("bucket",):
                self._keep({int(v) for v in values if v is not None})
                continue
            if values is not None and f.attribute == ("host",):
                self._keep({zlib.crc32(v.encode()) % self.n for v in values if v is not None})
            yield f

    def _keep(self, buckets: set[int]) -> None:
        self.wanted = buckets if self.wanted is None else self.wanted & buckets

    def partitions(self) -> Sequence[InputPartition]:
        return _shards(self.root, None, self.wanted) or [Shard("", -1)]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        return _read(self.root, partition) if partition.path else iter(())


class PageStream(DataSourceStreamReader):
    """Follows the cache batch by batch: the offset is the number of the last batch that was taken; batches are written in the order of their numbers."""

    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {"batch": -1}

    def latestOffset(self) -> dict:
        return {"batch": max(_batches(self.root), default=-1)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return _shards(self.root, [n for n in _batches(self.root) if start["batch"] < n <= end["batch"]], None)

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        return _read(self.root, partition)

    def commit(self, end: dict) -> None:
        pass


class PageSource(DataSource):
    """spark.read.format(FORMAT).option("path", root): the pages of a cache; readStream follows its batches. Option buckets: as it was written."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(self.options["path"], int(self.options.get("buckets", BUCKETS)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PageStream(self.options["path"])


def page_cache(spark: SparkSession, root: str, buckets: int = BUCKETS, stream: bool = False) -> DataFrame:
    """The cache at root as a table, or as a stream of its batches. Registers the source, and lets Spark push filters down to it."""
    spark.dataSource.register(PageSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.readStream if stream else spark.read
    return reader.format(FORMAT).option("path", root).option("buckets", buckets).load()
