"""Scans, sinks and dataset contracts over files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import iso_date


def csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; quoted line ends are part of a value. Types are inferred only without a schema."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def string_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """All columns as text, byte for byte; a missing file is an empty table with the given columns. Extra columns stay, missing ones are ''."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    try:
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\x00").option("emptyValue", "").csv(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    named = df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns})
    return align(named, [*columns, *[c for c in named.columns if c not in columns]], fill="")


def resolve_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate that df has: exactly, else in another case."""
    lower = {c.lower(): c for c in reversed(df.columns)}
    return next((c for c in candidates if c in df.columns), None) or next((lower[c.lower()] for c in candidates if c.lower() in lower), None)


def pruned(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The columns of the list that df has, and the names it lacks."""
    return df.select(*[c for c in columns if c in df.columns]), [c for c in columns if c not in df.columns]


def align(df: DataFrame, columns: Sequence[str], fill: str | None = None) -> DataFrame:
    """Exactly these columns in this order; missing ones are filled, values that are missing too if fill is a text."""
    return df.select(*[(F.coalesce(F.col(c), F.lit(fill)) if fill is not None else F.col(c)).alias(c) if c in df.columns else F.lit(fill).cast("string").alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: Sequence[str], mode: str = "errorifexists") -> None:
    """CSV with a fixed column order; missing columns are empty, others are left out."""
    align(df, columns).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def training_rows(df: DataFrame, label: str = "label", day: str = "event_day", key: str = "contest_id", categories: Sequence[str] = ()) -> DataFrame:
    """Dated, labelled rows: whole-number label, missing categories are Unknown. Missing columns raise."""
    if lacking := [c for c in (label, day, key, *categories) if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    out = df.withColumn(label, F.col(label).try_cast("int")).withColumn(day, F.coalesce(F.col(day).try_cast("date"), F.lit(None).cast("date")))
    return out.filter(F.col(label).isNotNull() & F.col(day).isNotNull()).fillna("Unknown", subset=list(categories)) if categories else out.filter(F.col(label).isNotNull() & F.col(day).isNotNull())


def semi_scan(rows: DataFrame, parents: DataFrame, key: str, wanted: Column) -> DataFrame:
    """Rows whose parent meets the condition; the condition is pushed to the parents' scan, whose keys filter the rows'."""
    return rows.join(parents.filter(wanted).select(key), key, "left_semi")


def table_facts(df: DataFrame, name: str, day: str | None = None, today: Column | None = None) -> DataFrame:
    """One row: name, rows, columns (JSON), last valid day, and how many dates are invalid or lie in the future."""
    text = F.substring(F.col(day).cast("string"), 1, 10) if day else F.lit(None).cast("string")
    d, now = iso_date(text), today if today is not None else F.current_date()
    bad = (text.isNotNull() & d.isNull()) | (d > now)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.when(d <= now, d)).alias("last_day"),
        F.count_if(F.coalesce(bad, F.lit(False))).alias("bad_dates"),
    ).select(F.lit(name).alias("name"), "rows", F.to_json(F.array(*[F.lit(c) for c in df.columns])).alias("columns"), "last_day", "bad_dates")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files under a path, hashed where they lie."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def contract_status(facts: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, status) of each table a manifest lists: ok, missing, empty, columns, or dates. manifest: name, required (array of columns)."""
    joined = manifest.join(facts, "name", "left")
    have = F.from_json("columns", "array<string>")
    status = (
        F.when(F.col("rows").isNull(), "missing")
        .when(F.col("rows") == 0, "empty")
        .when(F.size(F.array_except("required", have)) > 0, "columns")
        .when(F.col("bad_dates") > 0, "dates")
        .otherwise("ok")
    )
    return joined.select("name", status.alias("status"))


def bundle_members(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, status, bytes) of a bundle's files against its manifest, as a set: ok, missing, unlisted, size or digest.

    found: (path, bytes, sha256) of files, as file_hashes gives them; manifest: (name, bytes, sha256), a name being the end of a path. A bundle is whole if all are ok.
    """
    files = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"))
    both = manifest.withColumn("_listed", F.lit(True)).join(files, "name", "full_outer")
    status = F.when(F.col("_listed").isNull(), "unlisted").when(F.col("_sha").isNull(), "missing").when(F.col("bytes") != F.col("_bytes"), "size").when(F.col("sha256") != F.col("_sha"), "digest").otherwise("ok")
    return both.select("name", status.alias("status"), F.col("_bytes").alias("bytes"))


def publish(df: DataFrame, root: str, name: str, checks: Sequence = ()) -> DataFrame:
    """Staged write: to <root>/_staging first, then each check (a function of the staged table that raises), then moved to <root>/<name>.

    The target must not exist. A failed check leaves the target alone and removes the stage.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    stage, target = hadoop(f"{root}/_staging/{name}"), hadoop(f"{root}/{name}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(f"{root}/{name}")
    df.write.mode("overwrite").parquet(stage.toString())
    try:
        for check in checks:
            check(spark.read.parquet(stage.toString()))
    except Exception:
        fs.delete(stage, True)
        raise
    if not fs.rename(stage, target):
        raise OSError(f"could not move {stage.toString()}")
    return spark.read.parquet(target.toString())
