"""Versions of tables, change detection, reuse of results, and an append-only ledger.

Every version of a table is a Parquet folder of its own. A manifest, itself a table, says which step made which version current.
What changed, what is current, what no step names and what may go are joins, groupings and filters over manifest rows. Atomic
commits, locks and the deletion of files are left to the table format of the lake.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .capture import chained
from .contracts import ContractError, require

MANIFEST = "step bigint, name string, version bigint, rows bigint, digest string, note string"


def content_digest(df: DataFrame) -> DataFrame:
    """One row: rows, and a digest of the table as a multiset: of names and types, the number of rows and two sums of row hashes."""
    names = sorted(df.columns)
    shape = str(sorted(df.dtypes))
    sums = [F.sum(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in names]).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(s, F.lit("0")).alias(f"s{i}") for i, s in enumerate(sums)])
    return one.select("rows", F.sha2(F.concat_ws("|", F.lit(shape), F.col("rows").cast("string"), "s0", "s1"), 256).alias("digest"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets of equally named and typed columns."""
    return content_digest(a).first() == content_digest(b).first()


def current_versions(manifest: DataFrame) -> DataFrame:
    """(name, version, rows, digest) that the last step of each table made current; a table that was taken back has a null version."""
    return manifest.groupBy("name").agg(F.max_by(F.struct("version", "rows", "digest"), "step").alias("m")).select("name", "m.*")


def prunable_versions(manifest: DataFrame, keep: int) -> DataFrame:
    """(name, version) that was current after none of the last `keep` steps."""
    numbered = manifest.withColumn("last", F.max("step").over(Window.partitionBy()))  # a manifest has a row for each change of a table
    since = F.col("last") - (keep - 1)
    before = numbered.filter(F.col("step") <= since).groupBy("name").agg(F.max_by("version", "step").alias("version"))
    needed = before.unionByName(numbered.filter(F.col("step") > since).select("name", "version"))
    return manifest.select("name", "version").filter("version is not null").distinct().join(needed, ["name", "version"], "left_anti")


def stray_versions(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Of the (name, version) that are found in storage, those that no step names, as a stopped update leaves them."""
    return found.join(manifest.select("name", "version"), ["name", "version"], "left_anti")


class Versions:
    """Tables below one folder, read and published through the manifest."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def path(self, name: str, version: int) -> str:
        return f"{self.root}/tables/{name}/v{version}"

    def read(self, name: str) -> DataFrame:
        row = current_versions(self.manifest()).filter(F.col("name") == name).first()
        if row is None or row.version is None:
            raise KeyError(name)
        return self.spark.read.parquet(self.path(name, row.version))

    def publish(self, tables: dict[str, DataFrame], checks: Sequence[Callable[[dict[str, DataFrame]], None]] = (), note: str = "") -> list[str]:
        """Writes the tables that differ as new versions, checks all tables as they would be, and then makes them current.

        Gives the names that changed. Readers see the whole step or none: a step counts from its manifest rows on, written in one
        file at the end. A check that raises leaves everything as it was; its folders are stray.
        """
        spark, manifest = self.spark, self.manifest()
        now = {r.name: r for r in current_versions(manifest).filter("version is not null").collect()}  # a row for each table
        facts = {n: content_digest(df).first() for n, df in tables.items()}
        changed = [n for n in tables if n not in now or now[n].digest != facts[n].digest]
        if not changed:
            return []
        step = (manifest.agg(F.max("step")).first()[0] or 0) + 1
        for n in changed:
            tables[n].write.mode("overwrite").parquet(self.path(n, step))
        staged = {n: spark.read.parquet(self.path(n, step if n in changed else now[n].version)) for n in {*now, *changed}}
        for check in checks:
            check(staged)
        rows = [(step, n, step, facts[n].rows, facts[n].digest, note) for n in changed]
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return changed

    def undo(self) -> None:
        """A new step with the versions from before the last one; nothing is lost."""
        manifest = self.manifest()
        last = manifest.agg(F.max("step")).first()[0]
        if last is None:
            raise ContractError("there is nothing to go back to")
        touched = manifest.filter(F.col("step") == last).select("name")
        old = current_versions(manifest.filter(F.col("step") < last))
        back = touched.join(old, "name", "left").select(F.lit(last + 1).alias("step"), "name", "version", "rows", "digest", F.lit("undo").alias("note"))
        self.spark.createDataFrame(back.collect(), MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")  # a row for each table of one step

    def found(self) -> DataFrame:
        """(name, version) of the folders that are there, from the listing of their files."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{self.root}/tables").select("path")
        part = lambda i: F.regexp_extract("path", r"/tables/([^/]+)/v(\d+)/[^/]+$", i)
        return files.select(part(1).alias("name"), part(2).cast("bigint").alias("version")).distinct()

    def rebuild(self, steps: Sequence[tuple[str, Callable[[Versions], DataFrame]]]) -> list[str]:
        """Publishes derived tables one after another, each from what is current by then; the first failure stops the rest."""
        return [n for name, make in steps for n in self.publish({name: make(self)}, note=f"rebuild {name}")]

    def cached(self, kind: str, inputs: dict[str, DataFrame], compute: Callable[[], DataFrame]) -> DataFrame:
        """The stored result of this kind for inputs of this content; computed and published if there is none."""
        name = f"cache-{content_key(kind, inputs)}"
        try:
            return self.read(name)
        except KeyError:
            self.publish({name: compute()}, note=kind)
            return self.read(name)


def content_key(kind: str, inputs: dict[str, DataFrame]) -> str:
    """A key that changes when the kind or the content of any input does: from one digest row for each input."""
    parts = [kind, *[f"{n}={content_digest(df).first().digest}" for n, df in sorted(inputs.items())]]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def change_map(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of two listings (path, sha256): added, removed, changed or same."""
    both = before.select("path", F.col("sha256").alias("_b")).join(after.select("path", F.col("sha256").alias("_a")), "path", "full_outer")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_b") != F.col("_a"), "changed").otherwise("same")
    return both.select("path", change.alias("change"))


def result_index(known: DataFrame, files: DataFrame, fields: str) -> DataFrame:
    """The index of saved results (path, sha256, and the fields of their JSON): entries of unchanged files are kept, the others read anew.

    files: (path, content). Files that are no JSON of these fields, or lack the first of them, have no entry; entries of files that are gone go.
    """
    hashed = files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), F.col("content").cast("string").alias("text"))
    kept = known.join(hashed.select("path", "sha256"), ["path", "sha256"], "left_semi")
    fresh = hashed.join(known.select("path", "sha256"), ["path", "sha256"], "left_anti").select("path", "sha256", F.from_json("text", fields).alias("j"))
    read = fresh.select("path", "sha256", "j.*")
    first = next(c for c in read.columns if c not in ("path", "sha256"))
    return kept.unionByName(read.filter(F.col(first).isNotNull()))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; a NaN or an infinity anywhere raises before anything is written."""
    bad = F.lit(False)
    for c, t in df.dtypes:
        if t in ("double", "float"):
            bad = bad | F.coalesce(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(False))
    require(df.filter(bad), "numbers that JSON lacks")
    df.write.mode(mode).json(path)


def append_ledger(ledger: DataFrame, new: DataFrame, chain: str, order: str, payload: Sequence[str], deadline: Column | None = None) -> DataFrame:
    """Ledger rows to append: of `new`, what isn't there yet by (chain, order), linked to each chain's last row.

    A row already there with other content raises; one past its deadline raises too.
    """
    keys = [chain, order]
    if deadline is not None:
        require(new.filter(~F.coalesce(deadline, F.lit(False))).select(*keys), "past its deadline")
    known = ledger.select(*keys, *[F.col(c).alias(f"_{c}") for c in payload])
    both = new.join(known, keys)
    differs = F.lit(False)
    for c in payload:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    require(both.filter(differs).select(*keys), "already recorded with other content")
    fresh = new.join(ledger.select(*keys), keys, "left_anti")
    last = ledger.groupBy(chain).agg(F.max(order).alias("_last"), F.max_by("payload_hash", order).alias("_hash"))
    require(fresh.join(last, chain).filter(F.col(order) <= F.col("_last")).select(*keys), "out of order")
    linked = chained(fresh.select(*keys, *payload), chain, order, payload).join(last, chain, "left")
    return linked.withColumn("previous_hash", F.when(F.col("previous_hash") == "", F.coalesce("_hash", F.lit(""))).otherwise(F.col("previous_hash"))).drop("_last", "_hash")


def recovery_actions(journal: DataFrame) -> DataFrame:
    """(transaction, status, action) from a journal (transaction, at, status, alive): what is to be done about each transaction after a stop.

    A transaction's last row is its state; alive says whether its process still runs. staging, committing and recovery_required: `refuse` while the
    process runs, else `restore` what stood before. committed: `may_restore` if it is the last one that was, else `keep`. rolled_back: `none`. Anything else is `unknown`.
    """
    last = journal.groupBy("transaction").agg(F.max_by(F.struct("status", "alive", "at"), "at").alias("l")).select("transaction", "l.*")
    newest = last.filter("status = 'committed'").agg(F.max("at").alias("_newest"))  # one row
    open_ = F.col("status").isin("staging", "committing", "recovery_required")
    action = F.when(open_ & F.coalesce("alive", F.lit(False)), "refuse").when(open_, "restore").when(F.col("status") == "rolled_back", "none")
    action = action.when((F.col("status") == "committed") & (F.col("at") == F.col("_newest")), "may_restore").when(F.col("status") == "committed", "keep").otherwise("unknown")
    return last.crossJoin(newest).select("transaction", "status", action.alias("action"))


def sealed(report: DataFrame) -> DataFrame:
    """A report with `integrity` in each row: the digest of all its rows, as a multiset."""
    return report.crossJoin(content_digest(report).select(F.col("digest").alias("integrity")))  # one row


def seal_faults(report: DataFrame, bounds: dict[str, tuple[float | None, float | None]], item: str = "item", value: str = "value") -> DataFrame:
    """(item, fault) of a sealed report: `integrity` for every row if the content isn't what was sealed, `bounds` where a named item's value is outside its
    bounds (each end may be open) or null. A report without faults may be used."""
    now = content_digest(report.drop("integrity")).select(F.col("digest").alias("_now"))
    low, high = (F.create_map(*[x for k, v in bounds.items() for x in (F.lit(k), F.lit(v[i]).cast("double"))]) if bounds else F.create_map().cast("map<string,double>") for i in (0, 1))
    v = F.col(value).cast("double")
    known = F.array_contains(F.map_keys(low), F.col(item))
    outside = known & (v.isNull() | F.isnan(v) | F.coalesce(v < F.try_element_at(low, F.col(item)), F.lit(False)) | F.coalesce(v > F.try_element_at(high, F.col(item)), F.lit(False)))
    faults = F.array_compact(F.array(F.when(~F.col("integrity").eqNullSafe(F.col("_now")), "integrity"), F.when(outside, "bounds")))
    return report.crossJoin(now).select(item, F.explode(faults).alias("fault"))  # one row
