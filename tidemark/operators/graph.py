"""Connected components by alternating stars over written tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.twins import shared_root


class Steps:
    """Tables of one run in the shared folder: they cut lineage and outlive a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, shared_root(spark, name)

    def write(self, df: DataFrame, name: str | None = None, by: str | None = None) -> DataFrame:
        path = f"{self.root}/{name or uuid.uuid4().hex}"
        writer = df.write.partitionBy(by) if by else df.write
        writer.parquet(path)
        return self.read(name or path.rpartition("/")[2], df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{name}")


#: Edges that a task joins at once.
CHUNK = 1 << 18


def least_connected(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vertices in order, the place of the least one each is connected with, the place of each u): hooks larger roots on smaller ones until no edge is between two."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, least = at[: len(u)], at[len(u) :], np.arange(len(names))
    x, y = a, b
    while True:
        apart = least[x] != least[y]
        if not apart.any():
            return names, least, a
        x, y = x[apart], y[apart]
        np.minimum.at(least, np.maximum(least[x], least[y]), np.minimum(least[x], least[y]))
        while ((up := least[least]) != least).any():
            least = up


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (u, v) of a task, CHUNK at a time, as edges of each vertex to the least it is connected with there."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in "uv")
        names, least, _ = least_connected(u, v)
        hung = np.flatnonzero(least != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[hung]), pa.array(names[least[hung]])], ["u", "v"])

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= CHUNK:
            yield joined()
            held = []
    if held:
        yield joined()


def connected_components(edges: DataFrame, steps: Steps | None = None) -> DataFrame:
    """(vertex, component): for each vertex of edges (u bigint, v bigint) the smallest vertex it is connected with.

    Large and small stars take turns until nothing changes (Kiveris et al., 2014): every vertex hangs its larger neighbours, then its smaller ones, on
    the smallest. Before, each task puts what it reads together, so that no more edges are shuffled than its chunks have vertices. The number of rounds grows with the logarithm of the vertices. Minima are combined before they are shuffled and joined back, so no
    vertex's neighbours ever meet in one task. Loops and repeated edges do no harm; a vertex needs an edge (a loop, if it is alone) to be seen; edges with a null are left out.
    """
    steps = steps or Steps(edges.sparkSession, "components")
    clean = edges.select("u", "v").filter("u is not null and v is not null")
    alone = clean.filter("u = v").select(F.col("u").alias("vertex"))
    now = steps.write(clean.filter("u <> v").mapInArrow(_forest, "u bigint, v bigint").distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = steps.write(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = steps.write(least.select("u", F.col("m").alias("v")).unionByName(moved).distinct())
        last, state = state, now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.count_distinct("u")).first()
        if state == last and state[0] == state[2]:
            break
    hung = now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    found = hung.unionByName(roots)
    return found.unionByName(alone.distinct().join(found, "vertex", "left_anti").select("vertex", F.col("vertex").alias("component")))
