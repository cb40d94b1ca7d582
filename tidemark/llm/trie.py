"""Conversation prefix trie: nodes from running digests, totals of subtrees by leaf peeling.

A node is a distinct sequence of first turns. Texts are read once, for two 64-bit digests of each turn; from then on only
narrow rows move. A node's key is the running xor of digests of (place, turn), so a conversation's path is a window over its
own rows and the trie is one aggregation of all paths.

Totals of subtrees are passed as messages: a node holds how many of its children have not reported; one that waits for
none is complete and sends its totals to its parent, and so on until only the root finishes. A run of nodes with one child each
is one link, so that a long tail costs no rounds: there are as many rounds as branchings on the deepest path. Each round writes what is still
open; messages to one parent are added up before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage

#: So many neighbouring conversation ids are put together as text before they are hashed in order.
ID_BLOCK = 1024

NODE = ["depth", "k1", "k2"]


def turn_digests(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, a, b, chars): each turn's place in its conversation from 1, two digests of role and text, code points of the text.

    Turns are ordered by turn_col, null first; turns of equal number by their digests, so repeated rows may stand in any order. A null role or text
    is empty. Rows without a conversation are left out.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = df.select(F.col(f"`{conv_col}`").cast("bigint").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), F.length(text).cast("bigint").alias("chars"))
    place = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "a", "b"))
    return rows.filter("conv is not null").select("conv", place.alias("place"), "a", "b", "chars")


def with_shared_starts(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """(conv, part, place, a, b, chars): every conversation rebuilt. turns: rows of turn_digests, written.

    Conversation c takes h = crc32(c as decimal) % most first turns of conversation c - c % every (all if it has fewer, none if it is
    absent), then its own turns after its first h. Order by part and place. A row with part -1 opens each conversation, also one without turns.
    """
    convs = turns.select("conv").distinct()
    h = lambda c: F.crc32(c.cast("string").cast("binary")) % most
    own = turns.filter(F.col("place") > h(F.col("conv"))).select("conv", F.lit(1).alias("part"), "place", "a", "b", "chars")
    first = turns.filter((F.col("conv") % every == 0) & (F.col("place") < most)).withColumnRenamed("conv", "base")
    asked = convs.select("conv", (F.col("conv") - F.col("conv") % every).alias("base"), h(F.col("conv")).alias("h")).filter("h > 0")
    lent = asked.join(first, "base").filter("place <= h").select("conv", F.lit(0).alias("part"), "place", "a", "b", "chars")
    zero = F.lit(0).cast("bigint")
    opened = convs.select("conv", F.lit(-1).alias("part"), F.lit(0).alias("place"), zero.alias("a"), zero.alias("b"), zero.alias("chars"))
    return own.unionByName(lent).unionByName(opened)


def opened(turns: DataFrame) -> DataFrame:
    """(conv, part, place, a, b, chars) of conversations as they are, with the row that opens each."""
    zero = F.lit(0).cast("bigint")
    return turns.withColumn("part", F.lit(1)).unionByName(turns.select("conv").distinct().select("conv", F.lit(-1).alias("part"), F.lit(0).alias("place"), zero.alias("a"), zero.alias("b"), zero.alias("chars")))


def _paths(rows: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, p1, p2, chars, len): the nodes on each conversation's path and their parents' keys; the root's key is 0, 0."""
    w = Window.partitionBy("conv").orderBy("part", "place")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({"depth": (F.row_number().over(w) - 1).cast("bigint"), "len": (F.count(F.lit(1)).over(Window.partitionBy("conv")) - 1).cast("bigint")})
    own = lambda *c: F.when(F.col("depth") > 0, F.xxhash64(*c)).otherwise(F.lit(0).cast("bigint"))
    out = out.withColumns({"e1": own("a", "b", "depth"), "e2": own("depth", "b", "a")})
    out = out.withColumns({"k1": F.bit_xor("e1").over(so_far), "k2": F.bit_xor("e2").over(so_far)})
    return out.select("conv", *NODE, F.col("k1").bitwiseXOR(F.col("e1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("e2")).alias("p2"), "chars", "len")


def _end_digests(paths: DataFrame) -> DataFrame:
    """(node, ends_sha256): the hash of the ids of the conversations that end at a node, in order and joined by commas.

    Ids are put together by blocks of neighbours in many tasks; the hash itself runs through a node's blocks in order and holds none of them.
    """
    blocks = paths.filter("depth = len").groupBy(*NODE, F.floor(F.col("conv") / ID_BLOCK).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, hashlib.sha256()
        for b in batches:
            done = []
            for node, ids in zip(zip(*(b.column(c).to_pylist() for c in NODE), strict=True), b.column("ids"), strict=True):
                if node != key:
                    if key is not None:
                        done.append((*key, running.hexdigest()))
                    key, running = node, hashlib.sha256(ids.as_py().encode())
                else:
                    running.update(b"," + ids.as_py().encode())
            if done:
                yield _end_batch(done)
        if key is not None:
            yield _end_batch([(*key, running.hexdigest())])

    return blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block").mapInArrow(digest, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def _end_batch(rows: list[tuple]) -> pa.RecordBatch:
    *keys, sha = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in keys), pa.array(sha)], [*NODE, "ends_sha256"])


def _peeled(links: DataFrame, stage: Stage) -> DataFrame:
    """(rep, bottom, leaves, saved): totals of each link's subtree. links: rep, bottom, parent_rep, parent_bottom, remaining, leaves, saved."""
    now, k = stage.write(links, "round0"), 0
    while not now.isEmpty():
        complete, waiting = now.filter("remaining = 0"), now.filter("remaining > 0")
        sums = complete.filter("parent_rep is not null").groupBy("parent_rep", "parent_bottom").agg(F.count(F.lit(1)).alias("n"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        told = sums.withColumnsRenamed({"parent_rep": "rep", "parent_bottom": "bottom"})
        got = waiting.join(told, ["rep", "bottom"], "left").fillna(0, ["n", "more_leaves", "more_saved"])
        k += 1
        now = stage.write(got.select("rep", "bottom", "parent_rep", "parent_bottom", (F.col("remaining") - F.col("n")).alias("remaining"), (F.col("leaves") + F.col("more_leaves")).alias("leaves"), (F.col("saved") + F.col("more_saved")).alias("saved")), f"round{k}")
    return stage.spark.read.schema(now.schema).parquet(f"{stage.root}/round*").filter("remaining = 0").select("rep", "bottom", "leaves", "saved")


def prefix_trie(rows: DataFrame) -> DataFrame:
    """One row for each node of the trie of conversations, all counts bigint. rows: of opened() or with_shared_starts().

    conv_id: the smallest member; depth; parent_conv_id: the parent's conv_id, null for the root; n_convs: members; n_children; n_leaves: nodes without
    children in the subtree, the node included; saved_tokens: over the subtree, (n_convs - 1) * code points of a node's last text; ends_sha256:
    of the ids of the members that end here, in ascending order and joined by commas.

    Digests of 128 bits stand for sequences. An empty table has no node; a conversation without turns is a member of the root alone.
    Copies of a conversation, in whatever number, are members of the same nodes; they are counted before any shuffle. Texts may be of any length: only
    their digests move. The turns of one conversation meet in one task, which streams through them (about 60 bytes each, spilled where they
    don't fit). Ids must be integers.
    """
    stage = Stage(rows.sparkSession, "trie")
    paths = stage.write(_paths(rows), "paths")
    nodes = stage.write(
        paths.groupBy(*NODE).agg(
            F.count(F.lit(1)).alias("n_convs"),
            F.min("conv").alias("conv_id"),
            F.max(F.struct("len", "conv"))["conv"].alias("rep"),  # the longest member: all nodes of a run have the same
            F.any_value("p1").alias("p1"),
            F.any_value("p2").alias("p2"),
            ((F.count(F.lit(1)) - 1) * F.max("chars")).alias("saved_here"),
        ),
        "nodes",
    )
    counts = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    down = Window.partitionBy("rep").orderBy("depth")
    bottom = F.min(F.when(F.col("n_children") != 1, F.col("depth"))).over(down.rowsBetween(0, Window.unboundedFollowing))
    above = F.sum("saved_here").over(Window.partitionBy("rep", "bottom").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1))
    linked = nodes.join(counts, NODE, "left").fillna(0, ["n_children"]).withColumn("bottom", bottom).withColumn("above", F.coalesce(above, F.lit(0)))
    linked = stage.write(linked, "linked")

    links = linked.groupBy("rep", "bottom").agg(
        F.sum("saved_here").alias("saved"), F.max_by("n_children", "depth").alias("remaining"), F.min_by(F.struct((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")), "depth").alias("up")
    )
    links = stage.write(links.select("rep", "bottom", "saved", "remaining", F.when(F.col("remaining") == 0, 1).otherwise(0).cast("bigint").alias("leaves"), "up.*"), "links")
    ends_of = linked.filter("depth = bottom").select(*NODE, F.col("rep").alias("parent_rep"), F.col("bottom").alias("parent_bottom"))
    totals = _peeled(links.join(ends_of, NODE, "left").select("rep", "bottom", "parent_rep", "parent_bottom", "remaining", "leaves", "saved"), stage)

    ends = stage.write(_end_digests(paths), "ends")
    named = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = linked.join(totals, ["rep", "bottom"]).join(named, ["depth", "p1", "p2"], "left").join(ends, NODE, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), (F.col("saved") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
