"""Exact n-gram Jaccard join by vertical partitioning.

All n-grams stand in one global order, rare ones first, cut into fragments. The first fragment of a document, as many
of its n-grams as a partner cannot miss altogether, finds candidates; for the candidates, the overlap of each fragment
is counted on its own and summed per pair.

Documents with the same set of n-grams are one class, and only classes are compared. Within the classes that share a
key, each is first compared with one hub, the class with the fewest rarer n-grams; links join classes into components;
then only classes that are still in another component than the hub's are compared with the rest. A pair within one
component needs no test for the components to be exact, so a large group of near copies costs about one test each.

A candidate pair must be able to reach the threshold: with sizes n and m its overlap must be at least t = ceil(s / (1 +
s) * (n + m)), so the shared key may stand no later than place n - t (m - t) of its document, and of the document whose
first fragment ends earlier, all keys of that fragment that no other document's has are lost to the overlap. Up to where the
earlier of two first fragments ends, the overlap is known from those fragments alone; with what can follow it must reach t.
Two documents that share an n-gram by chance fail there, so only near copies have their later fragments fetched and counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, Stage, gram_hashes, joined_chunks, mix, numbered, signed, slices, summed_chunks, vector_rows, words
from .components import components

SKETCH_BITS = 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each document, end to end, and the offsets. Fewer than n words are one gram."""
    w = words(data, offsets)
    counts = w.count
    n_docs = len(counts)
    grams = gram_hashes(w.hash, n)
    last = w.first[1:] - n  # of each document's grams
    owner = w.doc()
    whole = np.zeros(len(grams), bool)
    if len(grams):
        whole[:] = np.arange(len(grams)) <= last[owner[: len(grams)]]
    parts_h, parts_o = [grams[whole]], [owner[: len(grams)][whole]]
    for d in np.flatnonzero((counts > 0) & (counts < n)):
        h = w.hash[w.first[d] : w.first[d + 1]]
        parts_h.append(gram_hashes(h, len(h), seed=len(h)))
        parts_o.append(np.array([d]))
    h, o = np.concatenate(parts_h), np.concatenate(parts_o)
    if len(parts_h) > 1:
        order = np.argsort(o, kind="stable")
        h, o = h[order], o[order]
    sort_each(h, np.searchsorted(o, np.arange(n_docs + 1)))
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[keep], np.concatenate([[0], np.cumsum(np.bincount(o[keep], minlength=n_docs))])


def sort_each(x: np.ndarray, offsets: np.ndarray) -> None:
    """Sorts each document's part of x in place."""
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        x[lo:hi].sort()


def set_ids(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit id of each document's set; 0 for an empty one."""
    total = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(mix(grams + np.uint64(0x2545F4914F6CDD1D)), out=total[1:])
    n = np.diff(offsets).astype(np.uint64)
    ids = mix((total[offsets[1:]] - total[offsets[:-1]]) * np.uint64(0x9FB21C651E98DF25) + n)
    ids[n == 0] = 0
    return ids


def gram_sketch(docs: DataFrame, n: int) -> np.ndarray:
    """How often n-grams occur, in 2 ** SKETCH_BITS counters by their first bits; covers all documents, of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for _, data, offsets in slices(batches, "text"):
            grams = shingle_sets(data, offsets, n)[0]
            counts += np.bincount((grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
        yield from vector_rows(counts)

    return joined_chunks(summed_chunks(docs.select("text").mapInArrow(run, "chunk int, data binary"), "int64", total=True), 1 << SKETCH_BITS, "int64")


def order_classes(sketch: np.ndarray) -> np.ndarray:
    """Per counter 0 for n-grams that aren't known to be frequent, else the logarithm of the count."""
    usual = 4 * sketch.mean() + 16
    return np.where(sketch > usual, np.minimum(np.log2(np.maximum(sketch, 1)), 31), 0).astype(np.uint64)  # keys are compared as signed numbers


def ordered_keys(grams: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Place of each n-gram in the global order: its class, then 58 bits of its hash."""
    return (classes[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] << np.uint64(58)) | (mix(grams) >> np.uint64(6))


def _overlap_needed(n: Column, m: Column, s: int) -> Column:
    """Least overlap of two sets of these sizes with 100 * overlap >= s * union."""
    return F.ceil((n + m) * F.lit(s) / F.lit(100 + s) - F.lit(1e-9))


class _Join:
    def __init__(self, df: DataFrame, id_col: str, text_col: str, n: int, threshold: int):
        self.docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        self.kind = dict(df.dtypes)[id_col]
        self.n, self.s = n, threshold
        self.stage = Stage(df.sparkSession, "jaccard")
        self.spark = df.sparkSession
        self.order = self.spark.sparkContext.broadcast(order_classes(gram_sketch(self.docs, n)))

    def first_fragments(self) -> DataFrame:
        """(id, size, cls, keys) of every document: the keys that a partner cannot miss altogether, in order."""
        n, s, order = self.n, self.s, self.order

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, data, offsets in slices(batches, "text"):
                grams, at = shingle_sets(data, offsets, n)
                sizes = np.diff(at)
                keys = ordered_keys(grams, order.value)
                sort_each(keys, at)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(keys)) - at[:-1][owner]
                first = place < (sizes - -(-s * sizes // 100) + 1)[owner]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=len(sizes)))]).astype(np.int32)), signed(keys[first]))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sizes), signed(set_ids(grams, at)), lists], ["id", "size", "cls", "keys"])

        return self.stage.write(self.docs.mapInArrow(run, f"id {self.kind}, size bigint, cls bigint, keys array<bigint>"), "sets")

    def shared_keys(self, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Keys that the first fragments of two classes have: (key, cls, size, place, lost, ends) with the classes' figures, and
        (cls, size, n_keys, ends, held): such keys by class."""
        reps = sets.filter("size > 0").groupBy("cls").agg(F.first(F.struct("size", "keys")).alias("x")).select("cls", "x.size", "x.keys")
        reps = self.stage.write(reps.withColumns({"n_keys": F.size("keys"), "ends": F.element_at("keys", -1)}), "classes")
        self.stage.drop("sets")
        rows = reps.select("cls", F.posexplode("keys").alias("place", "key"))
        # written first, as other aggregates below: with plain shuffles on both sides, a join can split a very common key
        twice = self.stage.write(rows.groupBy("key").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1").select("key"), "twice")
        held = self.stage.write(rows.join(twice.hint("merge"), "key"), "held")
        self.stage.drop("twice")
        found = held.groupBy("cls").agg(F.collect_list("key").alias("held"))  # of one class: no more than its first fragment
        facts = self.stage.write(reps.select("cls", "size", "n_keys", "ends").join(found.hint("merge"), "cls"), "facts")
        self.stage.drop("classes")
        shared = held.join(facts.select("cls", "size", (F.col("n_keys") - F.size("held")).alias("lost"), "ends").hint("merge"), "cls")
        shared = self.stage.write(shared, "shared")
        self.stage.drop("held")
        return shared, facts

    def plausible(self, pairs: DataFrame, facts: DataFrame, name: str) -> DataFrame:
        """Drops pairs that their first fragments rule out: their overlap up to the end of the earlier one, and what can follow it."""
        side = lambda c: facts.select(F.col("cls").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n_keys", "ends", "held")])
        both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
        end = F.least("ends_a", "ends_b")
        after = lambda c: F.col(f"n{c}") - F.when(F.col(f"ends_{c}") == end, F.col(f"n_keys_{c}")).otherwise(F.size(F.filter(f"held_{c}", lambda k: k <= end)))
        most = F.size(F.array_intersect("held_a", "held_b")) + F.least(after("a"), after("b"))
        return self.stage.write(both.filter(most >= _overlap_needed(F.col("na"), F.col("nb"), self.s)).select("a", "b", "na", "nb"), f"pairs-{name}")

    def possible(self, a: str, b: str) -> Column:
        x, y = F.col(a), F.col(b)
        t = _overlap_needed(x["size"], y["size"], self.s)
        mine, other = x["lost"] + t <= x["size"], y["lost"] + t <= y["size"]
        lost = F.when(x["ends"] < y["ends"], mine).when(x["ends"] > y["ends"], other).otherwise(mine & other)
        return (x["cls"] != y["cls"]) & (x["place"] + t <= x["size"]) & (y["place"] + t <= y["size"]) & lost

    def pairs(self, joined: DataFrame) -> DataFrame:
        sides = F.array_sort(F.array(F.struct("x.cls", "x.size"), F.struct("y.cls", "y.size")))
        return joined.filter(self.possible("x", "y")).select(sides.alias("p")).distinct().select(F.col("p")[0]["cls"].alias("a"), F.col("p")[1]["cls"].alias("b"), F.col("p")[0]["size"].alias("na"), F.col("p")[1]["size"].alias("nb"))

    def sets_of(self, pairs: DataFrame, name: str) -> DataFrame:
        """(cls, keys in order) of the classes in pairs.

        Each task gives a class once; a key filter of bounded size tells which classes are wanted.
        """
        wanted = self.stage.write(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), f"wanted-{name}")
        chosen = self.spark.sparkContext.broadcast(KeyFilter.of(wanted, "cls", wanted.count()))
        n, order = self.n, self.order

        def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            given = np.zeros(0, np.uint64)
            for _, data, offsets in slices(batches, "text"):
                grams, at = shingle_sets(data, offsets, n)
                ids = set_ids(grams, at)
                new = np.flatnonzero(chosen.value.hits(ids) & ~np.isin(ids, given) & (ids != 0))
                new = new[np.unique(ids[new], return_index=True)[1]]
                if not len(new):
                    continue
                given = np.union1d(given, ids[new])
                keys = ordered_keys(np.concatenate([grams[at[d] : at[d + 1]] for d in new]), order.value)
                ends = np.concatenate([[0], np.cumsum(np.diff(at)[new])])
                sort_each(keys, ends)
                yield pa.RecordBatch.from_arrays([signed(ids[new]), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), signed(keys))], ["cls", "keys"])

        return self.stage.write(self.docs.select("text").mapInArrow(give, "cls bigint, keys array<bigint>").groupBy("cls").agg(F.first("keys").alias("keys")), f"sets-{name}")

    def links(self, pairs: DataFrame, sets: DataFrame, name: str, fragments: int = 8) -> DataFrame:
        """(a, b, o): the pairs whose overlap o, counted fragment by fragment and summed, reaches the threshold.

        A fragment is a stretch of the global order: a seventh of the n-grams not known as frequent, or the frequent ones.
        """

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = b.column("keys")
                at = lists.offsets.to_numpy().astype(np.int64)
                keys = lists.values.to_numpy()[at[0] : at[-1]].view(np.uint64)
                step = (1 << 58) // (fragments - 1) + 1
                slot = np.repeat(np.arange(len(lists)), np.diff(at)) * fragments + np.minimum(keys // np.uint64(step), fragments - 1).astype(np.int64)
                counts = np.bincount(slot, minlength=len(lists) * fragments)
                some = np.flatnonzero(counts)
                ends = np.concatenate([[0], np.cumsum(counts[some])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("cls").take(pa.array(some // fragments)), pa.array((some % fragments).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), signed(keys))], ["cls", "part", "keys"])

        segments = sets.mapInArrow(cut, "cls bigint, part int, keys array<bigint>")
        left = pairs.join(segments.withColumnsRenamed({"cls": "a", "keys": "ka"}).hint("merge"), "a")
        overlap = left.join(segments.withColumnsRenamed({"cls": "b", "keys": "kb"}).hint("merge"), ["b", "part"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ka", "kb")).alias("o"))
        total = overlap.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
        found = self.stage.write(total.filter(F.col("o") * 100 >= self.s * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b", "o"), f"links-{name}")
        self.stage.drop(f"sets-{name}")
        return found

    def verified(self, pairs: DataFrame, facts: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b, na, nb) that link, as (a, b, o): o is the overlap."""
        pairs = self.plausible(pairs, facts, name)
        return self.links(pairs, self.sets_of(pairs, name), name)

    def link_counts(self) -> DataFrame:
        """One row per document: id, n_shingles, class_id, n_links."""
        fragments = self.first_fragments()
        sets = self.stage.write(fragments.select("id", "size", "cls"), "ids")
        shared, facts = self.shared_keys(fragments)
        row = F.struct("cls", "size", "place", "lost", "ends")
        rows = self.stage.write(shared.select("key", row.alias("x")), "rows")
        both = rows.join(rows.select("key", F.col("x").alias("y")).hint("merge"), "key").filter("x.cls < y.cls")
        found = self.verified(self.stage.write(self.pairs(both), "met-all"), facts, "all")
        classes = self.stage.write(sets.filter("size > 0").groupBy("cls").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("members")), "members")
        ends = found.select(F.explode(F.array(F.struct(F.col("a").alias("cls"), F.col("b").alias("other")), F.struct(F.col("b").alias("cls"), F.col("a").alias("other")))).alias("e")).select("e.*")
        others = ends.join(classes.select(F.col("cls").alias("other"), "members"), "other").groupBy("cls").agg(F.sum("members").alias("others"))
        answers = self.stage.write(classes.join(others, "cls", "left").select("cls", "class_id", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "answers")
        out = sets.join(answers, "cls", "left")
        return out.select("id", F.col("size").alias("n_shingles"), F.when(F.col("size") == 0, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))

    def result(self) -> DataFrame:
        fragments = self.first_fragments()
        sets = self.stage.write(fragments.select("id", "size", "cls"), "ids")
        shared, facts = self.shared_keys(fragments)
        row = F.struct("cls", "size", "place", "lost", "ends")
        # every class against the hub of each of its keys: the one with the fewest rarer keys
        hubs = self.stage.write(shared.groupBy("key").agg(F.min(F.struct("place", "cls", "size", "lost", "ends")).alias("y")), "hubs")
        pairs = self.stage.write(self.pairs(shared.select("key", row.alias("x")).join(hubs.hint("merge"), "key")), "met-hub")
        self.stage.drop("hubs")
        first = self.verified(pairs, facts, "hub")
        roots = self.stage.write(components(first, self.stage, "first"), "first-roots")
        # what is still in another component than its hub, against all that share the key
        marked = shared.join(roots.hint("merge"), shared.cls == roots.node, "left").select("key", row.alias("x"), F.coalesce("root", "cls").alias("root"))
        marked = self.stage.write(marked, "marked")
        self.stage.drop("shared")
        mixed = marked.groupBy("key").agg(F.min(F.struct("x.place", "x.cls", "root")).alias("hub"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key", F.col("hub.root").alias("hub_root"))
        mixed = self.stage.write(mixed, "mixed")
        inside = self.stage.write(marked.join(mixed.hint("merge"), "key"), "open")
        self.stage.drop("marked")
        apart = inside.filter("root <> hub_root").select("key", "x", "root")
        rest = apart.join(inside.select("key", F.col("x").alias("y"), F.col("root").alias("other")).hint("merge"), "key").filter("root <> other")
        pairs = self.stage.write(self.pairs(rest), "met-rest")
        self.stage.drop("open")
        second = self.verified(pairs, facts, "rest")
        roots = self.stage.write(components(first.unionByName(second), self.stage, "all"), "roots")

        classes = sets.filter("size > 0").groupBy("cls").agg(F.min("id").alias("leader"))
        classes = classes.join(roots, classes.cls == roots.node, "left").select("cls", "leader", F.coalesce("root", "cls").alias("root"))
        classes = self.stage.write(classes, "class-roots")
        lowest = self.stage.write(classes.groupBy("root").agg(F.min("leader").alias("component")), "lowest")
        classes = self.stage.write(classes.join(lowest, "root").select("cls", "component"), "answers")
        return sets.select("id", "size", "cls").join(classes, "cls", "left").select("id", F.col("size").alias("n_shingles"), F.when(F.col("size") == 0, F.col("id")).otherwise(F.col("component")).alias("component_id"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id: the smallest id reachable by links, its own included.

    Two documents link when 100 * |A and B| >= threshold * |A or B| for their sets of distinct n-word shingles of the
    lower-cased (A-Z) text. Fewer than n words are one shingle. A null text, or one without words, has an empty set and
    links with nothing. Shingles and sets are 64-bit hashes. Null ids don't count as the smallest unless all are null;
    repeated rows are linked with one another and each is returned. Texts of any length are read whole; a document's set stays in
    one row, 8 bytes a shingle. An empty table gives an empty result; other columns are ignored.
    """
    return _Join(df, id_col, text_col, n, threshold).result().withColumnRenamed("id", id_col)


def jaccard_link_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, class_id (the least id with the same set) and n_links: how many other documents it links with.

    Links are those of jaccard_components; equal sets count, texts without words have none. Every pair of different sets that may link is
    verified, so the work grows with the number of links: quadratic in a group of near copies, where jaccard_components is linear.
    Nulls and repeated rows are treated as there.
    """
    return _Join(df, id_col, text_col, n, threshold).link_counts().withColumnRenamed("id", id_col)


def keep_one_per_component(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: int = 80) -> DataFrame:
    """One row of each component, with all its columns: the one with the least id, nulls last; of rows with that id, one.

    Rows are told apart by number, not by id: where an id occurs twice with different texts, each stays or goes on its own. Rows
    without words are each a component of their own and stay.
    """
    stage = Stage(df.sparkSession, "keep-one")
    rows = numbered(df, stage)
    doc_id = F.col("doc")[id_col]
    keyed = rows.select(F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), "row").alias("key"), F.col("doc")[text_col].alias("text"))
    kept = jaccard_components(keyed, "key", "text", n, threshold).filter(F.col("key") == F.col("component_id")).select("key.row")
    return rows.join(kept, "row", "left_semi").select("doc.*")
