"""Language model scoring by context-tree weighting over bytes.

A byte is eight binary decisions. Each decision, named by the bits before it in its byte, has its own context tree
over the preceding bytes, with a Krichevsky-Trofimov estimate at every context of depth 0 to DEPTH. The weighted
probability of a context is half its own estimate plus half the product of its children's; trained and frozen, this
gives each context a weight for its own estimate against the deeper ones. A context never seen in training ends the
tree: the deepest one seen takes its weight. Every document ends with a zero byte.

Counts cover the whole training corpus: each task counts its runs of DEPTH + 1 bytes, Spark sums them, and the tree
is built from the sums. Every distinct run of any document is scored once, against the whole tree, in the task that
builds the part of the tree it belongs to. The scores of the most frequent runs go to every task; those of all others
meet the documents in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, fold, mix, signed, slices, words

DEPTH = 5
END = np.uint64(0x9E6C63D0876A9A47)  # stands for the end token among word hashes
_LN_PI = float(np.log(np.pi))


class Tally:
    """Counts 64-bit keys. Holds the distinct keys only, and gives them up when there are too many."""

    def __init__(self, most: int = 1 << 21):
        self.keys, self.counts, self.held, self.most = [], [], 0, most

    def add(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(n)
        self.held += len(k)
        if self.held > self.most:
            k, n = self.merged()
            if len(k) > self.most // 2:
                yield k, n
                k, n = k[:0], n[:0]
            self.keys, self.counts, self.held = [k], [n], len(k)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        k, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        return k, np.bincount(at, np.concatenate(self.counts), len(k)).astype(np.int64)


def byte_runs(low: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all runs of depth + 1 bytes that end at a byte of a document or at its end, and each document's first."""
    n_docs = len(offsets) - 1
    lengths = np.diff(offsets)
    padded = np.zeros(len(low) + n_docs * (depth + 1), np.uint64)
    step = np.repeat(np.arange(n_docs) * (depth + 1) + depth, lengths)
    padded[np.arange(len(low)) + step] = low
    keys = padded.copy()
    for k in range(1, depth + 1):
        keys[k:] |= padded[:-k] << np.uint64(8 * k)
    scored = np.ones(len(keys), bool)
    starts = offsets[:-1] + np.arange(n_docs) * (depth + 1)
    scored[(starts[:, None] + np.arange(depth)).ravel()] = False
    return keys[scored], offsets[:-1] + np.arange(n_docs)


def _log_gamma_half(n: np.ndarray) -> np.ndarray:
    """ln Gamma(n + 1/2) of whole numbers."""
    small = np.array([lgamma(i + 0.5) for i in range(64)])
    x = np.maximum(n, 1) + 0.5
    large = (x - 0.5) * np.log(x) - x + 0.5 * log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < 64, small[np.minimum(n, 63).astype(np.int64)], large)


def _log_factorial(n: np.ndarray) -> np.ndarray:
    small = np.array([lgamma(i + 1) for i in range(64)])
    x = np.maximum(n, 1) + 1.0
    large = (x - 0.5) * np.log(x) - x + 0.5 * log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < 64, small[np.minimum(n, 63).astype(np.int64)], large)


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the KT probability of n0 zeros and n1 ones."""
    return _log_gamma_half(n0) + _log_gamma_half(n1) - _log_factorial(n0 + n1) - _LN_PI


def weigh(n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(ln weighted probability, weight of the own estimate); below: sum of the children's, None for leaves."""
    own = kt_log(n0, n1)
    if below is None:
        return own, np.ones(len(own))
    return np.logaddexp(own, below) - log(2), 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


def node_keys(runs: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run, its eight nodes at this depth (depth, context, bits so far) and the bit that follows."""
    symbol = runs & np.uint64(255)
    context = (runs >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)
    b = np.arange(8, dtype=np.uint64)
    prefix = (np.uint64(1) << b) | (symbol[:, None] >> (np.uint64(8) - b))
    bit = (symbol[:, None] >> (np.uint64(7) - b)) & np.uint64(1)
    return (np.uint64(depth) << np.uint64(56)) | (context[:, None] << np.uint64(8)) | prefix, bit


def parents(nodes: np.ndarray) -> np.ndarray:
    """The nodes one byte of context up."""
    depth = nodes >> np.uint64(56)
    context = (nodes >> np.uint64(8)) & ((np.uint64(1) << (np.uint64(8) * (depth - np.uint64(1)))) - np.uint64(1))
    return ((depth - np.uint64(1)) << np.uint64(56)) | (context << np.uint64(8)) | (nodes & np.uint64(255))


def blend(one: np.ndarray, p: np.ndarray, w: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The mixture one level up: NaN stands where no context was seen yet; the deepest one seen takes all the weight."""
    return np.where(seen, np.where(np.isnan(one), p, w * p + (1 - w) * one), one)


#: Rows of nodes have a node, rows of runs a key; ones: the eight mixtures of a run so far, as bytes of doubles.
PART = "node bigint, n0 bigint, n1 bigint, log_weighted double, key bigint, uses bigint, ones binary"
NODE = "node bigint, n0 bigint, n1 bigint, weight double, log_weighted double"


def _node_rows(nodes, n0, n1, log_weighted) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(nodes), 1 << 16):
        s = slice(lo, lo + (1 << 16))
        k = len(nodes[s])
        yield pa.RecordBatch.from_arrays([signed(nodes[s]), pa.array(n0[s]), pa.array(n1[s]), pa.array(log_weighted[s]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], ["node", "n0", "n1", "log_weighted", "key", "uses", "ones"])


def _run_rows(keys, uses, one) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(keys), 1 << 16):
        s = slice(lo, lo + (1 << 16))
        k, width = len(keys[s]), 8 * one.itemsize
        ones = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer((np.arange(k + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(one[s]))])
        yield pa.RecordBatch.from_arrays([*(pa.nulls(k, pa.int64()) for _ in range(3)), pa.nulls(k, pa.float64()), signed(keys[s]), pa.array(uses[s]), ones], ["node", "n0", "n1", "log_weighted", "key", "uses", "ones"])


def run_scores(runs: DataFrame, depth: int, stage: Stage, min_count: int = 1) -> DataFrame:
    """(key, uses, log10) of each run of (key, n, uses) under the tree that the counts n train; n may be 0.

    Contexts with the same last three bytes form whole subtrees from depth 3 down; they meet in one task, sorted, and
    are done one after another, with the runs that end there. At depth 5 a subtree has at most 256 ** 3 runs, whatever
    the corpus; in texts some thousands. Depths 2 to 0 follow by aggregation, and their nodes that were seen go to every task:
    at most 256 ** 2 * 255 of 24 bytes; texts have a few hundred thousand.
    """
    joint = min(3, depth)

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(keys: np.ndarray, n: np.ndarray, uses: np.ndarray) -> Iterator[pa.RecordBatch]:
            below, one = None, np.full((len(keys), 8), np.nan)
            for d in range(depth, joint - 1, -1):
                nodes, bits = node_keys(keys, d)
                nodes, at = np.unique(nodes.ravel(), return_inverse=True)  # those of runs without training stay at 0 and add ln 1 above
                weights = np.repeat(n, 8)
                n1 = np.bincount(at, weights * bits.ravel().astype(np.int64), len(nodes)).astype(np.int64)
                n0 = np.bincount(at, weights, len(nodes)).astype(np.int64) - n1
                if below is not None:
                    below = np.bincount(np.searchsorted(nodes, below[0]), below[1], len(nodes))
                lw, w = weigh(n0, n1, below)
                p, at = (n1 + 0.5) / (n0 + n1 + 1), at.reshape(-1, 8)
                one = blend(one, p[at], w[at], (n0 + n1 >= min_count)[at])
                if d == joint:
                    trained = n0 + n1 > 0
                    yield from _node_rows(nodes[trained], n0[trained], n1[trained], lw[trained])
                else:
                    below = (parents(nodes), lw)
            yield from _run_rows(keys, uses, one)

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in batches:
            keys, n, uses = b.column("key").to_numpy().view(np.uint64), b.column("n").to_numpy(), b.column("uses").to_numpy()
            last = (keys >> np.uint64(8)) & np.uint64((1 << 8 * joint) - 1)
            cut = int(np.searchsorted(last, last[-1])) if len(last) else 0  # the last context may go on in the next batch
            if held and (len(last) and (held[-1][0][-1] >> np.uint64(8)) & np.uint64((1 << 8 * joint) - 1) != last[0]) and sum(len(h[0]) for h in held) > 1 << 15:
                yield from whole(*map(np.concatenate, zip(*held, strict=True)))
                held = []
            if cut and sum(len(h[0]) for h in held) + cut > 1 << 15:
                held.append((keys[:cut], n[:cut], uses[:cut]))
                yield from whole(*map(np.concatenate, zip(*held, strict=True)))
                held, keys, n, uses = [], keys[cut:], n[cut:], uses[cut:]
            if len(keys):
                held.append((keys, n, uses))
        if held:
            yield from whole(*map(np.concatenate, zip(*held, strict=True)))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n0, n1 = b.column("n0").to_numpy(), b.column("n1").to_numpy()
            lw, w = weigh(n0, n1, b.column("below").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(n0), pa.array(n1), pa.array(w), pa.array(lw)], ["node", "n0", "n1", "weight", "log_weighted"])

    last = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << 8 * joint) - 1))
    parts = stage.write(runs.select("key", "n", "uses", last.alias("last")).repartition("last").sortWithinPartitions("last").select("key", "n", "uses").mapInArrow(subtrees, PART), "parts")
    level = parts.filter("node is not null").select("node", "n0", "n1", "log_weighted")
    top = []  # depths above joint: the nodes that were seen, in order, with estimate and weight
    for d in range(joint - 1, -1, -1):
        context = F.shiftrightunsigned("node", 8).bitwiseAND(F.lit((1 << 8 * d) - 1))
        up = F.lit(d << 56).bitwiseOR(F.shiftleft(context, 8)).bitwiseOR(F.col("node").bitwiseAND(F.lit(255)))
        level = stage.write(level.groupBy(up.alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log_weighted").alias("below")).mapInArrow(close, NODE), f"level{d}")
        seen = level.filter(F.col("n0") + F.col("n1") >= min_count)
        rows = seen.select(F.col("node").bitwiseAND(F.lit((1 << 8 * d + 8) - 1)).alias("node"), ((F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)).alias("p"), "weight").toArrow()  # 256 ** d * 255 nodes at most
        order = np.argsort(at := rows.column("node").to_numpy())
        top.append((d, at[order], rows.column("p").to_numpy()[order], rows.column("weight").to_numpy()[order]))
    frozen = stage.spark.sparkContext.broadcast(top)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("key").to_numpy().view(np.uint64)
            one = np.frombuffer(b"".join(b.column("ones").to_pylist()), np.float64).reshape(-1, 8)
            for d, known, p, w in frozen.value:
                nodes = (node_keys(keys, d)[0] & np.uint64((1 << 8 * d + 8) - 1)).astype(np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, nodes), len(known) - 1)
                    one = blend(one, p[at], w[at], known[at] == nodes)
            one = np.where(np.isnan(one), 0.5, one)
            bits = (keys[:, None] >> (np.uint64(7) - np.arange(8, dtype=np.uint64))) & np.uint64(1)
            value = np.log10(np.where(bits == 1, one, 1 - one)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("uses"), pa.array(value)], ["key", "uses", "log10"])

    scores = stage.write(parts.filter("key is not null").select("key", "uses", "ones").mapInArrow(finish, "key bigint, uses bigint, log10 double"), "run-scores")
    frozen.destroy()
    return scores


class RunTable:
    """Values of distinct runs, as an open-addressing table over two arrays that are used in place."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self.mask = keys, values, np.uint64(len(keys) - 1)

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> RunTable:
        size = 1 << max(4, int(np.ceil(np.log2(1.34 * len(keys) + 2))))
        table = cls(np.full(size, 2**64 - 1, np.uint64), np.zeros(size))  # depth + 1 < 8 bytes: no run is 2 ** 64 - 1
        left, slot = np.arange(len(keys)), mix(keys) & table.mask
        while len(left):
            free = table.keys[slot] == 2**64 - 1
            table.keys[slot[free]] = keys[left[free]]  # of several that want a slot, the last stays
            done = table.keys[slot] == keys[left]
            table.values[slot[done]] = values[left[done]]
            left, slot = left[~done], (slot[~done] + np.uint64(1)) & table.mask
        return table

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value of each run, 0 where it isn't in the table, and whether it is."""
        out, hit = np.zeros(len(keys)), np.zeros(len(keys), bool)
        left, slot = np.arange(len(keys)), mix(keys) & self.mask
        while len(left):
            there = self.keys[slot]
            found, on = there == keys[left], there != 2**64 - 1
            out[left[found]], hit[left[found]] = self.values[slot[found]], True
            on &= ~found
            left, slot = left[on], (slot[on] + np.uint64(1)) & self.mask
        return out, hit


def _counts(docs: DataFrame, depth: int) -> DataFrame:
    """(kind, key, n, uses), counted by task: hashes of words and the end token (kind 0), runs of bytes (1).

    n counts in training documents; uses counts runs in all documents. Tasks add up their own rows while these fit; what they give out is
    shuffled as it is, so that no second table of it stands in the JVM beside the workers: more is shuffled, less memory is taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = {(0, True): Tally(1 << 19), (1, True): Tally(1 << 20), (1, False): Tally(1 << 19)}  # by kind, and whether in training

        def rows(kind: int, train: bool, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(keys), 1 << 16):
                k, c = keys[lo : lo + (1 << 16)], n[lo : lo + (1 << 16)].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), signed(k), pa.array(c if train else 0 * c), pa.array(c)], ["kind", "key", "n", "uses"])

        for b, data, offsets in slices(batches, "text", 1 << 18):
            low = fold(data)
            w = words(low, offsets, folded=True)
            keys, first = byte_runs(low, offsets, depth)
            train = ~b.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            learned = np.repeat(train, np.diff(np.append(first, len(keys))))
            found = {(0, True): np.concatenate([w.hash[train[w.doc()]], np.full(int(train.sum()), END)]), (1, True): keys[learned], (1, False): keys[~learned]}
            for which, keys in found.items():
                for k, n in tallies[which].add(keys):
                    yield from rows(*which, k, n)
        for which, t in tallies.items():
            yield from rows(*which, *t.merged())

    found = docs.select("text", "held_out").mapInArrow(run, "kind int, key bigint, n bigint, uses bigint")
    return found.repartition("kind", "key").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses"))


def _threshold(counts: DataFrame, n: Column, most: int) -> int:
    """The least power of two that at most `most` rows reach."""
    sizes = {r.b: r["count"] for r in counts.groupBy(F.floor(F.log2(n.cast("double"))).alias("b")).count().collect()}  # 63 rows at most
    total, least = 0, 64
    for b in sorted(sizes, reverse=True):
        if (total := total + sizes[b]) > most:
            break
        least = b
    return 1 << least if least < 63 else 2**62


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, depth: int = DEPTH, min_count: int = 1, head_words: int = 1 << 18, head_runs: int = 1 << 21) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, code_length_per_byte.

    The models learn from the rows where held_out isn't true (default: crc32(id as text) mod 7 is 2). A null text is
    empty: it has its end token alone. A null id counts as not held out. Repeated rows are learned from and scored
    one by one. Without training rows every byte costs eight bits and all words are unknown.

    base_score: log10 of the add-one unigram probability of the words and the end token; words are counted by 64-bit
    hashes. Counts of the most frequent words and scores of the most frequent runs (head_words and head_runs at most,
    by a count threshold) go to every task; those of all others meet the documents in a join. The tree has every
    context seen; a greater min_count leaves out those seen less often. Texts of any length are scored whole; an empty table gives an
    empty result; other columns are ignored.
    """
    spark = df.sparkSession
    stage = Stage(spark, "ctw")
    if held_out is None:
        held_out = F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2
    kind = dict(df.dtypes)[id_col]
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))

    counts = stage.write(_counts(docs, depth), "counts")
    vocabulary, runs = counts.filter("kind = 0").select("key", "n"), counts.filter("kind = 1").select("key", "n", "uses")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    head = vocabulary.filter(F.col("n") >= _threshold(vocabulary, F.col("n"), head_words)).toArrow()  # head_words rows at most
    order = np.argsort(hk := head.column("key").to_numpy().view(np.uint64))
    head = hk[order], head.column("n").to_numpy()[order]

    scores = run_scores(runs, depth, stage, min_count)
    frequent = F.col("uses") >= _threshold(scores, F.col("uses"), head_runs)
    top = scores.filter(frequent).select("key", "log10").toArrow()  # head_runs rows at most
    table = RunTable.of(top.column("key").to_numpy().view(np.uint64), top.column("log10").to_numpy())
    frozen = spark.sparkContext.broadcast((table.keys, table.values, *head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (head_keys, head_n) = RunTable(*frozen.value[:2]), frozen.value[2:]
        for b, data, offsets in slices(batches, "text", 1 << 18):
            low = fold(data)
            keys, first = byte_runs(low, offsets, depth)
            values, hit = table.find(keys)
            score = np.add.reduceat(values, first)
            rare = np.concatenate([[0], np.cumsum(np.add.reduceat((~hit).astype(np.int64), first))]).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(rare), signed(keys[~hit]))
            w = words(low, offsets, folded=True)
            owner = np.concatenate([w.doc(), np.arange(b.num_rows)])
            h = np.concatenate([w.hash, np.full(b.num_rows, END)])
            at = np.minimum(np.searchsorted(head_keys, h), max(len(head_keys) - 1, 0))
            hit = head_keys[at] == h if len(head_keys) else np.zeros(len(h), bool)
            known = np.bincount(owner[hit], minlength=b.num_rows)
            base = np.bincount(owner[hit], np.log10(head_n[at[hit]] + 1.0), b.num_rows) if hit.any() else np.zeros(b.num_rows)
            order = np.argsort(owner[~hit], kind="stable")
            rest = np.concatenate([[0], np.cumsum(np.bincount(owner[~hit], minlength=b.num_rows))]).astype(np.int32)
            tail = pa.ListArray.from_arrays(pa.array(rest), signed(h[~hit][order]))
            values = [pa.array((w.count + 1).astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), pa.array((np.diff(offsets) + 1).astype(np.int64)), tail, rare]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), *values], ["id", "held_out", "n_tokens", "known", "base", "score", "n_bytes", "tail", "rare"])

    scored = docs.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, score double, n_bytes bigint, tail array<bigint>, rare array<bigint>")
    scored = stage.write(scored.withColumn("rid", F.monotonically_increasing_id()), "scored")
    frozen.destroy()  # worker processes let go of it
    # words (kind 0) and runs (1) that no task had at hand
    open_keys = scored.select("rid", F.lit(0).alias("kind"), F.explode("tail").alias("key")).unionByName(scored.select("rid", F.lit(1).alias("kind"), F.explode("rare").alias("key")))
    values = vocabulary.select(F.lit(0).alias("kind"), "key", F.log10(F.col("n") + 1).alias("value")).unionByName(scores.filter(~frequent).select(F.lit(1).alias("kind"), "key", F.col("log10").alias("value")))
    rest = open_keys.join(values, ["kind", "key"]).groupBy("rid").agg(*[F.sum(F.when(F.col("kind") == k, x)).alias(c) for k, x, c in ((0, F.lit(1), "more"), (0, F.col("value"), "more_base"), (1, F.col("value"), "more_score"))])
    out = scored.drop("tail", "rare").join(rest, "rid", "left").withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"),
        "score",
        (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("code_length_per_byte"),
    )
