"""Repeated passages by sparse suffix arrays.

Suffixes are kept at minimiser positions only: of every WINDOW consecutive word 5-grams the one with the least hash, so
that equal passages keep the same positions. A passage of `least` words has such a position among its first WINDOW
words, with at least least - WINDOW + 1 words of it to the right (its short context). A kept suffix stands for all windows
of `least` words whose minimiser it is; together they are its block, which reaches left to what the suffix before it
stands for, and right as far as the last of its windows.

The kept suffixes are sorted over all executors by content, and each is compared with its neighbours. Suffixes with the same
short context are a group. Where a whole group has one block, the match extends left and right over the block, and its windows
are settled together. Where blocks differ, an end of a passage lies within them: there the match is extended window by window,
as far to the left and right as the words are the same.

A window that occurs more than once is first at its least (id, word) and later at all others; first and later windows are merged
into spans apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KeyFilter, Stage, Words, fold, gram_hashes, mix, signed, slices, words

#: Words of a minimiser's gram; grams of which it is the least; bytes of a suffix that order it before its context's digest does.
GRAM, WINDOW, PREFIX = 5, 26, 24


def minimisers(h: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For words with these hashes, documents starting at first: the starts of all windows of `least` words, and each one's
    minimiser: the leftmost position with the least 5-gram hash among its first WINDOW."""
    counts = np.diff(first)
    n_starts = np.maximum(0, counts - least + 1)
    total = int(n_starts.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(n_starts)[:-1]]), n_starts) + np.arange(total)
    g = gram_hashes(h, GRAM, seed=5)
    best, at, reach = g.copy(), np.arange(len(g)), 1
    while reach < WINDOW:  # least of reach positions from each on, doubled
        step = min(reach, WINDOW - reach)
        nxt, nat = best[step:], at[step:]
        better = nxt < best[: len(nxt)]
        best[: len(nxt)][better] = nxt[better]
        at[: len(nat)][better] = nat[better]
        reach += step
    return starts, at[starts]


def _prefixes(low: np.ndarray, w: Words, at: np.ndarray) -> np.ndarray:
    """The first PREFIX bytes from each of these words on, one blank after each word: as rows of bytes. The documents go on for longer than that."""
    size = w.end - w.start + 1
    place = np.concatenate([[0], np.cumsum(size)])
    text = np.append(low, np.uint8(32))[np.repeat(w.start - place[:-1], size) + np.arange(place[-1])]
    text[place[1:] - 1] = 32
    return text[place[at][:, None] + np.arange(PREFIX)]


SUFFIX = "pos int, key binary, short bigint, block bigint, lo int, hi int, begin bigint, end bigint"


def _suffixes(docs: DataFrame, kind: str, least: int) -> DataFrame:
    """Each kept suffix: id, pos (its word), key (its first bytes), short (digest of its short context), block (digest of its block),
    lo and hi (its first and last window's first word), begin and end (the block's bytes)."""
    short = least - WINDOW + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offsets in slices(batches, "text", 1 << 20):
            low = fold(data)
            w = words(low, offsets, folded=True)
            starts, owner = minimisers(w.hash, w.first, least)
            if not len(starts):
                continue
            doc = np.searchsorted(w.first, starts, side="right") - 1
            cut = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])]))
            anchors, lo, hi, doc = owner[cut], starts[cut], starts[np.append(cut[1:], len(starts)) - 1], doc[cut]
            first = w.first[doc]
            s, f = gram_hashes(w.hash, short, seed=1), gram_hashes(w.hash, least, seed=2)
            # a block is told by its first and last window and how far its suffix is from them; they overlap or touch the suffix's words
            shape = ((anchors - lo) * 64 + (hi - lo)).astype(np.uint64)
            block = mix(mix(f[lo] + shape) ^ (f[hi] * np.uint64(0x9E3779B97F4A7C15)))
            rows = _prefixes(low, w, anchors)
            key = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * PREFIX).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])
            place = lambda x, first=first: pa.array((x - first).astype(np.int32))
            begin, end = w.start[lo] - offsets[doc], w.end[hi + least - 1] - offsets[doc]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(doc)), place(anchors), key, signed(s[anchors]), signed(block), place(lo), place(hi), pa.array(begin), pa.array(end)], ["id", "pos", "key", "short", "block", "lo", "hi", "begin", "end"])

    return docs.mapInArrow(run, f"id {kind}, {SUFFIX}")


def _groups(suffixes: DataFrame, kind: str, stage: Stage) -> DataFrame:
    """(short, first_id, first_pos, mixed) of the short contexts that more than one suffix has; mixed: their blocks differ.

    Suffixes are sorted by content over ranges of about equal size, so a very common one spreads over several tasks; each
    is compared with its neighbour. A run of equal contexts that may go on in the next range is settled from the
    first and last runs of all ranges: a few rows for each task.
    """
    split = suffixes.select("key", "short", "id", "pos", "block").repartitionByRange("key", "short", "id").sortWithinPartitions("key", "short", "id", "pos")
    names = ["short", "first_id", "first_pos", "last_id", "last_pos", "low", "high"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # the last run so far: short, first id and pos, last id and pos, least and greatest block
        at_edge, types = True, None

        def rows(found: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], names)

        for b in batches:
            h = b.column("short").to_numpy()
            if not len(h):
                continue
            types = [pa.int64(), b.schema.field("id").type, pa.int32(), b.schema.field("id").type, pa.int32(), pa.int64(), pa.int64()]
            starts = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
            ends = np.append(starts[1:], len(h)) - 1
            ids, pos, block = b.column("id").to_numpy(zero_copy_only=False), b.column("pos").to_numpy(), b.column("block").to_numpy()
            low, high = np.minimum.reduceat(block, starts), np.maximum.reduceat(block, starts)
            run = lambda i, starts=starts, ends=ends, h=h, ids=ids, pos=pos, low=low, high=high: [h[starts[i]], ids[starts[i]], pos[starts[i]], ids[ends[i]], pos[ends[i]], low[i], high[i]]
            found, begin = [], 0
            if held is not None and held[0] == h[0]:
                held[3:] = [ids[ends[0]], pos[ends[0]], min(held[5], low[0]), max(held[6], high[0])]
                begin = 1
            if begin < len(starts):
                if held is not None and (at_edge or held[1:3] != held[3:5]):
                    found.append(held)
                    at_edge = False
                inner = np.arange(begin, len(starts) - 1)
                alone = starts[inner] == ends[inner]
                if len(inner) and held is None:
                    alone[0], at_edge = False, False  # the range's first run
                found += [run(i) for i in inner[~alone]]
                held = run(len(starts) - 1)
            if found:
                yield rows(found)
        if held is not None:
            yield rows([held])

    found = stage.write(split.mapInArrow(compare, f"short bigint, first_id {kind}, first_pos int, last_id {kind}, last_pos int, low bigint, high bigint"), "runs")
    groups = found.groupBy("short").agg(F.min(F.struct("first_id", "first_pos")).alias("f"), F.max(F.struct("last_id", "last_pos")).alias("l"), F.min("low").alias("low"), F.max("high").alias("high"))
    several = (F.col("f.first_id") != F.col("l.last_id")) | (F.col("f.first_pos") != F.col("l.last_pos"))
    return stage.write(groups.filter(several).select("short", "f.first_id", "f.first_pos", (F.col("low") != F.col("high")).alias("mixed")), "groups")


def _windows(docs: DataFrame, mixed: DataFrame, kind: str, least: int, stage: Stage) -> DataFrame:
    """(id, hash, word, begin, end) of the windows that the suffixes of mixed groups (id, lo, hi) stand for.

    Their documents' texts meet them in a join. A key filter of bounded size keeps most others out of its shuffle; it decides nothing.
    """
    spans = stage.write(mixed.groupBy("id").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "mixed")  # of one document
    wanted = docs.sparkSession.sparkContext.broadcast(KeyFilter.of(spans.select(F.xxhash64("id").alias("k")), "k", spans.count()))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = pa.array(wanted.value.hits(b.column("k").to_numpy().view(np.uint64)))
            yield b.select(["id", "text"]).filter(hit)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offsets in slices(batches, "text", 1 << 20):
            w = words(data, offsets)
            f = gram_hashes(w.hash, least, seed=2)
            lists = b.column("spans")
            of = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            ranges = lists.flatten()
            lo, hi = ranges.field("lo").to_numpy() + w.first[of], ranges.field("hi").to_numpy() + w.first[of]
            hi = np.minimum(hi, w.first[of + 1] - least)  # where rows share an id, another text's windows may not fit
            n = np.maximum(0, hi - lo + 1)
            pick = np.unique(np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())) if n.sum() else np.zeros(0, np.int64)
            if not len(pick):
                continue
            doc = np.searchsorted(w.first, pick, side="right") - 1
            begin, end = w.start[pick] - offsets[doc], w.end[pick + least - 1] - offsets[doc]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(doc)), signed(f[pick]), pa.array((pick - w.first[doc]).astype(np.int32)), pa.array(begin), pa.array(end)], ["id", "hash", "word", "begin", "end"])

    texts = docs.select("id", "text", F.xxhash64("id").alias("k")).mapInArrow(pick, f"id {kind}, text string")
    met = texts.join(spans.hint("merge"), "id").select("id", "text", "spans")
    return stage.write(met.mapInArrow(cut, f"id {kind}, hash bigint, word int, begin bigint, end bigint"), "windows", "zstd")


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50) -> DataFrame:
    """One row per span of a document that consists of windows of `least` words which occur elsewhere too, in it or in another.

    Columns: id, start_byte, end_byte (of the UTF-8 text), start_word, n_words, first_id, kept. A window is kept where it occurs first:
    in the document with the smallest id, at the first word there. Spans with kept are maximal spans of windows kept here. The
    others are what is left of maximal spans of windows kept elsewhere, without the words of those kept here; they may be
    shorter than `least`, and begin or end with the space next to a kept word; first_id is the smallest id that keeps a part
    of them. Removing them leaves every repeated window whole where it is kept. Words are compared after
    lower-casing A-Z, by 64-bit hashes. A null or empty text, and one of fewer than `least` words, has no spans. Ids must be
    numbers; rows with a null id don't take part; rows with the same id are one document, and what they have at the same place
    doesn't count as repeated. Documents of any length are read whole. An empty table gives an empty result.
    """
    spark = df.sparkSession
    if least < WINDOW + GRAM:
        raise ValueError(f"least must be {WINDOW + GRAM} or more")
    stage = Stage(spark, "passages")
    kind = dict(df.dtypes)[id_col]
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    suffixes = stage.write(_suffixes(docs, kind, least), "suffixes", "zstd")
    groups = _groups(suffixes, kind, stage)
    # suffixes that are in a group; the key filter only keeps most others out of the shuffle
    grouped = spark.sparkContext.broadcast(KeyFilter.of(groups, "short", groups.count()))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(grouped.value.hits(b.column("short").to_numpy().view(np.uint64))))

    columns = "id", "pos", "short", "lo", "hi", "begin", "end"
    some = suffixes.select(*columns).mapInArrow(likely, f"id {kind}, pos int, short bigint, lo int, hi int, begin bigint, end bigint")
    members = stage.write(some.join(groups.hint("merge"), "short"), "members", "zstd")
    stage.drop("suffixes")
    stage.drop("runs")
    here = (F.col("first_id") == F.col("id")) & (F.col("first_pos") == F.col("pos"))
    whole = members.filter("not mixed").select("id", F.col("lo").alias("word"), (F.col("hi") + least).alias("end_word"), "begin", "end", "first_id", here.alias("kept"))

    windows = _windows(docs, members.filter("mixed").select("id", "lo", "hi"), kind, least, stage)
    both = windows.groupBy("hash").agg(F.min(F.struct("id", "word")).alias("f"), F.max(F.struct("id", "word")).alias("l")).filter((F.col("f.id") != F.col("l.id")) | (F.col("f.word") != F.col("l.word")))
    both = stage.write(both.select("hash", F.col("f.id").alias("first_id"), F.col("f.word").alias("first_word")), "shared")  # so that both sides of the join are shuffled, and a very common window can be split
    single = windows.join(both.hint("merge"), "hash").select("id", "word", (F.col("word") + least).alias("end_word"), "begin", "end", "first_id", ((F.col("first_id") == F.col("id")) & (F.col("first_word") == F.col("word"))).alias("kept"))

    # islands of overlapping or touching hits, document by document, those kept here and those kept elsewhere apart
    by = Window.partitionBy("id", "kept").orderBy("word", "end_word", "begin")
    reach = F.max("end_word").over(by.rowsBetween(Window.unboundedPreceding, -1))
    cut = whole.unionByName(single).withColumn("gap", F.when(F.col("word") <= reach, 0).otherwise(1)).withColumn("island", F.sum("gap").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    islands = cut.groupBy("id", "kept", "island").agg(F.min("begin").alias("start_byte"), F.max("end").alias("end_byte"), F.min("word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("first_id").alias("first_id"))
    islands = stage.write(islands.drop("island"), "islands")
    stage.drop("windows")
    stage.drop("members")
    # the edges of both kinds in order: what lies in an island of windows kept elsewhere and in none of those kept here
    ends = F.explode(F.array(F.struct(F.col("start_word").alias("word"), F.col("start_byte").alias("byte"), F.lit(1).alias("step")), F.struct(F.col("end_word").alias("word"), F.col("end_byte").alias("byte"), F.lit(-1).alias("step"))))
    edges = islands.select("id", "kept", "first_id", ends.alias("e"))
    opens = F.when(~F.col("kept") & (F.col("e.step") == 1), F.col("first_id"))
    edges = edges.groupBy("id", F.col("e.word").alias("word")).agg(F.sum(F.when(F.col("kept"), F.col("e.step")).otherwise(0)).alias("here"), F.sum(F.when(F.col("kept"), 0).otherwise(F.col("e.step"))).alias("elsewhere"), F.min("e.byte").alias("low"), F.max("e.byte").alias("high"), F.max(opens).alias("first_id"))
    on = Window.partitionBy("id").orderBy("word")
    so_far = on.rowsBetween(Window.unboundedPreceding, 0)
    parts = edges.select("id", "word", "high", F.sum("here").over(so_far).alias("here"), F.sum("elsewhere").over(so_far).alias("elsewhere"), F.lead("word").over(on).alias("next"), F.lead("low").over(on).alias("next_low"), F.last("first_id", True).over(so_far).alias("first_id"))
    later = parts.filter("here = 0 and elsewhere > 0").select("id", F.col("high").alias("start_byte"), F.col("next_low").alias("end_byte"), F.col("word").alias("start_word"), (F.col("next") - F.col("word")).alias("n_words"), "first_id", F.lit(False).alias("kept"))
    kept = islands.filter("kept").select("id", "start_byte", "end_byte", "start_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_id", F.lit(True).alias("kept"))
    return stage.write(kept.unionByName(later), "spans").withColumnRenamed("id", id_col)
