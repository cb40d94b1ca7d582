"""Ranked lexical search: windowed bucket scoring over an index of postings.

Documents are numbered as they are read and cut into windows of a fixed number. Of each window the index holds its postings by term.
To score, a task goes through its windows one by one: for each query it adds the contributions of the query's postings into an
array of one number for each document of the window, small enough for a processor's cache, marks which runs of 64 documents were
touched, and takes from these what beats the query's heap. Heaps of all tasks meet by query.

Terms are told by 64-bit hashes. The index holds the terms that a query has; all documents and whole texts are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, joined_chunks, slices, summed_chunks, vector_rows, words

#: Terms are runs of digits, letters and bytes above 0x7F; this marks all other bytes.
TERM_GAP = np.ones(256, dtype=bool)
TERM_GAP[0x30:0x3A] = TERM_GAP[0x41:0x5B] = TERM_GAP[0x61:0x7B] = TERM_GAP[0x80:] = False

#: Terms of queries that are searched for in one pass; more queries take more passes.
MOST_TERMS = 1 << 20

INDEX = "ids array<bigint>, lengths binary, terms binary, first binary, slots binary, times binary, n bigint, total bigint"


def _query_terms(items: DataFrame, id_col: str, text_col: str, stage: Stage) -> DataFrame:
    """(item, item_id, term): the distinct term hashes of each row of items; item numbers the rows."""
    kind = dict(items.dtypes)[id_col]
    rows = stage.write(items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text")), "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            w = words(data, offsets, gaps=TERM_GAP)
            doc, term = w.doc(), w.hash.view(np.int64)
            order = np.lexsort((term, doc))
            doc, term = doc[order], term[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
            at = pa.array(doc[new])
            yield pa.RecordBatch.from_arrays([batch.column("item").take(at), batch.column("item_id").take(at), pa.array(term[new])], ["item", "item_id", "term"])

    return stage.write(rows.mapInArrow(run, f"item bigint, item_id {kind}, term bigint"), "query_terms")


def postings(docs: DataFrame, terms, window: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index: one row for each window of at most `window` documents.

    ids and lengths (terms with repeats) of its documents; for each term that occurs, its place in `terms` (a broadcast sorted array of hashes), where its postings
    start, and for each posting the document's slot and how often it has the term. n: documents with any term, total: all their terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        for whole, data, offsets in slices(batches, "text"):
            w = words(data, offsets, gaps=TERM_GAP)
            at = np.searchsorted(known, w.hash)
            at[at == len(known)] = 0
            hit = np.flatnonzero(known[at] == w.hash) if len(known) else np.zeros(0, np.int64)
            doc, count = w.doc(), w.count
            rows = []
            for begin in range(0, whole.num_rows, window):
                end = min(begin + window, whole.num_rows)
                lo, hi = np.searchsorted(hit, [w.first[begin], w.first[end]])
                own = hit[lo:hi]
                key, times = np.unique(at[own] * window + (doc[own] - begin), return_counts=True)
                term, slot = key // window, key % window
                first = np.flatnonzero(np.diff(term, prepend=-1))
                n = count[begin:end]
                ids = whole.column("id").slice(begin, end - begin).to_pylist()
                rows.append((ids, n.astype("<i8").tobytes(), term[first].astype("<i4").tobytes(), np.append(first, len(term)).astype("<i4").tobytes(), slot.astype("<u2").tobytes(), times.astype("<i4").tobytes(), int((n > 0).sum()), int(n.sum())))
            kinds = [pa.list_(pa.int64()), *[pa.binary()] * 5, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])

    plain = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return plain.mapInArrow(run, INDEX)


def _document_counts(index: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(n_terms, np.int64)
        for b in batches:
            for terms, first in zip(b.column("terms"), b.column("first"), strict=True):
                out[np.frombuffer(terms.as_py(), "<i4")] += np.diff(np.frombuffer(first.as_py(), "<i4"))
        yield from vector_rows(out)

    return joined_chunks(summed_chunks(index.select("terms", "first").mapInArrow(run, "chunk int, data binary"), "int64", total=True), n_terms, "int64")


def _length_norms(lengths: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """50 + (50 * length * N) div L, by Python's integers where 64 bits would not hold the product."""
    if not total:
        return np.full(len(lengths), 50, np.int64)
    if int(lengths.max(initial=0)) * 50 * n_docs < 1 << 62:
        return 50 + lengths * (50 * n_docs) // total
    return np.array([50 + 50 * n * n_docs // total for n in lengths.tolist()], np.int64)


class _Heap:
    """The k best (score, id) of one query: higher scores first, then smaller ids, null ids last."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = np.concatenate([self.score, score]), np.concatenate([self.id, ids]), np.concatenate([self.null, null])
        best = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.id, self.null = score[best], ids[best], null[best]
        if len(best) == self.k:
            self.least = int(self.score[-1])


def _scored(index: DataFrame, weights, queries, window: int, k: int, n_docs: int, total: int) -> DataFrame:
    """(item, doc_id, score): the k best of each task for each query. weights: of each term; queries: (item, places of its terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, asked = weights.value, queries.value
        heaps = [_Heap(k) for _ in asked]
        sums, touched = np.zeros(-(-window // 64) * 64, np.int64), np.zeros(-(-window // 64), bool)
        buckets = sums.reshape(-1, 64)
        place = np.full(len(w), -1, np.int32)
        for b in batches:
            for ids, lengths, terms, first, slots, times in zip(*(b.column(c) for c in ("ids", "lengths", "terms", "first", "slots", "times")), strict=True):
                lengths, terms, first, slots, times = (np.frombuffer(x.as_py(), t) for x, t in ((lengths, "<i8"), (terms, "<i4"), (first, "<i4"), (slots, "<u2"), (times, "<i4")))
                if not len(terms):
                    continue
                null = np.asarray(ids.values.is_null())
                ids = ids.values.fill_null(0).to_numpy(zero_copy_only=False)
                norm, tf = _length_norms(lengths, n_docs, total)[slots], times.astype(np.int64)
                gain = np.repeat(w[terms], np.diff(first)) * (1_000_000_000 * tf // (1000 * tf + 20 * norm))
                place[terms] = np.arange(len(terms))
                for (_, own), heap in zip(asked, heaps, strict=True):
                    here = place[own]
                    for t in here[here >= 0]:
                        lo, hi = first[t], first[t + 1]
                        sums[slots[lo:hi]] += gain[lo:hi]  # a document once in a term's postings
                        touched[slots[lo:hi] >> 6] = True
                    rows = np.flatnonzero(touched)
                    if not len(rows):
                        continue
                    at, col = np.nonzero(buckets[rows] >= heap.least)
                    if len(at):
                        found = rows[at] * 64 + col
                        heap.add(sums[found], ids[found], null[found])
                    buckets[rows] = 0
                    touched[rows] = False
                place[terms] = -1
        for (item, _), heap in zip(asked, heaps, strict=True):
            if len(heap.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(heap.score), item)), pa.array(heap.id, mask=heap.null), pa.array(heap.score)], ["item", "doc_id", "score"])

    return index.select("ids", "lengths", "terms", "first", "slots", "times").mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", window: int = 4096) -> DataFrame:
    """(item_col, rank int, id_col, score): the k documents of highest score above 0 for each row of items, equal scores by ascending id.

    Terms are maximal runs of digits, letters and non-ASCII characters, lower-cased in A-Z only; each of a query's terms counts once. With N documents that have
    a term, L terms in all, n of a document's, df documents with a term and tf its times in one: weight floor(1000 ln((2N+2) / (2df+1))), and a
    score adds weight * (10^9 tf div (1000 tf + 20 (50 + 50 n N div L))). All counts are over all documents.

    A null or empty text has no term: as a document it is found by nothing and doesn't count in N, as a query it finds nothing. Repeated rows, of documents and of
    queries, count as rows of their own; a null id comes last among equals. Texts may be of any length. Ids must be integers. Empty tables give
    an empty result; other columns are ignored. Queries with more than MOST_TERMS terms together are searched in several passes.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "ranked")
    terms = _query_terms(items, item_col, query_col, stage)
    passes = max(1, -(-terms.count() // MOST_TERMS))
    parts = [_one_pass(docs, terms.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == i), stage, f"index{i}", k, id_col, text_col, window) for i in range(passes)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = best.join(terms.select("item", "item_id").distinct(), "item")
    return named.select(F.col("item_id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")


def _one_pass(docs: DataFrame, terms: DataFrame, stage: Stage, name: str, k: int, id_col: str, text_col: str, window: int) -> DataFrame:
    spark = docs.sparkSession
    asked = terms.groupBy("item").agg(F.collect_list("term").alias("terms")).toArrow()  # about MOST_TERMS terms
    items = asked.column("item").to_pylist()
    own = [np.asarray(t, np.int64).view(np.uint64) for t in asked.column("terms").to_pylist()]
    known = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
    index = stage.write(postings(docs, spark.sparkContext.broadcast(known), window, id_col, text_col), name, "zstd")
    n_docs, total = index.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    df = _document_counts(index, len(known))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    queries = [(i, np.searchsorted(known, t)) for i, t in zip(items, own, strict=True)]
    return _scored(index, spark.sparkContext.broadcast(weights), spark.sparkContext.broadcast(queries), window, k, n_docs, total)
