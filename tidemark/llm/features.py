"""Hashed features of whole texts, and labelled samples of bounded size to fit on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_LETTER, Stage, fold, mix, slices, span_hashes, words

BITS = 18
#: So many first bytes of longer runs of letters are features too: stems that take many endings.
STEMS = (4, 5)
#: A judgement of quality also takes longer stems, and which of them a document has so many times at least: what a text says
#: again and again weighs more than what it holds once, by chance.
QUALITY_STEMS, REPEATS = (5, 7), (2, 3, 5)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting is several times faster than numpy's hashing here."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


def hashed_features(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...] = STEMS, repeats: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers below 2 ** BITS of each document, end to end, and the offsets; each number once a document.

    Features are the document's distinct lower-cased words, runs of letters and their stems, the stems that it has as often as `repeats` says, and its
    shape in steps: the shares of repeated words, of repeated neighbours, of capitals, of bytes that are no letters, of line ends, the mean word length
    and the length.
    """
    n_docs = len(offsets) - 1
    low = fold(data)
    w, runs = words(low, offsets, folded=True), words(low, offsets, folded=True, gaps=NO_LETTER)
    owner = w.doc()
    numbers = (w.hash >> np.uint64(64 - BITS)).astype(np.int64)
    key = _distinct((owner << BITS) | numbers)
    distinct = np.bincount(key >> BITS, minlength=n_docs)
    key = np.concatenate([key, (runs.doc() << BITS) | (mix(runs.hash) >> np.uint64(64 - BITS)).astype(np.int64)])
    stems = [np.flatnonzero(runs.end - runs.start > n) for n in lengths]
    h = span_hashes(low, np.concatenate([runs.start[i] for i in stems]), np.concatenate([runs.start[i] + n for i, n in zip(stems, lengths, strict=True)]))
    stem_owner = runs.doc()[np.concatenate(stems)]
    stem_key = (stem_owner << BITS) | (mix(h + np.uint64(1)) >> np.uint64(64 - BITS)).astype(np.int64)
    if repeats:
        stem_key.sort()
        first = np.flatnonzero(np.concatenate([[True], stem_key[1:] != stem_key[:-1]])) if len(stem_key) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(stem_key)))
        stem_key = stem_key[first]
        often = [(stem_key[times >= k], k) for k in repeats]
        often = [(x >> BITS << BITS) | (mix((x & ((1 << BITS) - 1)).astype(np.uint64) + np.uint64(k << BITS)) >> np.uint64(64 - BITS)).astype(np.int64) for x, k in often]
        key = np.concatenate([key, *often])
    key = np.concatenate([key, stem_key])
    n_words = np.maximum(w.count, 1)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[offsets[1:]] - total[offsets[:-1]]

    size = np.maximum(np.diff(offsets), 1)
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1])
    letters = per_doc(((low >= 97) & (low <= 122)) | (low >= 128))
    shapes = [
        np.floor(20 * (1 - distinct / n_words)),
        np.floor(20 * np.bincount(owner, same, n_docs) / n_words),
        np.floor(20 * per_doc((data >= 65) & (data <= 90)) / np.maximum(letters, 1)),
        np.floor(40 * (1 - letters / size)),
        np.floor(40 * np.minimum(1, 4 * per_doc(data == 10) / n_words)),
        np.minimum(30, np.floor(np.bincount(owner, w.end - w.start, n_docs) / n_words)),
        np.floor(2 * np.log2(n_words)),
    ]
    doc = np.arange(n_docs)
    for i, s in enumerate(shapes):
        number = (mix((s.astype(np.int64) * 64 + i + 1).astype(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)
        key = np.concatenate([key, (doc << BITS) | number])
    key = _distinct(key)
    return key & ((1 << BITS) - 1), np.searchsorted(key >> BITS, np.arange(n_docs + 1))


def quality_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return hashed_features(data, offsets, QUALITY_STEMS, REPEATS)


#: Feature numbers of a sample that come to the driver at most, 4 bytes each; a document of n words has some n of them, 2 ** BITS at most.
MOST_FEATURES = 1 << 26


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, features: Callable = hashed_features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, offsets, labels) of about `most` labelled documents, chosen by a hash of the id.

    docs has id and text, labels id and `label`; rows with a null label, id or text don't take part. Only feature numbers come to the
    driver; a sample of very long documents is thinned by the same hash until they are MOST_FEATURES at most. The chosen ids are
    broadcast: their number is bounded by `most`.
    """
    rated = labels.filter(F.col("id").isNotNull() & F.col(label).isNotNull()).select("id", F.col(label).alias("label"))
    n, space = rated.count(), 1 << 24
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0)
    place = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(space))
    part = rated.filter(place < int(min(1.0, most / n) * space)).limit(2 * most)
    # the one pass over all documents; what it finds is small
    chosen = Stage(docs.sparkSession, "sample").write(docs.filter("text is not null").join(F.broadcast(part), "id").select("id", "text", "label"), "chosen", "zstd")
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > 4 * MOST_FEATURES:  # a feature takes 4 bytes of text at least
        chosen = chosen.filter(place < int(most / n * space * 4 * MOST_FEATURES / size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offsets in slices(batches, "text"):
            x, at = features(data, offsets)
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.astype(np.int32)))], ["label", "x"])

    kind = dict(part.dtypes)["label"]
    found = chosen.select("text", "label").mapInArrow(run, f"label {kind}, x array<int>").toArrow()
    lists = found.column("x").combine_chunks()
    if len(found) == 0:
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0)
    at = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[at[0] : at[-1]], at - at[0], np.array(found.column("label").to_pylist())


def sums(weights: np.ndarray, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the weights (one row for each feature, or a vector) over each document's features."""
    total = np.zeros((len(x) + 1, *weights.shape[1:]))
    np.cumsum(weights[x], axis=0, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def descend(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    """Adam on the full sample."""
    p, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, rounds + 1):
        g = gradient(p)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p
