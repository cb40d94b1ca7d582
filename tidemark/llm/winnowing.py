"""Document fingerprints by winnowing, and neighbours in id order.

A text's code points, lower-cased in A-Z and without white space, are hashed by runs of k. Of every w hashes in a row the
smallest is kept, the rightmost of equal ones, with its place in the text. Two texts that share w + k - 1 such characters
in a row share a fingerprint, wherever the passage stands; runs shorter than k never match.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_list, gram_hashes, mix

_WHITE = np.array([0x20, *range(0x09, 0x0E)], np.uint32)
#: Bytes of a text that are hashed at once.
_PART = 4 << 20
#: The bits of a hash that decide which of a window is smallest; the others number the place.
_ORDER = np.uint64(0xFFFFFFFFFF000000)


@dataclass
class Fingerprint:
    """Hashes (ascending place) and their places, in code points of the text."""

    hashes: np.ndarray
    places: np.ndarray

    def __str__(self) -> str:
        return " ".join(f"{p}:{h:016x}" for p, h in zip(self.places.tolist(), self.hashes.tolist(), strict=True))

    def likeness(self, other: Fingerprint) -> float:
        """Common hashes over all hashes; 1 if neither has any."""
        a, b = np.unique(self.hashes), np.unique(other.hashes)
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the characters of UTF-8 bytes begin, and a number for each: its bytes, the first one lowest."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    width = np.diff(at, append=len(data))
    value = data[at].astype(np.uint32)
    for j in range(1, 4):
        more = np.flatnonzero(width > j)
        value[more] |= data[at[more] + j].astype(np.uint32) << np.uint32(8 * j)
    return at, value


def _smallest(keys: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w keys in a row, by running minima from both ends of blocks."""
    n = len(keys)
    padded = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
    padded[:n] = keys
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def _winnowed(value: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places (in value) that windows over these characters keep."""
    grams = gram_hashes(mix(value.astype(np.uint64) + np.uint64(1)), min(k, len(value)))
    place = np.arange(len(grams), dtype=np.uint64)
    keys = (grams & _ORDER) | (np.uint64(0xFFFFFF) - place)  # of equal hashes the rightmost has the smallest key
    low = _smallest(keys, min(w, len(grams)))
    keep = np.ones(len(low), bool)
    keep[1:] = low[1:] != low[:-1]
    at = (np.uint64(0xFFFFFF) - (low[keep] & np.uint64(0xFFFFFF))).astype(np.int64)
    return grams[at], at


def fingerprint(data: np.ndarray, k: int = 24, w: int = 64) -> Fingerprint:
    """Of one text's UTF-8 bytes. Texts of fewer than k characters have one hash, of the whole; texts without any have none.

    Long texts are hashed in parts that overlap by w + k - 2 characters, so memory doesn't follow a text's length.
    """
    value, place = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    hashes, places, seen, began = [], [], 0, 0
    while True:
        end = min(began + _PART, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        at, new = code_points(data[began:end])
        own = np.arange(seen, seen + len(at))
        new = np.where((new >= 65) & (new <= 90), new + 32, new)
        solid = ~np.isin(new, _WHITE)
        value, place = np.concatenate([value, new[solid]]), np.concatenate([place, own[solid]])
        seen, began = seen + len(at), end
        last = began >= len(data)
        if len(value) >= k + w - 1 or last and len(value) and not hashes:
            h, at = _winnowed(value, k, w)
            hashes.append(h)
            places.append(place[at])
            value, place = value[len(value) - (k + w - 2) :], place[len(place) - (k + w - 2) :]
        if last:
            break
    if not hashes:
        return Fingerprint(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    h, p = np.concatenate(hashes), np.concatenate(places)
    new = np.ones(len(p), bool)
    new[1:] = p[1:] > p[:-1]  # the first window of a part may keep what the last one of the part before kept
    return Fingerprint(h[new], p[new])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 24, w: int = 64) -> DataFrame:
    """(id_col, hash bigint, place bigint): each document's fingerprints, a row for each; null texts have none."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data in enumerate(_texts(b.column("text"))):
                f = fingerprint(data, k, w)
                if len(f.hashes):
                    yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(np.full(len(f.hashes), i))), pa.array(f.hashes.view(np.int64)), pa.array(f.places)], ["id", "hash", "place"])

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, hash bigint, place bigint").withColumnRenamed("id", id_col)


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    for x in as_list(column):
        buffer = x.as_buffer() if x.is_valid else None
        yield np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, border, id, tie, text) in as many partitions as shuffles have, each sorted: a run of neighbours in descending id order, then one more row,
    with border true: a copy of the row that comes next, the first one of the following run. After the last row comes the first.

    Runs are cut at quantiles of the ids, as many as there are partitions; what the driver gets is these and each run's first key. Each text is shuffled once. Null ids come last;
    rows of the same id are ordered by a hash of their text and stay in one run.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n))).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))[: n - 2] if n > 2 else np.zeros(0, np.int64)  # a bucket more than cuts, and one for nulls

    def bucket(ids: pa.Array) -> np.ndarray:
        """0 holds the largest ids; the last one holds nulls."""
        null = np.asarray(ids.is_null())
        x = ids.fill_null(0).to_numpy(zero_copy_only=False)
        return np.where(null, len(cuts) + 1, len(cuts) - np.searchsorted(cuts, x, side="right")).astype(np.int32)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for b in batches:
            ids, tie = b.column("id"), b.column("tie").to_numpy()
            at, x = bucket(ids), ids.fill_null(0).to_numpy(zero_copy_only=False)
            order = np.lexsort((tie, -x, at))
            for i in order[np.flatnonzero(np.diff(at[order], prepend=-1))]:
                key = (int(at[i]), -int(x[i]), int(tie[i]))
                best[key[0]] = min(best.get(key[0], key), key)
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*best.values(), strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["bucket", "order", "tie"])

    tie = F.xxhash64("text").alias("tie")
    tops = rows.select("id", tie).mapInArrow(firsts, "bucket int, order bigint, tie bigint").groupBy("bucket").agg(F.min(F.struct("order", "tie")).alias("t")).select("bucket", "t.*").orderBy("bucket").collect()
    held = [r.bucket for r in tops]
    #: a run's first key goes to the run before it as well, the first run's to the last
    before = {(r.bucket, r.order, r.tie): held[i - 1] for i, r in enumerate(tops)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tie = b.column("id"), b.column("tie").to_numpy()
            at, x = bucket(ids), ids.fill_null(0).to_numpy(zero_copy_only=False)
            names = ["bucket", "border", "id", "tie", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.zeros(len(at), bool)), ids, b.column("tie"), b.column("text")], names)
            tops_here = [(i, before[k]) for i, k in enumerate(zip(at.tolist(), (-x).tolist(), tie.tolist(), strict=True)) if k in before]
            if tops_here:
                i, to = zip(*tops_here, strict=True)
                i = pa.array(i)
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([True] * len(i)), *(b.column(c).take(i) for c in names[2:])], names)

    dealt = rows.select("id", tie, "text").mapInArrow(deal, "bucket int, border boolean, id bigint, tie bigint, text string")
    return dealt.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "border", F.col("id").desc_nulls_last(), "tie")


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 24, w: int = 64) -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each row of df.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by as many first ones (or all) of the next document in descending id order; after
    the last comes the first. A fingerprint is written as place:hash pairs. near_edited and near_next: the share of common hashes with the edited
    text's and the next document's.

    A null text is empty. Equal texts have equal fingerprints. Repeated rows each give a row; rows of one id are neighbours, ordered by a hash of their text; null
    ids come last. A single document is its own next. Texts of any length are fingerprinted whole. An empty table gives an empty result. Ids must be integers.
    """
    schema = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # bucket, border, id, bytes, fingerprint of the row before
        for b in batches:
            out: list[tuple] = []
            size = 0
            for at, border, doc, data in zip(b.column("bucket").to_pylist(), b.column("border").to_pylist(), b.column("id").to_pylist(), _texts(b.column("text")), strict=True):
                if border and held is not None and held[:2] == (at, True):
                    continue  # a repeated row, copied as often
                now = (at, border, doc, data, fingerprint(data, k, w))
                if held is not None and not held[1]:
                    out.append(compared(*held[2:], *now[3:]))
                    size += len(out[-1][3]) + len(out[-1][4])
                held = now
                if size > 4 << 20:
                    yield batch(out)
                    out, size = [], 0
            if out:
                yield batch(out)
            if held is not None:
                held = (*held[:3], held[3].copy(), held[4])  # it outlives the batch

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def compared(doc, data: np.ndarray, own: Fingerprint, after: np.ndarray, other: Fingerprint) -> tuple:
        at = np.flatnonzero((data & 0xC0) != 0x80)
        n = len(at)
        keep, put = n - n // 2, np.flatnonzero((after[: 4 * (n // 2)] & 0xC0) != 0x80)
        head = data[: at[keep]] if keep < n else data
        tail = after[: put[n // 2]] if n // 2 < len(put) else after[: 4 * (n // 2)] if n // 2 else after[:0]
        edited = np.concatenate([head, tail])
        f = fingerprint(edited, k, w)
        return doc, n, hashlib.sha256(edited).hexdigest(), str(own), str(f), own.likeness(f), own.likeness(other)

    return with_next(df, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
