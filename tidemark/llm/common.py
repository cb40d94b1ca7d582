"""Shared helpers: Arrow text buffers as numpy arrays, word hashes, written tables.

Words are the runs of bytes outside 0x20 and 0x09-0x0D; A-Z is lower-cased and nothing else.
A null text counts as empty everywhere.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes that are neither a-z nor part of a longer UTF-8 sequence.
NO_LETTER = np.ones(256, dtype=bool)
NO_LETTER[97:123] = NO_LETTER[128:] = False

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_GRAM = 0xD6E8FEB86659FD93 | 1
_POWERS: dict[int, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Without one, a session in one process gets a temporary folder, as in tests; a cluster's raises."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


class Stage:
    """Tables written to the shared folder: they cut lineage and outlive a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        df.write.option("compression", codec).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        """Removes a table that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, stage: Stage) -> DataFrame:
    """(doc, row): the rows of df as structs, with a number each. Written, so that a row keeps its number; no name can clash."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]) if df.columns else F.struct(F.lit(0))
    return stage.write(df.select(whole.alias("doc"), F.monotonically_increasing_id().alias("row")), "rows", "zstd")


def by_place(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[str], str]:
    """The named columns of df as c0, c1, ..., these names, and their schema: Arrow functions don't take names with dots."""
    plain = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    return plain, plain.columns, ", ".join(f"{n} {t}" for n, t in plain.dtypes)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if len(have) <= 1 << 23:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold(data: np.ndarray) -> np.ndarray:
    """Lower-cases A-Z in bytes."""
    return _FOLD[data]


def as_list(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; nulls are empty."""
    column = as_list(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of the batches of about `limit` text bytes (one row at least), each with its text's bytes and offsets."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(text))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin), data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
            begin = end


@dataclass
class Words:
    """Words of a run of documents: byte range, 64-bit hash, document index, and each document's first word."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # n_docs + 1

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def words(data: np.ndarray, offsets: np.ndarray, folded: bool = False, gaps: np.ndarray = _SPACE) -> Words:
    """Splits documents into lower-cased words and hashes each. gaps: which bytes part words."""
    n = len(data)
    low = data if folded else fold(data)
    solid = ~gaps[low]
    begins, ends = solid.copy(), solid.copy()
    if n:
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        edges = offsets[offsets < n]
        begins[edges] = solid[edges]
        edges = offsets[offsets > 0] - 1
        ends[edges] = solid[edges]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(start, end, span_hashes(low, start, end), np.searchsorted(start, offsets))


def span_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes have equal hashes wherever they stand."""
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(low)), out=total[1:])
    return mix((total[end] - total[start]) * powers(_BASE_INV, len(low) + 1)[start])


def gram_hashes(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of n consecutive entries of h; len(h) - n + 1 of them."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    salted = mix(h + np.uint64((seed * 0xA0761D6478BD642F + 0x632BE59BD9B4E019) & (2**64 - 1)))
    if n <= 8:
        out = salted[n - 1 :].copy()
        for k in range(n - 2, -1, -1):
            out = out * np.uint64(_GRAM) + salted[k : k + m]
        return mix(out)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(salted * powers(_GRAM, len(h)), out=total[1:])
    return mix((total[n:] - total[:-n]) * powers(pow(_GRAM, -1, 1 << 64), m))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def summed_chunks(partial: DataFrame, dtype: str, total: bool) -> dict[int, bytes]:
    """Adds up (or ORs) rows (chunk, data) of equally long vectors, chunk by chunk, in two levels of tasks.

    What comes back is as long as the vector all tasks share, whatever the number of tasks.
    """

    def fold_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, data in zip(b.column("chunk").to_pylist(), b.column("data").to_pylist(), strict=True):
                x = np.frombuffer(data, dtype)
                if chunk not in held:
                    held[chunk] = x.copy()
                elif total:
                    held[chunk] += x
                else:
                    held[chunk] |= x
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["chunk", "data"])

    schema = "chunk int, data binary"
    spread = partial.repartition("chunk", F.floor(F.rand(17) * 8)).mapInArrow(fold_chunks, schema)
    return {r.chunk: bytes(r.data) for r in spread.repartition("chunk").mapInArrow(fold_chunks, schema).collect()}


def vector_rows(x: np.ndarray, chunk: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The parts of a vector that aren't zero, as rows (chunk, data)."""
    parts = [(i // chunk, x[i : i + chunk]) for i in range(0, len(x), chunk)]
    parts = [(i, p.tobytes()) for i, p in parts if p.any()]
    if parts:
        ids, data = zip(*parts, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(data, pa.binary())], ["chunk", "data"])


def joined_chunks(chunks: dict[int, bytes], size: int, dtype: str, chunk: int = 1 << 14) -> np.ndarray:
    out = np.zeros(size, dtype)
    for i, data in chunks.items():
        x = np.frombuffer(data, dtype)
        out[i * chunk : i * chunk + len(x)] = x
    return out


class KeyFilter:
    """Blocked Bloom filter of 64-bit keys: one 64-byte block a key, eight bits in it. False hits only."""

    def __init__(self, words: np.ndarray):
        self.words = words.reshape(-1, 8)

    @staticmethod
    def bits(keys: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys ^ np.uint64(0x5851F42D4C957F2D))
        return (h % np.uint64(n_blocks)).astype(np.int64), mix(h)

    def __contains__(self, _):
        raise TypeError("use hits()")

    def hits(self, keys: np.ndarray) -> np.ndarray:
        block, g = self.bits(keys, len(self.words))
        out = np.ones(len(keys), bool)
        for i in range(8):
            out &= (self.words[block, i] >> ((g >> np.uint64(6 * i)) & np.uint64(63))) & np.uint64(1) != 0
        return out

    @classmethod
    def of(cls, df: DataFrame, key: str, n: int, bits_per_key: int = 16, most_bytes: int = 32 << 20) -> KeyFilter:
        """Of a bigint column with about n keys. The filter never takes more than most_bytes: a fuller one only lets more through."""
        n_blocks = max(1, min(most_bytes // 64, n * bits_per_key // 512 + 1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = np.zeros((n_blocks, 8), np.uint64)
            for b in batches:
                block, g = cls.bits(b.column(0).to_numpy().view(np.uint64), n_blocks)
                for i in range(8):
                    np.bitwise_or.at(words[:, i], block, np.uint64(1) << ((g >> np.uint64(6 * i)) & np.uint64(63)))
            yield from vector_rows(words.ravel())

        parts = summed_chunks(df.select(key).mapInArrow(run, "chunk int, data binary"), "uint64", total=False)
        return cls(joined_chunks(parts, n_blocks * 8, "uint64"))
