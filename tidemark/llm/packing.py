"""Sequence packing: Martello-Toth dominance reduction, then best fit on what is left.

Packing depends on lengths alone, and a length is at most the capacity. So the instance is a histogram of at most
`capacity` numbers, however many documents there are; the reduction and the best fit work on that histogram, and
every document finds its place by its rank among the pieces of its length. Ranks come from counts per input task,
so no window ever gathers the pieces of one length.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage


@dataclass
class Plan:
    """Runs of equally long pieces: rank r of the run goes to sequence seq + (r - rank) // per_bin."""

    capacity: int
    sequences: int = 0
    fixed: int = 0  # sequences that the reduction fixed
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)  # length, rank, count, sequence, per_bin, offset
    _taken: dict[int, int] = field(default_factory=dict)

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def put(self, length: int, n: int, seq: int, per_bin: int, offset: int) -> None:
        rank = self._taken.get(length, 0)
        self._taken[length] = rank + n
        self.runs.append((length, rank, n, seq, per_bin, offset))


def _fixed_set(left: np.ndarray, j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with one piece of length j that dominates every other feasible set with that piece, or None.

    A set dominates when whatever else could stand beside j can be exchanged for the set's partner k: it is
    true if nothing fits beside j; if j and k fill a sequence; if no two pieces fit beside j, with k the longest
    that fits; and if no three fit and every two that fit are together no longer than k.
    """
    left[j] -= 1
    try:
        room = capacity - j
        fits = np.flatnonzero(left[: room + 1])
        if not len(fits):
            return (j,)
        k = int(fits[-1])
        if k == room:
            return (j, k)
        small: list[int] = []
        for s in fits[:3]:
            small += [int(s)] * int(min(left[s], 3 - len(small)))
        if len(small) < 2 or small[0] + small[1] > room:
            return (j, k)
        if len(small) < 3 or sum(small[:3]) > room:
            best = 0
            for a in fits:
                left[a] -= 1
                rest = np.flatnonzero(left[: room - int(a) + 1])
                left[a] += 1
                if len(rest):
                    best = max(best, int(a) + int(rest[-1]))
            if best <= k:
                return (j, k)
        return None
    finally:
        left[j] += 1


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Places all pieces of a histogram {length: count}; lengths are 1 to capacity."""
    out, left = Plan(capacity), np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    for j in range(capacity, 0, -1):  # the reduction: a fixed set is taken as often as its pieces allow
        while left[j] and (found := _fixed_set(left, j, capacity)):
            k = found[-1]
            n = int(left[j]) if len(found) == 1 else int(left[j] // 2) if k == j else int(min(left[j], left[k]))
            if len(found) == 1 and j <= capacity - j:
                n = 1  # a second piece of length j would fit: only the last one is alone
            seq, at = out.open(n), 0
            for length in found:
                out.put(length, n, seq, 1, at)
                left[length] -= n
                at += length
            out.fixed += n
    bins: dict[int, list[tuple[int, int]]] = {}  # room: [(first sequence, how many)]
    for j in range(capacity, 0, -1):  # best fit of the rest, longest first
        n = int(left[j])
        while n:
            room = next((r for r in range(j, capacity) if bins.get(r)), capacity)
            per = room // j
            if room < capacity:
                seq, have = bins[room].pop()
            else:
                have = -(-n // per)
                seq = out.open(have)
            full = min(have, n // per)
            if full:
                out.put(j, full * per, seq, per, capacity - room)
                bins.setdefault(room - full_used, []).append((seq, full)) if (full_used := per * j) < room else None
                n -= full * per
            if full < have:
                rest_seq, rest = seq + full, have - full
                if n and n < per:  # fewer than fill one sequence
                    out.put(j, n, rest_seq, n, capacity - room)
                    if room - n * j:
                        bins.setdefault(room - n * j, []).append((rest_seq, 1))
                    n, rest_seq, rest = 0, rest_seq + 1, rest - 1
                if rest:
                    bins.setdefault(room, []).append((rest_seq, rest))
    return out


def bpe_ids(path: str, ranks_path: str | None = None, pattern: str | None = None) -> Callable[[list[str]], list[np.ndarray]]:
    """Token ids of texts by the tokenizer file at path, without special tokens added.

    With the same vocabulary as ranks, ordinary texts take the faster encoder of the two, which gives the same ids;
    a text that holds the string of an added token always goes through the tokenizer file, and so does one that the faster
    encoder refuses, as it does with some 700,000 white-space characters in a row.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.no_padding()
    slow.no_truncation()

    def by_file(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    if ranks_path is None:
        return lambda texts: [by_file(t) for t in texts]
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    added = [t.content for t in slow.get_added_tokens_decoder().values()]

    def ids(text: str) -> np.ndarray:
        if any(a in text for a in added):
            return by_file(text)
        try:
            return fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # its pattern's stack has a limit
            return by_file(text)

    return lambda texts: [ids(t) for t in texts]


def public_bpe() -> Callable[[list[str]], list[np.ndarray]]:
    """The public byte-level BPE of 50,257 tokens, from the files of the machine that runs the task."""
    import public_tokenizers as P

    return bpe_ids(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


_ENCODERS: dict[Callable, Callable] = {}


def encoder_of(factory: Callable) -> Callable:
    """One encoder in each worker process."""
    if factory not in _ENCODERS:
        _ENCODERS[factory] = factory()
    return _ENCODERS[factory]


def token_pieces(df: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, encoder: Callable) -> DataFrame:
    """Pieces of at most `capacity` tokens, each with its rank among the equally long pieces of its task."""
    kind = dict(df.dtypes)[id_col]
    names = ["id", "piece", "start", "length", "ids_crc32", "task", "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(encoder)
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows: list[tuple] = []
            for i, text in enumerate(b.column("text")):
                ids = np.append(encode([text.as_py() or ""])[0], end_id).astype("<u4")
                first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append((i, piece, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()), seen[hi - lo]))
                    seen[hi - lo] += 1
            if not rows:
                continue
            at, piece, start, length, crc, rank = (np.array(c, np.int64) for c in zip(*rows, strict=True))
            cols = [b.column("id").take(pa.array(at)), piece.astype(np.int32), start, length, crc, np.full(len(at), task, np.int32), rank]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names)

    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint"
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, encoder: Callable = public_bpe) -> DataFrame:
    """Packs all documents into as few sequences of at most `capacity` tokens as the method finds.

    A document is its token ids and then end_id; a null or empty text is the end token alone. Only longer ones are
    cut, into pieces of `capacity` tokens of which the first takes the remainder. One row per piece: id, piece,
    start, length, ids_crc32, sequence_id, offset. Rows with a null or repeated id are packed like any other. Pieces of equal length
    are exchangeable: which of them takes which place follows from their order in the input's tasks. Texts of any length are encoded whole; a
    text that only the tokenizer file's encoder takes needs up to 200 MB of memory a MB while it is encoded.
    An empty table gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    stage = Stage(spark, "packing")
    pieces = stage.write(token_pieces(df, id_col, text_col, capacity, end_id, encoder), "pieces")
    counts = stage.write(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    done = plan(histogram, capacity)
    runs = np.array(sorted(done.runs), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(runs)  # a few runs for each of `capacity` lengths

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    offsets = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(offsets, ["task", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        begin = np.searchsorted(runs[:, 0], np.arange(capacity + 2))
        wide = np.int64(1) << 48
        keys = runs[:, 0] * wide + runs[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(keys, length * wide + rank, side="right") - 1
            assert (at >= begin[length]).all()
            r = runs[at]
            nth = rank - r[:, 1]
            sequence = r[:, 3] + nth // r[:, 4]
            offset = r[:, 5] + nth % r[:, 4] * length
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")], pa.array(sequence), pa.array(offset)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = dict(df.dtypes)[id_col]
    out = ranked.mapInArrow(place, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("id", id_col)
