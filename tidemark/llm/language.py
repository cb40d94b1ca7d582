"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary gives the pieces. Each language has its own probabilities of the pieces; the probability of
a word is the sum over all ways to cut it into pieces, by the forward algorithm, and the probabilities are fitted by
expectation maximisation over the same sums. Any single byte is a piece, so every text can be cut.

Words are lower-cased (A-Z) with a blank in front. The sums go over whole words, however long, with all pieces of the
vocabulary; they are rescaled on the way, so that no word's probability vanishes.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from math import frexp, ldexp

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, fold, joined_chunks, mix, powers, slices, summed_chunks, vector_rows, words

#: Words up to LONG bytes go many at a time; longer ones go one by one. Pieces over SHORT bytes are few and looked up apart.
LONG, SHORT = 48, 12
_BASE = 0xB5297A4D3F84D5B5 | 1
_SCALE = 16.0  # keeps products of probabilities in range: one factor for each byte
_LETTER = regex.compile(r"\p{L}")


def public_pieces() -> list[bytes]:
    """Pieces of the public 32,000-piece vocabulary, lower-cased, a blank for the word mark; and all single bytes."""
    import public_tokenizers as P
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    found = {bytes([b]) for b in range(256)}
    for i in range(m.get_piece_size()):
        if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i)):
            found.add(m.id_to_piece(i).replace("▁", " ").encode().lower())
    return sorted(found)


class Lattice:
    """Finds pieces in words, many words of one length at a time."""

    def __init__(self, pieces: list[bytes]):
        self.n = len(pieces)
        self.sizes = np.array([len(p) for p in pieces])
        h = np.array([self._of(p) for p in pieces], np.uint64)
        self.bits = 20
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.more: dict[int, int] = {}
        slot = (mix(h) >> np.uint64(64 - self.bits)).astype(np.int64)
        self.hash = np.concatenate([h, np.zeros(1, np.uint64)])
        order = np.argsort(slot, kind="stable")
        first = np.ones(len(h), bool)
        first[1:] = slot[order][1:] != slot[order][:-1]
        self.slots[slot[order[first]]] = order[first]
        self.crowded = np.zeros(1 << self.bits, bool)
        self.crowded[slot[order[~first]]] = True
        late = order[~first]
        by = np.argsort(h[late])
        self.late_hash, self.late = h[late][by], late[by]
        #: Lengths over SHORT, and the hashes of the first SHORT bytes of the pieces that have them.
        self.long_sizes = sorted({len(p) for p in pieces if len(p) > SHORT})
        self.long_heads = np.unique(np.array([self._of(p[:SHORT]) for p in pieces if len(p) > SHORT], np.uint64))

    @staticmethod
    def _of(p: bytes) -> int:
        return sum((b + 1) * pow(_BASE, i, 1 << 64) for i, b in enumerate(p)) % (1 << 64)

    def find(self, h: np.ndarray) -> np.ndarray:
        slot = (mix(h) >> np.uint64(64 - self.bits)).astype(np.int64)
        at = self.slots[slot]
        out = np.where(self.hash[at] == h, at, -1)
        look = np.flatnonzero((out < 0) & self.crowded[slot])
        if len(look):
            i = np.minimum(np.searchsorted(self.late_hash, h[look]), len(self.late) - 1)
            out[look] = np.where(self.late_hash[i] == h[look], self.late[i], -1)
        return out

    def ids(self, letters: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
        """Of words (rows) of one length: for each end, (start, piece of each word or -1) that some word has."""
        k, n = letters.shape
        total = np.zeros((n + 1, k), np.uint64)
        np.cumsum((letters.T.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n)[:, None], axis=0, out=total[1:])
        back = powers(pow(_BASE, -1, 1 << 64), n)
        out: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n)]
        for start in range(n):
            for end in range(start + 1, min(n, start + SHORT) + 1):
                ids = self.find((total[end] - total[start]) * back[start])
                if (ids >= 0).any():
                    out[end - 1].append((start, ids))
            if start + SHORT < n and len(self.long_heads):
                rows = np.flatnonzero(self._is_head((total[start + SHORT] - total[start]) * back[start]))
                for size in self.long_sizes if len(rows) else ():
                    if start + size <= n:
                        found = self.find((total[start + size, rows] - total[start, rows]) * back[start])
                        if (found >= 0).any():
                            ids = np.full(k, -1, np.int64)
                            ids[rows] = found
                            out[start + size - 1].append((start, ids))
        return out

    def _is_head(self, h: np.ndarray) -> np.ndarray:
        return self.long_heads[np.minimum(np.searchsorted(self.long_heads, h), len(self.long_heads) - 1)] == h

    def arcs(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all pieces in one word, by end; one look-up for each length, over all starts."""
        n = len(letters)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=total[1:])
        back = powers(pow(_BASE, -1, 1 << 64), n)
        starts, ends, pieces = [], [], []
        for size in [*range(1, SHORT + 1), *self.long_sizes]:
            if size > n:
                break
            ids = self.find((total[size:] - total[:-size]) * back[: n - size + 1])
            at = np.flatnonzero(ids >= 0)
            starts.append(at)
            ends.append(at + size)
            pieces.append(ids[at])
        start, end, piece = np.concatenate(starts), np.concatenate(ends), np.concatenate(pieces)
        order = np.argsort(end, kind="stable")
        return start[order], end[order], piece[order]


def _grouped(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, letters) of the words up to LONG bytes by length, a blank in front; then of each longer word."""
    size = end - start + 1
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        for part in np.array_split(rows, -(-len(rows) // 16384)) if n <= LONG + 1 else rows[:, None]:
            at = start[part][:, None] - 1 + np.arange(n)
            letters = low[np.clip(at, 0, len(low) - 1)]
            letters[:, 0] = 32
            yield part, letters


#: Sums are brought back to 1 each time so many bytes are done: few enough that they stay within a double's range.
_EVERY = 4


def _forward(table: list[list[tuple[int, np.ndarray]]], weight: Callable[[np.ndarray], np.ndarray], shape: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all segmentations up to each byte (bytes + 1 x shape), each stretch of them divided by exp(its log scale)."""
    n = len(table)
    alpha, log_scale = np.zeros((n + 1, *shape)), np.zeros((n + 1, *shape))
    alpha[0] = 1
    reach = max((e + 1 - s for e, found in enumerate(table) for s, _ in found), default=1)
    scale = np.zeros(shape)
    for e, found in enumerate(table, 1):
        for s, ids in found:
            alpha[e] += alpha[s] * weight(ids)
        log_scale[e] = scale
        if e % _EVERY == 0 and e < n:
            lo = max(0, e - reach + 1)
            top = alpha[lo : e + 1].max(axis=0)
            top[top == 0] = 1
            alpha[lo : e + 1] /= top
            scale = scale + np.log(top)
            log_scale[lo : e + 1] = scale
    return alpha, log_scale


def log_words(lattice: Lattice, scaled: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Natural log probability of each word in each language: the forward algorithm."""
    out = np.zeros((len(start), scaled.shape[1]))
    for rows, letters in _grouped(low, start, end):
        n = letters.shape[1]
        if n <= LONG + 1:
            alpha, log_scale = _forward(lattice.ids(letters), lambda ids: scaled[ids], (len(rows), scaled.shape[1]))  # the last row of scaled is zero, for no piece
            last, scale = alpha[n], log_scale[n]
        else:
            last, scale = _long_forward(lattice.arcs(letters[0]), scaled, n)
        out[rows] = np.log(last) + scale - n * np.log(_SCALE)
    return out


def _long_forward(arcs: tuple[np.ndarray, np.ndarray, np.ndarray], scaled: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The forward sum of one long word: its last value and log scale. Only the sums that pieces can still reach are held."""
    start, end, piece = arcs
    reach = int((end - start).max(initial=1)) + 1
    ring, scale = np.zeros((reach, scaled.shape[1])), np.zeros(scaled.shape[1])
    ring[0] = 1
    first = np.searchsorted(end, np.arange(n + 2)).tolist()
    starts = (start % reach).tolist()
    for e in range(1, n + 1):
        lo, hi = first[e], first[e + 1]
        ring[e % reach] = (ring[starts[lo:hi]] * scaled[piece[lo:hi]]).sum(axis=0)
        if e % _EVERY == 0:
            top = ring.max(axis=0)
            top[top == 0] = 1
            ring /= top
            scale = scale + np.log(top)
    return ring[n % reach], scale


def _scan(target: np.ndarray, other: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the arcs into each place 0 to n, from 1 at place 0: mantissas and powers of two. Arcs are sorted by target, and other < target."""
    value, power = array("d", bytes(8 * (n + 1))), array("q", bytes(8 * (n + 1)))
    value[0], power[0] = 0.5, 1
    bounds = np.searchsorted(target, np.arange(n + 2))
    for first in range(1, n + 1, 1 << 16):
        last = min(first + (1 << 16), n + 1)
        at = (bounds[first : last + 1] - bounds[first]).tolist()
        arcs = slice(bounds[first], bounds[last])
        froms, weights = other[arcs].tolist(), weight[arcs].tolist()
        for t in range(first, last):
            own = range(at[t - first], at[t - first + 1])
            base = max((power[froms[k]] for k in own if value[froms[k]]), default=0)
            total = 0.0
            for k in own:
                total += ldexp(value[froms[k]] * weights[k], power[froms[k]] - base)
            value[t], step = frexp(total)
            power[t] = base + step
    return np.frombuffer(value, np.float64), np.frombuffer(power, np.int64)


def _long_expected(arcs: tuple[np.ndarray, np.ndarray, np.ndarray], scaled: np.ndarray, n: int, times: float, out: np.ndarray) -> None:
    """Adds one long word's expected piece counts to `out`: sums from both ends over arrays of arcs, some 200 bytes for each byte of the word."""
    start, end, piece = arcs
    weight = scaled[piece]
    there, up = _scan(end, start, weight, n)
    order = np.argsort(n - start, kind="stable")
    back, down = _scan((n - start)[order], (n - end)[order], weight[order], n)
    if not there[n]:
        return
    for lo in range(0, len(piece), 1 << 20):
        s, e, i = start[lo : lo + (1 << 20)], end[lo : lo + (1 << 20)], piece[lo : lo + (1 << 20)]
        share = there[s] * weight[lo : lo + (1 << 20)] * back[n - e] / there[n]
        np.add.at(out, i, np.ldexp(share, up[s] + down[n - e] - up[n]) * times)


def expected_counts(lattice: Lattice, scaled: np.ndarray, low, start, end, n_times: np.ndarray, lang: np.ndarray, n_langs: int) -> np.ndarray:
    """Expected piece counts by language: forward and backward sums over all segmentations."""
    out = np.zeros((n_langs, lattice.n + 1))
    for rows, letters in _grouped(low, start, end):
        n, of = letters.shape[1], lang[rows]
        if n > LONG + 1:
            _long_expected(lattice.arcs(letters[0]), scaled[:, of[0]], n, float(n_times[rows[0]]), out[of[0]])
            continue
        table = lattice.ids(letters)
        alpha, log_alpha = _forward(table, lambda ids, of=of: scaled[ids, of], (len(rows),))
        # backwards on the reversed word, with the same sums
        back: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n)]
        for e, found in enumerate(table, 1):
            for s, ids in found:
                back[n - s - 1].append((n - e, ids))
        beta, log_beta = _forward(back, lambda ids, of=of: scaled[ids, of], (len(rows),))
        beta, log_beta = beta[::-1], log_beta[::-1]
        total = np.log(alpha[n]) + log_alpha[n]
        for e, found in enumerate(table, 1):
            for s, ids in found:
                share = np.exp(log_alpha[s] + log_beta[e] - total) * n_times[rows]
                np.add.at(out, (of, ids), alpha[s] * scaled[ids, of] * beta[e] * share)
    return out[:, :-1]


def scaled_table(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Probabilities (languages x pieces) as rows for each piece, scaled by length, with a row of zeros at the end."""
    return np.vstack([(p * _SCALE**sizes).T, np.zeros(len(p))])


_LATTICES: dict[Callable, Lattice] = {}


def lattice_of(pieces: Callable) -> Lattice:
    if pieces not in _LATTICES:
        _LATTICES[pieces] = Lattice(pieces())
    return _LATTICES[pieces]


def fit(docs: DataFrame, pieces: Callable, rounds: int, sample: int, stage: Stage) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors, piece probabilities from rows (id, text, lang) with neither text nor lang null.

    Of the rows about `sample` take part, chosen by a hash of the id (and text where it is null); priors count all.
    Expectation steps run in tasks over the counted words; a vector of languages x pieces comes back each round.
    """
    spark = docs.sparkSession
    by_lang = sorted((r.lang, r["count"]) for r in docs.groupBy("lang").count().collect())  # one row for each language
    langs, total = [x for x, _ in by_lang], sum(n for _, n in by_lang)
    if not langs:
        return [], np.zeros(0), np.zeros((0, 0))
    space = 1 << 24
    chosen = docs.filter(F.pmod(F.coalesce(F.xxhash64(F.col("id").cast("string")), F.xxhash64("text")), F.lit(space)) < int(min(1.0, sample / total) * space))
    number = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offsets in slices(batches, "text"):
            low = fold(data)
            w = words(low, offsets, folded=True)
            lang = np.array([number[x] for x in b.column("lang").to_pylist()])[w.doc()]
            key = mix(w.hash + lang.astype(np.uint64))
            _, at, n = np.unique(key, return_index=True, return_counts=True)
            raw = low.tobytes()
            texts = [raw[w.start[i] : w.end[i]] for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(lang[at].astype(np.int32)), pa.array(texts, pa.binary()), pa.array(n.astype(np.int64))], ["lang", "word", "n"])

    counted = chosen.select("text", "lang").mapInArrow(count, "lang int, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = stage.write(counted, "words")
    lattice = lattice_of(pieces)
    p = np.full((len(langs), lattice.n), 1.0)
    p *= 0.25 ** lattice.sizes  # longer pieces start rarer
    p /= p.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(p)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice, p = lattice_of(pieces), shared.value
            scaled, out = scaled_table(p, lattice.sizes), np.zeros(p.shape)
            for b, data, offsets in slices(batches, "word", 1 << 20):
                out += expected_counts(lattice, scaled, data, offsets[:-1], offsets[1:], b.column("n").to_numpy(), b.column("lang").to_numpy(), len(p))
            yield from vector_rows(out.ravel())

        parts = summed_chunks(counted.mapInArrow(expect, "chunk int, data binary"), "float64", total=True)
        p = joined_chunks(parts, p.size, "float64").reshape(p.shape)
        p = p + 0.01 + (lattice.sizes == 1)  # no piece is impossible, single bytes least of all
        p /= p.sum(axis=1, keepdims=True)
    return langs, np.log([n / total for _, n in by_lang]), p


def identify_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: Column | None = None, pieces: Callable = public_pieces, rounds: int = 4, sample: int = 6000) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score (its posterior probability).

    Learns from rows where held_out isn't true (default: crc32(id as text) mod 5 is 0) and text and lang_col are not
    null, about `sample` of them. The prediction reads the text alone. A text that is null or has no letter is und, with
    score 0; so is every text if there is nothing to learn from. A null id counts as not held out; repeated rows give
    repeated rows; of languages with equal scores the first by name wins. Texts and words of any length are summed whole; a very long word takes some 200 bytes
    of memory and 10 microseconds for each of its bytes while it is learned from or scored. An empty table
    gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    stage = Stage(spark, "language")
    if held_out is None:
        held_out = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
    kind = dict(df.dtypes)[id_col]
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    langs, prior, p = fit(docs.filter("not held_out and text is not null and lang is not null").select("id", "text", "lang"), pieces, rounds, sample, stage)
    model = spark.sparkContext.broadcast((prior, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, p = model.value
        lattice = lattice_of(pieces)
        scaled = scaled_table(p, lattice.sizes) if langs else None
        cache_keys, cache = np.full(1 << 19, 2**64 - 1, np.uint64), np.zeros((1 << 19, max(1, len(langs))))
        for b, data, offsets in slices(batches, "text"):
            low = fold(data)
            letters = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
            has = letters[offsets[1:]] > letters[offsets[:-1]]
            high = np.concatenate([[0], np.cumsum(low >= 128)])
            for d in np.flatnonzero(~has & (high[offsets[1:]] > high[offsets[:-1]])):
                has[d] = bool(_LETTER.search(data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace")))
            best, score = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            if langs:
                w = words(low, offsets, folded=True)
                slot = (w.hash >> np.uint64(45)).astype(np.int64)
                values, miss = cache[slot], cache_keys[slot] != w.hash
                if miss.any():
                    keys, at, back = np.unique(w.hash[miss], return_index=True, return_inverse=True)
                    at = np.flatnonzero(miss)[at]
                    new = log_words(lattice, scaled, low, w.start[at], w.end[at])
                    values[miss] = new[back]
                    slot = (keys >> np.uint64(45)).astype(np.int64)
                    cache_keys[slot] = keys
                    there = cache_keys[slot] == keys
                    cache[slot[there]] = new[there]
                log = np.tile(prior, (b.num_rows, 1))
                some = np.flatnonzero(w.count)
                if len(some):
                    log[some] += np.add.reduceat(values, w.first[some], axis=0)  # of a document's own words alone, so equal texts have equal sums
                best = log.argmax(axis=1)
                score = 1 / np.exp(np.clip(log - log.max(axis=1, keepdims=True), -700, 0)).sum(axis=1)  # finite: every byte is a piece in every language
            known = has & bool(langs)
            names = [langs[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))], ["id", "held_out", "lang_pred", "score"])

    return docs.drop("lang").mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
