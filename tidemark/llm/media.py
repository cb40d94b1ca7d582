"""Media columns: signature sniffing of binary payloads.

An Aho-Corasick automaton finds magic bytes anywhere in a payload; a validator for the format then checks the
structure and gives the exact length. A payload whose first byte starts a valid object takes that object's
type, whatever was declared; valid objects further in are carved out. Everything is per row, in Arrow batches.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_place, slices

SAMPLE_RATE = 8000

# Magic bytes and media types of the formats.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"BM": "image/bmp",
    b"RIFF": "riff",
    b"OggS": "audio/ogg",
    b"MThd": "audio/midi",
    b"%PDF-": "application/pdf",
    b"\x1f\x8b\x08": "application/gzip",
    b"PK\x03\x04": "application/zip",
}
RIFF_TYPES = {b"WAVE": "audio/wav", b"AVI ": "video/avi", b"WEBP": "image/webp"}

KNOWN = {*MAGIC.values(), *RIFF_TYPES.values()} - {"riff"}


#: What stands at the end of objects whose length only their end tells.
MARKS = (b"PK\x05\x06", b"%%EOF", b"startxref")


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (kind, len(magic)))
    for mark in MARKS:
        a.add_word(mark.decode("latin-1"), (mark, len(mark)))
    a.make_automaton()
    return a


class Places:
    """Where magic bytes and end marks stand in a payload: found once, so that no validator searches the payload again."""

    def __init__(self, data: bytes, a: ahocorasick.Automaton):
        self.starts: list[tuple[str, int, int]] = []  # kind, place, length of the magic
        self.at: dict[bytes, list[int]] = {m: [] for m in (*MARKS, b"%PDF-")}
        for last, (kind, n) in a.iter(data.decode("latin-1")):
            if kind in self.at:
                self.at[kind].append(last - n + 1)
                continue
            self.starts.append((kind, last - n + 1, n))
            if kind == "application/pdf":
                self.at[b"%PDF-"].append(last - n + 1)
        #: Archives by their first byte: each end record says how far before it the archive begins; the first record counts.
        self.archives: dict[int, int] = {}
        for p in self.at[b"PK\x05\x06"]:
            if p + 22 <= len(data):
                size, start, note = struct.unpack_from("<IIH", data, p + 12)
                first = p - size - start
                if first >= 0 and data[first + start : first + start + 4] == b"PK\x01\x02" and p + 22 + note <= len(data):
                    self.archives.setdefault(first, p + 22 + note)

    def next(self, mark: bytes, at: int) -> int | None:
        """The first place of a mark from `at` on."""
        i = bisect_left(self.at[mark], at)
        return self.at[mark][i] if i < len(self.at[mark]) else None

    def last_before(self, mark: bytes, end: int | None) -> int:
        """The last place of a mark before `end`; there must be one."""
        return self.at[mark][(bisect_left(self.at[mark], end) if end is not None else len(self.at[mark])) - 1]


def _png(d: bytes, at: int, places: Places) -> tuple[str, int] | None:
    p, first = at + 8, True
    while p + 12 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, p)
        if p + 12 + n > len(d) or (first and (kind != b"IHDR" or n != 13)):
            return None
        if zlib.crc32(d[p + 4 : p + 8 + n]) != struct.unpack_from(">I", d, p + 8 + n)[0]:
            return None
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return "image/png", p - at
    return None


def _gif(d: bytes, at: int, places: Places) -> tuple[str, int] | None:
    if at + 13 > len(d):
        return None
    flags, p = d[at + 10], at + 13
    p += 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    def blocks(p: int) -> int:
        while p < len(d) and d[p]:
            p += d[p] + 1
        return p + 1

    images = 0
    while p < len(d):
        if d[p] == 0x3B:
            return ("image/gif", p + 1 - at) if images else None
        if d[p] == 0x21:
            p = blocks(p + 2)
        elif d[p] == 0x2C and p + 10 < len(d):
            local = d[p + 9]
            p = blocks(p + 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0))
            images += 1
        else:
            return None
    return None


def _jpeg(d: bytes, at: int, places: Places) -> tuple[str, int] | None:
    p, frame = at + 2, False
    while p + 4 <= len(d) and d[p] == 0xFF:
        if d[p + 1] == 0xFF:  # a fill byte
            p += 1
            continue
        marker, n = d[p + 1], struct.unpack_from(">H", d, p + 2)[0]
        if n < 2 or marker in (0x00, 0x01, 0xFF) or 0xD0 <= marker <= 0xD9:
            return None
        frame |= 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)
        p += 2 + n
        if marker == 0xDA:
            while (p := d.find(b"\xff", p)) >= 0 and p + 1 < len(d):
                if d[p + 1] == 0xD9:
                    return ("image/jpeg", p + 2 - at) if frame else None
                if d[p + 1] and not 0xD0 <= d[p + 1] <= 0xD7:
                    break
                p += 2
            if p < 0:
                return None
    return None


def _bmp(d: bytes, at: int, places: Places) -> tuple[str, int] | None:
    if at + 30 > len(d):
        return None
    size, zero, pixels, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", d, at + 2)
    if zero or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or header not in (40, 52, 56, 108, 124) or pixels < 14 + header or width <= 0 or not height:
        return None
    rows = (width * bits + 31) // 32 * 4 * abs(height)
    return ("image/bmp", size) if size <= len(d) - at and size >= pixels + (rows if struct.unpack_from("<I", d, at + 30)[0] == 0 else 1) else None


def _riff(d: bytes, at: int, places: Places) -> tuple[str, int] | None:
    if at + 12 > len(d):
        return None
    size, form = struct.unpack_from("<I4s", d, at + 4)
    end, p, names = at + 8 + size, at + 12, []
    if form not in RIFF_TYPES or end > len(d):
        return None
    while p + 8 <= end:
        name, n = struct.unpack_from("<4sI", d, p)
        p += 8 + n + (n & 1)
        names.append(name)
    if p != end or (form == b"WAVE" and not {b"fmt ", b"data"} <= set(names)):
        return None
    return RIFF_TYPES[form], end - at


def _ogg(d: bytes, at: int, places: Places) -> tuple[str, int] | None:
    p, last = at, False
    while d[p : p + 4] == b"OggS" and p + 27 <= len(d) and d[p + 4] == 0:
        table = d[p + 27 : p + 27 + d[p + 26]]
        last = bool(d[p + 5] & 4)
        p += 27 + d[p + 26] + sum(table)
        if p > len(d):
            return None
    return ("audio/ogg", p - at) if last else None


def _midi(d: bytes, at: int, places: Places) -> tuple[str, int] | None:
    if at + 14 > len(d):
        return None
    n, _, tracks, _ = struct.unpack_from(">IHHH", d, at + 4)
    p = at + 8 + n
    for _ in range(tracks):
        if d[p : p + 4] != b"MTrk" or p + 8 > len(d):
            return None
        p += 8 + struct.unpack_from(">I", d, p + 4)[0]
    return ("audio/midi", p - at) if n == 6 and tracks and p <= len(d) else None


def _pdf(d: bytes, at: int, places: Places) -> tuple[str, int] | None:
    end, ref = places.next(b"%%EOF", at), places.next(b"startxref", at)
    if end is None or ref is None or ref + 9 > end:
        return None
    return "application/pdf", places.last_before(b"%%EOF", places.next(b"%PDF-", end)) + 5 - at


def _gzip(d: bytes, at: int, places: Places) -> tuple[str, int] | None:
    z, p = zlib.decompressobj(31), at
    try:
        while p < len(d) and not z.eof:
            part = z.unconsumed_tail or d[p : p + (1 << 16)]
            p += 0 if z.unconsumed_tail else len(part)
            z.decompress(part, 1 << 20)
    except zlib.error:
        return None
    return ("application/gzip", p - len(z.unused_data) - at) if z.eof else None


def _zip(d: bytes, at: int, places: Places) -> tuple[str, int] | None:
    end = places.archives.get(at)
    return ("application/zip", end - at) if end is not None else None


VALIDATORS = {
    "image/png": _png,
    "image/gif": _gif,
    "image/jpeg": _jpeg,
    "image/bmp": _bmp,
    "riff": _riff,
    "audio/ogg": _ogg,
    "audio/midi": _midi,
    "application/pdf": _pdf,
    "application/gzip": _gzip,
    "application/zip": _zip,
}


def sniff(data: bytes, a: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the valid objects in data, in order. One that starts at 0 may hold others."""
    found, reach = [], 0
    places = Places(data, a)
    for kind, at, n in places.starts:
        if at >= reach and (hit := VALIDATORS[kind](data, at, places)):
            found.append((hit[0], at, hit[1]))
            reach = at + (n if at == 0 else hit[1])
    return found


def judged(data: bytes | None, said: str | None, a: ahocorasick.Automaton) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The detected type of a payload that is declared as `said`, and the objects to carve out of it."""
    if data is None:
        return None, []
    found = sniff(data, a)
    if found and found[0][1] == 0:
        return found[0][0], found[1:]
    return said if data and said and said not in KNOWN else "application/octet-stream", found


def sniff_media(df: DataFrame, media_col: str = "media", declared_col: str = "declared_type") -> DataFrame:
    """Adds detected_type, type_corrected and embedded (type, offset, length of what is carved out) to df.

    detected_type is the validated type at offset 0, else the declared type if nothing contradicts it: no
    validator knows it. A payload declared as a known type that fails its validator is application/octet-stream.
    A null payload has a null detected_type and no embedded objects. An empty one is application/octet-stream.
    Columns of df with these names are replaced. Magic bytes and end marks are found in one scan of a payload, however long; formats whose
    length only a walk over their parts tells are walked once for each place that starts like them. Repeated rows are judged one by one, and
    an empty table gives an empty result.
    """
    names = [c for c in df.columns if c not in ("detected_type", "type_corrected", "embedded")]
    plain, places, fields = by_place(df, names)
    schema = ", ".join([fields, "detected_type string, type_corrected boolean, embedded array<struct<type:string,offset:bigint,length:bigint>>"])
    item = pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for b in batches:
            kinds, changed, inner = [], [], []
            media, declared = b.column(names.index(media_col)), b.column(names.index(declared_col)).to_pylist()
            for value, said in zip(media, declared, strict=True):
                kind, found = judged(value.as_py(), said, a)
                kinds.append(kind)
                changed.append(kind != said if kind is not None else None)
                inner.append([{"type": t, "offset": o, "length": n} for t, o, n in found])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kinds, pa.string()), pa.array(changed, pa.bool_()), pa.array(inner, pa.list_(item))], [*places, "detected_type", "type_corrected", "embedded"])

    return plain.mapInArrow(run, schema).toDF(*names, "detected_type", "type_corrected", "embedded")


def carved_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", declared_col: str = "declared_type") -> DataFrame:
    """(id_col, place bigint, type, offset, length, media): the bytes of each object embedded in a payload, a row for each, in order from place 0.

    What is carved is what sniff_media lists as embedded: valid objects that don't start the payload. A null or empty payload, or one without such objects, gives no row;
    repeated rows give theirs again. Payloads are cut one at a time, and rows go out by some 4 MB.
    """
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for i, (value, said) in enumerate(zip(b.column("media"), b.column("said").to_pylist(), strict=True)):
                data = value.as_py()
                for place, (t, at, n) in enumerate(judged(data, said, a)[1]):
                    rows.append((i, place, t, at, n, data[at : at + n]))
                    held += n
                    if held > 4 << 20:
                        yield _carved(b, rows)
                        rows, held = [], 0
            if rows:
                yield _carved(b, rows)

    ready = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{media_col}`").alias("media"), F.col(f"`{declared_col}`").alias("said"))
    return ready.mapInArrow(run, f"id {kind}, place bigint, type string, offset bigint, length bigint, media binary").withColumnRenamed("id", id_col)


def _carved(b: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    at, *rest = zip(*rows, strict=True)
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), *(pa.array(c, t) for c, t in zip(rest, kinds, strict=True))], ["id", "place", "type", "offset", "length", "media"])


def wav(payload: bytes) -> bytes:
    """Mono 8-bit PCM. The payload's length must be even."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", len(payload)) + payload


def wav_payload(media: bytes) -> bytes:
    """The samples of a WAV file, found by walking its chunks."""
    p = 12
    while p + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, p)
        if name == b"data":
            return media[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("no data chunk")


#: Spark and Arrow hold at most so many bytes in one value.
MOST_BYTES = (1 << 31) - 1


def stored(raw: bytes) -> bytes | None:
    """A text's UTF-8 bytes, zero-padded to a positive multiple of 64, as WAV samples; None if that is more than a value can hold."""
    size = max(64, -(-len(raw) // 64) * 64)
    return wav(raw + bytes(size - len(raw))) if size + 44 <= MOST_BYTES else None


def text_as_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media, declared_type): each text's UTF-8 bytes, zero-padded to a positive multiple of 64, as WAV samples.

    A null text is empty. A text so long that its samples and header are over 2 GB, the most that a value can have, gets null media.
    The declared type is wrong on purpose: the sniffer has to correct it. Repeated rows give repeated rows.
    """
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offsets in slices(batches, "text"):
            raw = data.tobytes()
            media = [stored(raw[lo:hi]) for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(media, pa.binary()), pa.array(["image/png"] * b.num_rows)], ["id", "n_bytes", "media", "declared_type"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes bigint, media binary, declared_type string")
    return out.withColumnRenamed("id", id_col)


def described(media: bytes | None) -> tuple:
    """(payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of stored samples, read back from the file's chunks."""
    if media is None:
        return (None,) * 6
    payload = wav_payload(media)
    x = np.frombuffer(payload, np.uint8)
    hist = np.bincount(x, minlength=256)
    mean = int(hist @ np.arange(256)) / max(1, len(x))
    loud = x >= 97
    feature = f"wav8;rate={SAMPLE_RATE};n={len(x)};mean={mean:.4f};peak={int(x.max(initial=0))};levels={int((hist > 0).sum())};crossings={int(np.count_nonzero(loud[1:] != loud[:-1]))}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


FEATURES = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
FEATURE_SCHEMA = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


#: What the sniffer says of a stored form.
JUDGED = ["detected_type", "type_corrected", "n_embedded", "embedded_types"]
JUDGED_SCHEMA = "detected_type string, type_corrected boolean, n_embedded bigint, embedded_types string"


def media_features(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads the samples of sniffed WAV media back and describes them; one row per input row.

    n_embedded and embedded_types (in order, by commas) say what the sniffer carved out of the stored form. Null media has null features.
    Media of another detected type than audio/wav raises: its samples can't be told.
    """
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = b.column("detected_type").to_pylist()
            if any(k not in (None, "audio/wav") for k in kinds):
                raise ValueError("the stored form is no valid WAV")
            rows = [described(m.as_py()) for m in b.column("media")]
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(FEATURES.values())]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), *cols, b.column("detected_type"), b.column("type_corrected"), b.column("n_embedded"), b.column("embedded_types")], ["id", "n_bytes", *FEATURES, *JUDGED])

    inner = F.when(F.col("detected_type").isNotNull(), F.col("embedded"))
    ready = df.select(F.col(f"`{id_col}`").alias("id"), "n_bytes", "media", "detected_type", "type_corrected", F.when(inner.isNotNull(), F.size(inner)).cast("bigint").alias("n_embedded"), F.array_join(inner["type"], ",").alias("embedded_types"))
    return ready.mapInArrow(run, f"id {kind}, n_bytes bigint, {FEATURE_SCHEMA}, {JUDGED_SCHEMA}").withColumnRenamed("id", id_col)


def text_media_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What media_features(sniff_media(text_as_media(df))) gives, in one pass: payloads are stored, sniffed and read back in the task that has the text.

    A null text is empty and gives one block of zeros. Equal texts have equal values; repeated rows and ids give a row each. A text over the 2 GB that
    a stored value may have gets null features. An empty table gives an empty result; other columns are ignored.
    """
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for b, data, offsets in slices(batches, "text"):
            rows, kinds, inner = [], [], []
            for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
                media = stored(data[lo:hi].tobytes())
                detected, found = judged(media, "image/png", a)
                if media is not None and detected != "audio/wav":
                    raise ValueError("the stored form is no valid WAV")
                kinds.append(detected)
                inner.append(None if media is None else [t for t, _, _ in found])
                rows.append(described(media))
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(FEATURES.values())]
            changed = [k != "image/png" if k is not None else None for k in kinds]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(offsets).astype(np.int64)), *cols, pa.array(kinds, pa.string()), pa.array(changed, pa.bool_()), pa.array([None if x is None else len(x) for x in inner], pa.int64()), pa.array([None if x is None else ",".join(x) for x in inner], pa.string())], ["id", "n_bytes", *FEATURES, *JUDGED])

    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return docs.mapInArrow(run, f"id {kind}, n_bytes bigint, {FEATURE_SCHEMA}, {JUDGED_SCHEMA}").withColumnRenamed("id", id_col)
