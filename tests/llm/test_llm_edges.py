"""Odd inputs of the corpus operators: repeated and null ids, clashing names, ties, long words, hostile payloads."""

import hashlib
import math
import random
import struct
import time
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.llm import common, language, media
from tidemark.llm.exact_dedup import keep_first_copies
from tidemark.llm.jaccard import jaccard_link_counts, keep_one_per_component
from tidemark.llm.mixing import apply_rates, mix_documents, mixing_rates
from tidemark.llm.url_filter import url_filter

NAMES = ("doc", "row", "key", "id", "rate", "_id", "_row", "_gone", "_times", "copy", "text2", "carried", "posterior")


def with_clashes(df):
    return df.withColumns({n: F.lit(f"my {n}") for n in NAMES})


def prose(rng, n):
    return " ".join(f"w{rng.randrange(300)}" for _ in range(n))


def rest_is_unchanged(out, df):
    assert out.columns == df.columns
    assert all(r[n] == f"my {n}" for r in out.collect() for n in NAMES)


def test_shared_dir_is_never_local_on_a_cluster():
    said = {"path": None}
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: said["path"], setCheckpointDir=lambda p: said.update(path=p))
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(session)
    context.master = "local[4]"
    assert common.shared_dir(session) == said["path"]


def test_first_copies_keep_columns_of_any_name(spark):
    df = with_clashes(spark.createDataFrame([(1, "A"), (2, "a"), (2, "b"), (None, "B"), (None, None), (3, "")], "doc_id bigint, text string"))
    out = keep_first_copies(df)
    rest_is_unchanged(out, df)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(2, "a"), (2, "b"), (3, "")])


def test_one_of_each_component_stays_by_row(spark):
    rng = random.Random(3)
    t, other = prose(rng, 60), prose(rng, 60)
    near = t + " edited"
    rows = [(2, t), (5, near), (5, other), (2, t), (None, near), (None, "alone here"), (7, None), (7, None), (8, "")]
    df = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    out = keep_one_per_component(df)
    rest_is_unchanged(out, df)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(2, t), (5, other), (None, "alone here"), (7, None), (7, None), (8, "")])


def test_nulls_only_components_keep_one(spark):
    t = prose(random.Random(4), 40)
    df = spark.createDataFrame([(None, t), (None, t + " x")], "doc_id bigint, text string")
    assert keep_one_per_component(df).count() == 1


def test_link_counts(spark):
    """Every link between different texts counts, also inside a group of near copies; equal sets count as links."""
    rng = random.Random(31)
    base = prose(rng, 60).split()
    rows = [(200, None), (201, "  "), (202, "one two"), (203, "ONE two"), (204, " ".join(base)), (205, " ".join(base).upper()), (205, prose(rng, 30))]
    for i in range(60):
        v = list(base)
        for _ in range(rng.randrange(3)):
            v[rng.randrange(60)] = f"e{rng.randrange(20)}"
        rows.append((i, " ".join(v[rng.randrange(3) :])))
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    want = Counter()
    for i, (doc, _) in enumerate(rows):
        linked = sum(j != i and bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in range(len(rows)))
        want[(doc, len(sets[i]), min(d for (d, _), s in zip(rows, sets, strict=True) if s == sets[i]) if sets[i] else doc, linked)] += 1
    got = jaccard_link_counts(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert Counter(tuple(r) for r in got.select("doc_id", "n_shingles", "class_id", "n_links").collect()) == want


def test_rates_of_repeated_ids_and_clashing_names(spark):
    df = with_clashes(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, "e")], "doc_id bigint, text string"))
    rates = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 0.0), (None, 9.0)], "doc_id bigint, rate double")
    out = apply_rates(df, rates)
    rest_is_unchanged(out, df)
    assert Counter(r.text for r in out.collect()) == Counter({"a": 2, "b": 2, "d": 1, "e": 1})


def test_mixed_documents_keep_rows_and_columns(spark):
    rng = random.Random(6)
    rows = [(i % 150, prose(rng, 60) + (" rouge" * 5 if i % 4 == 0 else " red" * 5)) for i in range(300)] + [(None, "red red"), (400, None), (401, "red " * 30000)]
    df = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    labels = spark.createDataFrame([(i, "fr" if i % 4 == 0 else "en") for i in range(0, 150, 2)], "doc_id bigint, domain string")
    out = mix_documents(df, labels, {"en": 1, "fr": 1}, floor=1.0).cache()
    rest_is_unchanged(out, df)
    assert {(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()} == set(rows)


def brute_rates(tokens, posterior, goal):
    """The point nearest to rate 1, weighted by tokens, that meets the goal with no rate below 0: by its multipliers."""
    lam = np.zeros(len(goal))
    for _ in range(20000):
        rate = np.maximum(0, 1 - posterior @ lam)
        miss = (tokens * rate) @ posterior - goal
        lam += 0.5 * miss / tokens.sum()
        if np.abs(miss).max() < 1e-9 * tokens.sum():
            break
    return rate


def test_rates_equal_a_reference_solver(spark):
    """Projected gradient, whitened, against a plain dual ascent in numpy on the same posteriors."""
    rng = random.Random(16)
    rows = [(i, prose(rng, rng.randrange(20, 90)) + (" rouge" * 6 if i % 3 == 0 else " red" * 6)) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, "fr" if i % 3 == 0 else "en") for i in range(0, 240, 2)], "doc_id bigint, domain string")
    got = sorted(mixing_rates(docs, labels, {"en": 1, "fr": 1}, close=1e-9, rounds=200).collect(), key=lambda r: r.doc_id)
    tokens, posterior = np.array([r.n_tokens for r in got], float), np.array([r.posterior for r in got])
    want = brute_rates(tokens, posterior, tokens.sum() * np.array([0.5, 0.5]))
    assert np.abs(np.array([r.rate for r in got]) - want).max() < 1e-3


def test_url_rules_of_equal_length(spark):
    rules = spark.createDataFrame([("a.com", "/", "allow"), ("com", "/xx", "allow"), ("b.com", "/y", "allow"), ("com", "/zzz", "block"), ("org", None, "allow"), ("org", "", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/xx/1"), (2, "http://q.b.com/yes"), (3, "http://b.com/zzz"), (4, "http://x.org"), (5, "http://a.com/" + "p" * 100000)], "page_id bigint, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter(pages, rules).collect()}
    assert got == {1: ("a.com/", "allow"), 2: ("b.com/y", "allow"), 3: ("com/zzz", "block"), 4: ("org", "block"), 5: ("a.com/", "allow")}
    tie = spark.createDataFrame([("a.com", "/", "allow"), ("com", "/xx", "block")], "host string, path string, verdict string")
    assert [tuple(r)[3:] for r in url_filter(pages.filter("page_id = 1"), tie).collect()] == [("com/xx", "block")]


def test_sniffing_is_linear_in_false_hits():
    a = media.automaton()
    for part in (b"PK\x03\x04", b"%PDF-", b"PK\x05\x06" + bytes(18), b"%PDF-startxref"):
        began = time.perf_counter()
        assert media.sniff(part * (400_000 // len(part)), a) == []
        assert time.perf_counter() - began < 5


def test_sniffer_takes_the_last_end_of_a_pdf_and_the_right_archive():
    import io
    import zipfile

    a = media.automaton()
    pdf = b"%PDF-1.4 x startxref 0 %%EOF more startxref 9 %%EOF"
    assert media.sniff(pdf + b"..." + pdf, a) == [("application/pdf", 0, len(pdf)), ("application/pdf", len(pdf) + 3, len(pdf))]
    assert media.sniff(b"%PDF-1.4 %%EOF startxref", a) == []
    zips = []
    for name in ("a", "bb"):
        f = io.BytesIO()
        with zipfile.ZipFile(f, "w") as z:
            z.writestr(name, name * 50)
        zips.append(f.getvalue())
    data = b"PK\x03\x04junk" + zips[0] + b"??" + zips[1]
    assert media.sniff(data, a) == [("application/zip", 8, len(zips[0])), ("application/zip", 10 + len(zips[0]), len(zips[1]))]


def test_media_report_equals_the_three_steps(spark):
    rows = [(1, "Abc xyz"), (1, "Abc xyz"), (None, None), (2, ""), (3, "é" * 40000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("media", F.lit("clash")).withColumn("n_bytes", F.lit(-1))
    steps = media.media_features(media.sniff_media(media.text_as_media(df)))
    report = media.text_media_report(df)
    assert report.columns == steps.columns
    assert Counter(map(tuple, report.collect())) == Counter(map(tuple, steps.collect()))
    got = {r.doc_id: r for r in report.collect()}
    payload = b"Abc xyz" + bytes(57)
    x = list(payload)
    turns = sum((p >= 97) != (q >= 97) for p, q in zip(x, x[1:], strict=False))
    assert got[1].feature == f"wav8;rate=8000;n=64;mean={sum(x) / 64:.4f};peak={max(x)};levels={len(set(x))};crossings={turns}"
    assert got[1].payload_sha256 == hashlib.sha256(payload).hexdigest() and got[1].tail_crc32 == zlib.crc32(payload)
    assert got[2].payload_bytes == 64 and got[2].feature == got[None].feature
    assert media.described(None) == (None,) * 6 and struct.unpack_from("<I", media.stored(b""), 40)[0] == 64


def test_long_words_and_long_pieces_are_summed_whole():
    pieces = sorted({bytes([b]) for b in range(97, 101)} | {b" ", b" a", b"ab", b"abcdabcdabcdabcd", b"bcdabcdabcdabc", b"cdab"})
    lattice, rng = language.Lattice(pieces), np.random.default_rng(1)
    p = rng.random((2, len(pieces)))
    p /= p.sum(axis=1, keepdims=True)

    def brute(w, k):
        sums = [1.0] + [0.0] * len(w)
        for e in range(1, len(w) + 1):
            sums[e] = sum(p[k][i] * sums[e - len(q)] for i, q in enumerate(pieces) if w[:e].endswith(q))
        return math.log(sums[-1])

    texts = [b"abcd" * 15 + b"ab", b"abcdabcdabcdabcd", b"abcd" * 30, b"a", b"dcba" * 3, b"bcdabcdabcdabcabcd" * 4]
    data = np.frombuffer(b" ".join(texts), np.uint8)
    w, scaled = common.words(data, np.array([0, len(data)])), language.scaled_table(p, lattice.sizes)
    got = language.log_words(lattice, scaled, data, w.start, w.end)
    assert np.allclose(got, [[brute(b" " + t, k) for k in (0, 1)] for t in texts], rtol=1e-9)
    counts = language.expected_counts(lattice, scaled, data, w.start, w.end, np.ones(len(texts)), np.zeros(len(texts), int), 2)
    assert abs((counts[0] * lattice.sizes).sum() - sum(len(t) + 1 for t in texts)) < 1e-6


def test_scores_stay_finite_on_unlikely_bytes():
    pieces = sorted({bytes([b]) for b in range(256)} | {b"th"})
    lattice = language.Lattice(pieces)
    p = np.full((2, len(pieces)), 1e-10)
    for n in (30, 48, 49, 3000):
        data = np.frombuffer("Ж".encode() * n, np.uint8)
        got = language.log_words(lattice, language.scaled_table(p, lattice.sizes), data, np.array([0]), np.array([len(data)]))
        assert np.allclose(got, (2 * n + 1) * math.log(1e-10), rtol=1e-6)


LONG = [" " * 1_200_000, "\n" * 1_100_000 + "end", "a" * 1_500_000, "!?" * 600_000, "ab1\t" * 300_000, "é" * 1_000_000, " \n\t" * 400_000 + "x y"]


def test_texts_that_the_faster_encoder_refuses_are_packed(spark):
    """Long runs of blanks, line ends, one letter, signs: the same ids as the tokenizer file gives, in pieces without a gap."""
    import public_tokenizers as P
    from tidemark.llm.packing import pack
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = pack(spark.createDataFrame(list(enumerate(LONG)), "doc_id bigint, text string")).toPandas()
    for i, text in enumerate(LONG):
        ids = np.array([*slow.encode(text, add_special_tokens=False).ids, 2], "<u4")
        mine = got[got.doc_id == i].sort_values("piece")
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine.start, mine.length, strict=True)] == mine.ids_crc32.tolist()
        assert mine.length.sum() == len(ids) and mine.length.max() <= 1024


def test_carved_bytes_are_the_embedded_objects(spark):
    """Texts stored as media hold ASCII objects too; what is carved out of any payload is the object, byte for byte."""
    pdf = b"%PDF-1.4 x startxref 0 %%EOF"
    gif = b"GIF89a\x01\x00\x01\x00\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
    rows = [(1, gif + b"--" + pdf + gif, "image/gif"), (2, b"no object", None), (None, pdf + pdf, "text/plain"), (3, None, None), (3, b"x" + gif, None), (3, b"x" + gif, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, media binary, declared_type string").withColumn("a.b", F.lit(1)).withColumn("place", F.lit("clash"))
    got = Counter((r.doc_id, r.place, r.type, r.offset, r.length, bytes(r.media)) for r in media.carved_media(df).collect())
    n, m = len(gif), len(pdf)
    want = [(1, 0, "application/pdf", n + 2, m, pdf), (1, 1, "image/gif", n + 2 + m, n, gif), (None, 0, "application/pdf", m, m, pdf), *[(3, 0, "image/gif", 1, n, gif)] * 2]
    assert got == Counter(want)
    assert media.carved_media(df.limit(0)).count() == 0
    assert Counter((r.doc_id, len(r.embedded)) for r in media.sniff_media(df).collect()) == Counter([(1, 2), (2, 0), (None, 1), (3, 0), (3, 1), (3, 1)])
    texts = spark.createDataFrame([(1, "see %PDF-1.4 x startxref 0 %%EOF and more"), (2, None)], "doc_id bigint, text string").withColumn("a.b", F.lit(1))
    report = {r.doc_id: (r.n_embedded, r.embedded_types) for r in media.text_media_report(texts).collect()}
    assert report == {1: (1, "application/pdf"), 2: (0, "")}


def test_jpeg_with_fill_bytes():
    plain = b"\xff\xd8" + b"\xff\xc0\x00\x0b\x08\x00\x01\x00\x01\x01\x01\x11\x00" + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + b"abc\xff\xd9"
    filled = plain.replace(b"\xff\xda", b"\xff\xff\xff\xda")
    a = media.automaton()
    assert media.sniff(plain, a) == [("image/jpeg", 0, len(plain))] and media.sniff(filled, a) == [("image/jpeg", 0, len(filled))]


def test_ordinal_gradient_is_that_of_the_likelihood():
    """The gradient against finite differences of the loss as it is written down, and the scores against the same formula."""
    from tidemark.llm.quality import OrdinalModel, _cuts, ordinal_gradient

    rng = np.random.default_rng(3)
    n, dims, k, shrink = 40, 9, 3, 0.01
    owner = np.sort(rng.integers(0, n, 150)).astype(np.int32)
    feature, grade = rng.integers(0, dims, 150), rng.integers(0, k + 1, n)

    def tails(p):
        theta, out = [p[0]], []
        for gap in p[1:k]:
            theta.append(theta[-1] + math.exp(gap))
        for i in range(n):
            f = sum(p[k + feature[j]] for j in range(len(owner)) if owner[j] == i)
            out.append([1.0, *(1 / (1 + math.exp(t - f)) for t in theta), 0.0])
        return out

    def loss(p):
        return -sum(math.log(t[g] - t[g + 1]) for t, g in zip(tails(p), grade, strict=True)) / n + shrink / 2 * sum(w * w for w in p[k:])

    p = rng.normal(0, 0.7, k + dims)
    got = ordinal_gradient(p, k, grade, owner, feature, shrink)
    for i in range(len(p)):
        up, down = p.copy(), p.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - got[i]) < 1e-7
    at = np.searchsorted(owner, np.arange(n + 1))
    scores = OrdinalModel(p[k:], _cuts(p, k)).tails(feature, at)
    assert np.allclose(scores, np.array(tails(p))[:, 1:-1])


def test_quality_keeps_columns_with_dots(spark):
    from tidemark.llm.quality import quality_scores

    df = spark.createDataFrame([(1, "good words"), (2, None)], "doc_id bigint, text string").withColumn("a.b", F.lit("mine"))
    out = quality_scores(df, spark.createDataFrame([(1, 1)], "doc_id bigint, grade int"), n_grades=2, accept=1)
    assert out.count() == 2 and out.columns[:3] == ["doc_id", "text", "a.b"]


def test_counts_of_long_words_equal_those_of_short_ones(monkeypatch):
    """Both ways through expected_counts agree; a word of 300,000 bytes takes seconds and its counts add up to its length."""
    pieces = sorted({bytes([b]) for b in range(97, 123)} | {b" ", b" a", b"ab", b"abcdabcdabcdabcd", b"bcda", b"cd", b"zzzzzzzz"})
    lattice, rng = language.Lattice(pieces), np.random.default_rng(2)
    p = rng.random((2, len(pieces)))
    p /= p.sum(axis=1, keepdims=True)
    scaled = language.scaled_table(p, lattice.sizes)
    texts = [b"abcd" * 9 + b"ab", b"abcdabcdabcdabcd", b"zz" * 20, b"q", bytes(97 + int(x) for x in rng.integers(0, 26, 40))]
    data = np.frombuffer(b" ".join(texts), np.uint8)
    w, times, lang = common.words(data, np.array([0, len(data)])), np.array([1, 3, 2, 5, 1]), np.array([0, 1, 1, 0, 1])
    want = language.expected_counts(lattice, scaled, data, w.start, w.end, times, lang, 2)
    monkeypatch.setattr(language, "LONG", 0)
    got = language.expected_counts(lattice, scaled, data, w.start, w.end, times, lang, 2)
    assert np.allclose(got, want, rtol=1e-9)
    long = np.frombuffer(b"abcdq" * 60_000, np.uint8)
    began = time.time()
    n = language.expected_counts(lattice, scaled, long, np.array([0]), np.array([len(long)]), np.array([1]), np.array([0]), 2)
    assert time.time() - began < 20
    assert abs((n[0] * lattice.sizes).sum() / (len(long) + 1) - 1) < 1e-9 and not n[1].any()


def test_equal_texts_score_alike_among_any_neighbours(spark):
    rng = random.Random(12)
    same = prose(rng, 400)
    rows = [(i, same if i % 3 == 0 else prose(rng, rng.randrange(1, 900)), "en" if i % 2 else "de") for i in range(60)]
    got = language.identify_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3))
    assert len({r.score for r in got.collect() if r.doc_id % 3 == 0}) == 1
