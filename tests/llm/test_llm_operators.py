import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tidemark.llm import common, ctw, language, media, packing
from tidemark.llm.components import components
from tidemark.llm.exact_dedup import exact_dedup, keep_first_copies
from tidemark.llm.jaccard import jaccard_components, keep_one_per_component
from tidemark.llm.language import identify_languages
from tidemark.llm.mixing import apply_rates, mixing_rates
from tidemark.llm.quality import OrdinalModel, quality_scores
from tidemark.llm.suffix import repeated_passages
from tidemark.llm.url_filter import url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns that a careless operator could mistake for its own.
CLASH = {"id": "a", "rid": "b", "keys": "c", "digit": "d", "_row": "e"}


def fold(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def words(text):
    return WORD.findall(fold(text))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, shared passages, nulls, empties, ties, repeated rows, one very long text, odd characters."""
    rng = random.Random(7)
    base = [prose(rng, rng.randrange(30, 200)) for _ in range(25)]
    texts = list(base)
    for k in range(10):
        w = base[k].split()
        for _ in range(2):
            v = list(w)
            v[rng.randrange(len(v))] = "edited"
            texts.append(" ".join(v))
        texts.append(base[k].upper() if k % 2 else base[k])
    passage = prose(rng, 70, 5000)
    texts += [f"{prose(rng, 40)} {passage} {prose(rng, 30)}" for _ in range(4)]
    texts += [None, "", "   ", "one two", "ONE\ttwo", "naïve Ä x", "same same " * 60, prose(rng, 30000, 3000), "a", "a"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(3, base[3]), (None, base[4]), (None, "only here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()}).cache(), rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def test_words_and_hashes():
    texts = ["Hello  World", None, "", "hello world", " x\ty\n", "ÄÖ b"]
    data, offsets = common.text_buffers(pa.array(texts))
    w = common.words(data, offsets)
    assert w.count.tolist() == [len(words(t)) for t in texts]
    assert w.hash[0] == w.hash[2] and w.hash[1] == w.hash[3] and len(set(w.hash.tolist())) == 6
    for n in (3, 9):
        h = common.mix(np.arange(40, dtype=np.uint64) % np.uint64(13))
        g = common.gram_hashes(h, n)
        same = {tuple(h[i : i + n]): g[i] for i in range(len(g))}
        assert all(same[tuple(h[i : i + n])] == g[i] for i in range(len(g))) and len(set(same.values())) == len(same)


def test_key_filter_has_no_false_misses(spark):
    keys = [random.Random(1).randrange(-(2**63), 2**63) for _ in range(1)] + list(range(2000))
    f = common.KeyFilter.of(spark.createDataFrame([(k,) for k in keys], "k bigint"), "k", len(keys))
    assert f.hits(np.array(keys, np.int64).view(np.uint64)).all()
    others = np.arange(10_000, 30_000, dtype=np.uint64)
    assert f.hits(others).mean() < 0.02


def test_components(spark, tmp_path):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5), (7, None)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a bigint, b bigint"), common.Stage(spark, "t"), "c").collect()
    assert {r.node: r.root for r in got} == {x: find(x) for x in root}


# exact dedup


def test_exact_dedup(corpus):
    df, rows = corpus
    groups = defaultdict(list)
    for i, t in rows:
        groups[fold(t)].append(i)
    for digit, growth in ((24, 20), (2, 3)):
        got = exact_dedup(df, first_digit=digit, growth=growth).collect()
        key = lambda i: (i is not None, i)
        want = Counter()
        for t, ids in groups.items():
            sha = hashlib.sha256(t.encode()).hexdigest()
            best = max(ids, key=key)
            want.update((i, best, len(ids), sha) for i in ids)
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        kept = Counter(r.text_sha256 for r in got if r.kept)
        assert len(kept) == len(groups) and set(kept.values()) == {1}
        assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_keep_first_copies(corpus, empty):
    df, rows = corpus
    out = keep_first_copies(df)
    assert out.columns == df.columns
    assert Counter(fold(r.text) for r in out.collect()) == Counter({fold(t) for _, t in rows})
    assert exact_dedup(empty).count() == 0 and keep_first_copies(empty).count() == 0


# n-gram Jaccard join


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[find(i)].append(doc)
    return Counter((doc, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None) if sets[i] else doc) for i, (doc, _) in enumerate(rows))


def test_jaccard_components(corpus, empty):
    df, rows = corpus
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect()) == brute_components(rows)
    assert jaccard_components(empty).count() == 0


def test_jaccard_links_of_random_near_copies(spark):
    """Many edits of one text, so that links and misses lie around the threshold, and a hub alone doesn't find all."""
    rng = random.Random(11)
    base = prose(rng, 60, 10000).split()
    rows = []
    for i in range(120):
        v = list(base)
        for _ in range(rng.randrange(4)):
            v[rng.randrange(60)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(v[rng.randrange(3) :])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect()) == brute_components(rows)


def test_keep_one_per_component(corpus):
    df, rows = corpus
    kept = [r.doc_id for r in keep_one_per_component(df).collect()]
    want = {c for _, _, c in brute_components(rows)}
    assert {k for k in kept if k is not None} == {c for c in want if c is not None}


# repeated passages


def brute_passages(texts, least):
    """By document: the words of windows kept here, and those of windows kept elsewhere; and the windows that occur more than once."""
    where = defaultdict(set)
    for i, lists in texts.items():
        for w in lists:
            for k in range(len(w) - least + 1):
                where[tuple(w[k : k + least])].add((i, k))
    repeated = {w: min(places) for w, places in where.items() if len(places) > 1}
    here, elsewhere = defaultdict(set), defaultdict(set)
    for w, first in repeated.items():
        for i, k in where[w]:
            (here if (i, k) == first else elsewhere)[i] |= set(range(k, k + least))
    return here, elsewhere, repeated, where


def check_passages(df, raw, least):
    """raw: texts by id, each a list of the id's different texts."""
    here, elsewhere, repeated, where = brute_passages({i: [words(t) for t in ts] for i, ts in raw.items()}, least)
    kept, gone = defaultdict(set), defaultdict(set)
    for r in repeated_passages(df, least=least).collect():
        span = set(range(r.start_word, r.start_word + r.n_words))
        mine = kept if r.kept else gone
        assert not span & mine[r.doc_id] and r.first_id <= r.doc_id and (r.first_id == r.doc_id or not r.kept)
        mine[r.doc_id] |= span
        if len(raw[r.doc_id]) == 1:
            piece = (raw[r.doc_id][0] or "").encode()[r.start_byte : r.end_byte].decode()
            assert len(WORD.findall(piece)) == r.n_words
    assert kept == {i: x for i, x in here.items() if x}
    assert {i: x for i, x in gone.items() if x} == {i: x - here[i] for i, x in elsewhere.items() if x - here[i]}
    for w, (i, k) in repeated.items():
        assert not set(range(k, k + least)) & gone[i]  # what is kept stays whole


def test_repeated_passages(corpus, empty):
    df, rows = corpus
    raw = defaultdict(list)
    for i, t in rows:
        if i is not None and t not in raw[i]:
            raw[i].append(t)
    check_passages(df, raw, 40)
    assert repeated_passages(empty).count() == 0


def test_repeated_passages_keep_each_window_once(spark):
    """Copies that hold a passage of another document, chains of overlaps, repeats within one document, edits in the middle of copies."""
    rng, least = random.Random(21), 40
    a, b, c, d = (prose(rng, n, 10**6) for n in (60, 70, 90, 45))
    docs = {1: f"x {a}", 3: f"{b} {a} {c}", 5: f"{b} {a} {c}", 6: f"{c} {d}", 7: f"{a} {b} y {d}", 2: f"{d} {d} {a}", 9: b, 10: f"{c} {d} {a} {b}"}
    docs |= {11: f"{a} z {a} q {a}", 12: "same " * 130, 13: f"{b}\t\n {c.upper()}", 14: "  ".join(c.split())}
    pool = [prose(rng, 25, 10**6) for _ in range(12)]
    docs |= {i: " ".join(rng.choice(pool) for _ in range(rng.randrange(2, 9))) for i in range(20, 50)}
    long = prose(rng, 300, 10**6).split()
    for i in range(60, 90):
        v = list(long)
        for _ in range(rng.randrange(4)):
            v[rng.randrange(300)] = f"edit{i}"
        docs[i] = " ".join(v[rng.randrange(20) : 300 - rng.randrange(20)])
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    check_passages(df, {i: [t] for i, t in docs.items()}, least)
    check_passages(df.repartition(7).withColumn("id", F.lit(1)).withColumn("hash", F.lit("x")), {i: [t] for i, t in docs.items()}, 50)


# quality


def test_ordinal_model_learns_order_and_tails_sum():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 3, 600)
    x = [np.unique(np.concatenate([rng.integers(0, 50, 5), [100 + g]])) for g in grade]
    at = np.concatenate([[0], np.cumsum([len(v) for v in x])])
    m = OrdinalModel.fit(np.concatenate(x), at, grade, 3)
    assert m.thresholds[0] < m.thresholds[1]
    tails = m.tails(np.concatenate(x), at)
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert (np.rint(tails.sum(axis=1)) == grade).mean() > 0.97


def test_quality_scores(spark, corpus, empty):
    rng = random.Random(5)
    rows = [(i, prose(rng, 50) + (" vile" if i % 3 == 0 else " fine")) for i in range(300)] + [(None, None), (300, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("kept", F.lit("clash"))
    ratings = spark.createDataFrame([(i, 0 if i % 3 == 0 else 2) for i in range(200)] + [(None, 1), (5, None), (6, 9)], "doc_id bigint, grade int")
    got = quality_scores(docs, ratings, 3, 2).collect()
    assert len(got) == len(rows)
    right = [r.kept == (r.doc_id % 3 != 0) for r in got if r.doc_id is not None and r.doc_id < 300]
    assert sum(right) > 0.95 * len(right)
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in got)
    assert quality_scores(empty, ratings, 3, 2).count() == 0
    blind = quality_scores(docs, ratings.limit(0), 3, 2).select("tail_probability").distinct().collect()
    assert len(blind) == 1 and abs(blind[0][0] - 1 / 3) < 1e-9


# mixing


def test_mixing_reaches_its_targets(spark, empty):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(20, 200)) + (" rouge" * 5 if i % 4 == 0 else " red" * 5)) for i in range(400)] + [(400, None), (401, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, "fr" if i % 4 == 0 else "en") for i in range(0, 400, 2)] + [(1, "xx"), (None, "en")], "doc_id bigint, domain string")
    for floor, off in ((0.0, 2e-3), (1.0, 0.03)):  # with a floor, soft members of the other domain cannot be cut out
        rates = mixing_rates(docs, labels, {"en": 3, "fr": 7}, floor=floor).cache()
        share = rates.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * F.col("posterior")[i]) for i in (0, 1)]).first()
        assert abs(share[0] / (share[0] + share[1]) - 0.3) < off
        assert rates.agg(F.min("rate")).first()[0] >= floor and rates.count() == len(rows)
    repeated = apply_rates(docs, rates).groupBy("doc_id").count()
    low = rates.join(repeated, "doc_id").filter("count < floor(rate) or count > ceil(rate)")
    assert repeated.count() == len(rows) and low.count() == 0
    assert mixing_rates(empty, labels, {"en": 1, "fr": 1}).count() == 0


# packing


def check_plan(histogram, capacity):
    p = packing.plan(histogram, capacity)
    used, count = defaultdict(list), Counter()
    for length, _, n, seq, per, off in p.runs:
        count[length] += n
        for i in range(n):
            used[seq + i // per].append((off + i % per * length, length))
    assert count == Counter({k: v for k, v in histogram.items() if v})
    for items in used.values():
        at = 0
        for off, length in sorted(items):
            assert off == at
            at += length
        assert at <= capacity
    assert len(used) == p.sequences
    return p.sequences


def test_plan_is_sound_and_close_to_the_best():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.randrange(1, 40)
        check_plan(Counter(rng.randrange(1, capacity + 1) for _ in range(rng.randrange(60))), capacity)
    for _ in range(40):
        items = sorted((rng.randrange(1, 11) for _ in range(8)), reverse=True)
        best = [9]

        def search(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= 10:
                    search(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
            search(i + 1, [*bins, items[i]])

        search(0, [])
        assert check_plan(Counter(items), 10) <= best[0] + 1


def test_fixed_sets_are_part_of_a_best_packing():
    left = np.zeros(11, np.int64)
    left[[6, 4, 3]] = 1, 1, 2
    assert packing._fixed_set(left, 6, 10) == (6, 4)
    left[4] = 0
    assert packing._fixed_set(left, 6, 10) == (6, 3)  # two of 3 don't fit beside it
    left[[1, 2]] = 2, 0
    assert packing._fixed_set(left, 6, 10) is None  # 3 + 1 fill it better than 3 alone


def letters():
    """One token for each character; picklable by reference."""
    return lambda texts: [np.array([ord(c) for c in t], np.uint32) for t in texts]


def test_pack(corpus, empty):
    df, rows = corpus
    got = packing.pack(df, capacity=64, encoder=letters).collect()
    full = defaultdict(list)
    for r in got:
        full[r.sequence_id].append((r.offset, r.length))
    for items in full.values():
        at = 0
        for off, n in sorted(items):
            assert off == at
            at += n
        assert at <= 64
    want = Counter()
    for i, t in rows:
        ids = [*map(ord, t or ""), 2]
        first = len(ids) if len(ids) <= 64 else len(ids) % 64 or 64
        edges = [0, *range(first, len(ids) + 1, 64)]
        for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            want[(i, k, lo, hi - lo, zlib.crc32(struct.pack(f"<{hi - lo}I", *ids[lo:hi])))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert packing.pack(empty, encoder=letters).count() == 0


def test_public_encoder_equals_the_tokenizer_file():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    alphabet = "ab Zé\n\t'ñ9!ß 漢 🙂 "
    texts = ["", "x <|endoftext|> y", "don't", *["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(300)]]
    for text, ids in zip(texts, packing.public_bpe()(texts), strict=True):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids


def test_public_encoder_equals_the_tokenizer_file_on_whole_documents():
    """All texts of a table of documents, in both encoders."""
    public = pytest.importorskip("public_tokenizers")
    import duckdb
    from conftest import DATA
    from tokenizers import Tokenizer

    texts = [t for (t,) in duckdb.sql(f"SELECT DISTINCT text FROM '{DATA}/sf0.01/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    slow = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    assert len(texts) > 500
    for text, ids in zip(texts, packing.public_bpe()(texts), strict=True):
        assert ids.tolist() == slow.encode(text, add_special_tokens=False).ids


# URL filter


def test_url_filter(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.Example.com", "/en/", "allow"), ("net", "/es/", "block"), (None, "/", "block"), ("bare.org", None, "block")]
    urls = ["https://a.example.com/en/x", "http://WWW.example.com/en/?q", "ftp://x.net/es/", "http://x.net/es", "http://com/", "http://notexample.com/en/", "x", None, "", "http://bare.org", "http://x.com#f", "http://x.com/a?b/en/", "//x.com/", "http://bare.org.net/es/1"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0]), (None, urls[0])], "page_id bigint, url string").withColumn("key", F.lit(1)).withColumn("rule", F.lit("clash"))

    def judge(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = host.lower()
        fit = [(len(h + (p or "")), h.lower() + (p or ""), v) for h, p, v in rules if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p or "")]
        best = max(fit, default=None)
        return host, path, best and best[1], best[2] if best else "allow"

    got = url_filter(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    want = Counter((i, *judge(u)) for i, u in enumerate(urls)) + Counter([(0, *judge(urls[0])), (None, *judge(urls[0]))])
    assert Counter(tuple(r) for r in got) == want
    none = url_filter(pages, spark.createDataFrame([], "host string, path string, verdict string"))
    assert none.filter("rule is not null").count() == 0 and none.count() == len(urls) + 2
    assert url_filter(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


# media


def png():
    chunk = lambda kind, d: struct.pack(">I", len(d)) + kind + d + struct.pack(">I", zlib.crc32(kind + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\x00\x01\x00\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
BMP = struct.pack("<2sIIIIiiHHIIiiII", b"BM", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"


def test_sniffer_confirms_structure_and_carves():
    import gzip
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "b")
    midi = b"MThd" + struct.pack(">IHHH", 6, 0, 1, 96) + b"MTrk" + struct.pack(">I", 4) + b"\x00\xff\x2f\x00"
    pdf = b"%PDF-1.4 x startxref 0 %%EOF"
    objects = [("image/png", png()), ("image/gif", GIF), ("image/bmp", BMP), ("application/gzip", gzip.compress(b"x" * 9)), ("audio/wav", media.wav(b"ab" * 8)), ("application/zip", z.getvalue()), ("audio/midi", midi), ("application/pdf", pdf)]
    a = media.automaton()
    data, want = b"BM GIF89a RIFF junk", []
    for kind, d in objects:
        want.append((kind, len(data), len(d)))
        data += d + b"--"
    assert media.sniff(data, a) == want
    for _, d in objects:
        assert media.sniff(d[:-3], a) == []


def test_sniff_media_columns(spark):
    rows = [(1, png(), "image/gif"), (2, b"plain", "text/plain"), (3, b"not a png", "image/png"), (4, None, "image/png"), (5, b"", None), (6, GIF + png(), "image/gif")]
    got = {r.k: r for r in media.sniff_media(spark.createDataFrame(rows, "k int, media binary, declared_type string").withColumn("embedded", F.lit(0))).collect()}
    assert [got[i].detected_type for i in range(1, 7)] == ["image/png", "text/plain", "application/octet-stream", None, "application/octet-stream", "image/gif"]
    assert got[1].type_corrected and not got[2].type_corrected
    assert [(e.type, e.offset) for e in got[6].embedded] == [("image/png", len(GIF))]


def test_text_round_trips_through_media(corpus, empty):
    df, rows = corpus
    got = media.media_features(media.sniff_media(media.text_as_media(df))).collect()
    want = Counter()
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        want[(i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(payload) + 44, hashlib.sha256(media.wav(payload)).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in got) == want
    assert media.media_features(media.sniff_media(media.text_as_media(empty))).count() == 0


# language


def test_forward_sums_all_segmentations():
    pieces = [b"a", b"b", b"ab", b" ", b" a", b"ba", b"aba"]
    lattice = language.Lattice(pieces)
    p = np.random.default_rng(1).random((2, len(pieces)))
    p /= p.sum(axis=1, keepdims=True)

    def brute(w, k):
        return 1.0 if not w else sum(p[k][i] * brute(w[len(q) :], k) for i, q in enumerate(pieces) if w.startswith(q))

    data = np.frombuffer(b"aba b abab baab", np.uint8)
    w = common.words(data, np.array([0, len(data)]))
    got = language.log_words(lattice, language.scaled_table(p, lattice.sizes), data, w.start, w.end)
    for i, x in enumerate(data.tobytes().split()):
        assert np.allclose(np.exp(got[i]), [brute(b" " + x, k) for k in (0, 1)])
    n = language.expected_counts(lattice, language.scaled_table(p, lattice.sizes), data, w.start, w.end, np.ones(4), np.zeros(4, int), 2)
    assert abs((n[0] * lattice.sizes).sum() - sum(len(x) + 1 for x in data.tobytes().split())) < 1e-9


def few_pieces():
    return sorted({bytes([b]) for b in range(256)} | {b" the", b"ing", b" der", b"ung", b"sch", b"th"})


def test_identify_languages(spark, empty):
    rng = random.Random(4)
    say = {"en": ["the", "thing", "with", "other"], "de": ["der", "schung", "und", "schade"]}
    rows = [(i, " ".join(rng.choice(say[x]) for _ in range(30)), x) for i, x in enumerate(["en", "de"] * 60)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "12 !!", "en"), (203, "Ж", None), (204, "x" * 5000, None), (None, "the thing", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("id", F.lit(0)).withColumn("held_out", F.lit("clash"))
    got = identify_languages(df, pieces=few_pieces).collect()
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == x for i, _, x in rows[:120])
    assert [by[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3 and by[203].lang_pred != "und" and by[None].lang_pred == "en"
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(120))
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in identify_languages(df.withColumn("lang", F.lit(None).cast("string")), pieces=few_pieces).collect()} == {"und"}
    assert identify_languages(empty.withColumn("lang", F.lit("x")), pieces=few_pieces).count() == 0


# language model


def brute_ctw(train, texts, depth):
    """Nodes as dictionaries: exact weights bottom-up, then the mixture for each bit."""
    counts = defaultdict(lambda: [0, 0])

    def bits(doc):
        data = bytes(depth) + fold(doc).encode() + b"\0"
        for i in range(depth, len(data)):
            prefix = 1
            for b in range(7, -1, -1):
                bit = data[i] >> b & 1
                yield data[i - depth : i], prefix, bit
                prefix = prefix * 2 + bit

    for doc in train:
        for ctx, prefix, bit in bits(doc):
            for k in range(depth + 1):
                counts[(ctx[depth - k :], prefix)][bit] += 1
    children = defaultdict(list)
    for ctx, prefix in counts:
        if ctx:
            children[(ctx[1:], prefix)].append((ctx, prefix))
    weight, logw = {}, {}
    for node in sorted(counts, key=lambda n: -len(n[0])):
        a, b = counts[node]
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        if len(node[0]) == depth:
            weight[node], logw[node] = 1.0, own
        else:
            below = sum(logw[c] for c in children[node])
            logw[node] = np.logaddexp(own, below) - math.log(2)
            weight[node] = 1 / (1 + math.exp(min(700, below - own)))
    out = []
    for doc in texts:
        total = 0.0
        for ctx, prefix, bit in bits(doc):
            p = None
            for k in range(depth, -1, -1):
                node = (ctx[depth - k :], prefix)
                if node in counts:
                    a, b = counts[node]
                    own = (b + 0.5) / (a + b + 1)
                    p = own if p is None else weight[node] * own + (1 - weight[node]) * p
            p = 0.5 if p is None else p
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def test_lm_scores(spark, empty):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(1, 25), 30).title()) for i in range(60)] + [(60, None), (61, ""), (62, "unseen Ωords"), (None, "w1 w2"), (5, "w1 w2 w3")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("id", F.lit(0)).withColumn("n", F.lit(1))
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    train = [t or "" for (_, t), h in zip(rows, held, strict=True) if not h]
    for depth, head in ((2, 1 << 18), (3, 4)):
        got = ctw.lm_scores(df, depth=depth, min_count=1, head_words=head).collect()
        c = Counter(x for t in train for x in [*words(t), None])
        n, v = sum(c.values()), len(c)
        want = []
        for (i, t), h, s in zip(rows, held, brute_ctw(train, [t or "" for _, t in rows], depth), strict=True):
            tokens = [*words(t), None]
            want.append((str(i), h, len(tokens), sum(c[x] > 0 for x in tokens), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens), 6), round(s, 3)))
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 3)) for r in got) == sorted(want)
    assert ctw.lm_scores(empty).count() == 0


def test_lm_scores_have_every_context(spark):
    """As the query calls it, contexts seen once count, and the result doesn't depend on how many runs go to every task."""
    rng = random.Random(18)
    rows = [(i, prose(rng, rng.randrange(1, 30), 200)) for i in range(40)] + [(40, "once Ωnly"), (41, ""), (42, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    train = [t or "" for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    want = dict(zip([i for i, _ in rows], brute_ctw(train, [t or "" for _, t in rows], ctw.DEPTH), strict=True))
    for few in ({}, {"head_runs": 50, "head_words": 4}, {"head_runs": 0}):
        got = {r.doc_id: r.score for r in ctw.lm_scores(df, **few).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)
