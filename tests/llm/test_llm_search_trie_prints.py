"""The conversation trie, winnowed fingerprints and ranked search against brute force, and on odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.llm import ranked, trie, winnowing
from tidemark.llm.common import Stage, gram_hashes, mix

CLASH = ("conv", "place", "a", "b", "id", "tie", "bucket", "border", "item", "terms", "n", "rank", "score")


def clashing(df):
    return df.withColumns({c: F.lit(f"my {c}") for c in CLASH if c not in df.columns}).withColumn("x.y", F.lit(1))


# ---- trie


def trie_of(spark, rows, shared=True):
    df = clashing(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    turns = Stage(spark, "turns").write(trie.turn_digests(df), "turns")
    out = trie.prefix_trie(trie.with_shared_starts(turns) if shared else trie.opened(turns))
    return sorted(tuple(r) for r in out.select("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def brute_trie(rows, shared=True):
    convs = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        convs[c].append((role or "", text or ""))
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6 if shared else 0
        whole[c] = tuple(convs.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:])
    members = defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    sha = lambda k: hashlib.sha256(",".join(str(c) for c in sorted(members[k]) if whole[c] == k).encode()).hexdigest()
    return sorted((len(k), min(m), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], sha(k)) for k, m in members.items())


def as_sortable(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-3, 120), *range(200, 330), 512]:
        if c in (100,):
            continue  # an absent conversation to take turns from
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "ho", "", None, "näher 😀", f"t{rng.randrange(40)}"])) for t in range(rng.randrange(1, 9))]
    rows += [(700 + i, t, "user", f"same {t}") for i in range(90) for t in range(7)]  # copies, but for shared starts
    rows += [(None, 1, "user", "no conversation"), (5, None, "system", "first")]
    assert as_sortable(trie_of(spark, rows)) == as_sortable(brute_trie(rows))
    assert as_sortable(trie_of(spark, rows, shared=False)) == as_sortable(brute_trie(rows, shared=False))


def test_trie_of_ladders_and_long_tails(spark):
    """Every conversation a prefix of the longest one, another leaves it at each turn, and one tail of 300 turns; ids over several blocks."""
    rows = [(i * 3000, t, "u", f"x{t}") for i in range(1, 13) for t in range(i)]
    rows += [(1 + i * 3000, t, "u", f"x{t}" if t < i else "off") for i in range(12) for t in range(i + 1)]
    rows += [(9, t, "u", "long " * (t % 3) + str(t)) for t in range(300)]
    rows += [(100_000 + i, t, "u", f"copy {t}") for i in range(2500) for t in range(2)]
    assert as_sortable(trie_of(spark, rows, shared=False)) == as_sortable(brute_trie(rows, shared=False))


def test_trie_odd_inputs(spark):
    assert trie_of(spark, []) == []
    assert trie_of(spark, [(None, 1, "u", "x")]) == []
    only = trie_of(spark, [(305, 0, "u", "never seen")])  # its first turns come from an absent conversation
    assert as_sortable(only) == as_sortable(brute_trie([(305, 0, "u", "never seen")]))
    rows = [(1, 0, "u", "a" * 3_000_000), (2, 0, "u", "a" * 3_000_000), (2, 0, "u", "a" * 3_000_000), (2, None, None, None)]
    assert as_sortable(trie_of(spark, rows, shared=False)) == as_sortable(brute_trie(rows, shared=False))
    ties = [(1, 0, "u", "b"), (1, 0, "u", "a"), (2, 0, "u", "a"), (2, 0, "u", "b")]  # the same turns in one order
    assert {r[3] for r in trie_of(spark, ties, shared=False)} == {2}


# ---- fingerprints


def normal(text):
    return [(i, c.translate({x: x + 32 for x in range(65, 91)})) for i, c in enumerate(text) if c not in " \t\n\v\f\r"]


def brute_fingerprint(text, k, w):
    chars = normal(text)
    if not chars:
        return []
    value = np.array([int.from_bytes(c.encode(), "little") for _, c in chars], np.uint64)
    k = min(k, len(chars))
    grams = [int(gram_hashes(mix(value[i : i + k] + np.uint64(1)), k)[0]) for i in range(len(chars) - k + 1)]
    w = min(w, len(grams))
    kept = set()
    for i in range(len(grams) - w + 1):
        least = min(g >> 24 for g in grams[i : i + w])
        kept.add(max(j for j in range(i, i + w) if grams[j] >> 24 == least))
    return [(chars[j][0], grams[j]) for j in sorted(kept)]


def prints(text, k, w):
    f = winnowing.fingerprint(np.frombuffer(text.encode(), np.uint8), k, w)
    return list(zip(f.places.tolist(), f.hashes.tolist(), strict=True))


TEXTS = ["", " \n\t", "a", "Ab c", "aaaa" * 40, "The quick brown fox jumps over the lazy dog. " * 5, "ünï😀 çödé ÀB " * 9, "x " * 100]


def test_fingerprint_equals_brute_force(monkeypatch):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("abAB é😀\n") for _ in range(rng.randrange(300))) for _ in range(40)]
    for part in (4 << 20, 37):  # also in parts that overlap
        monkeypatch.setattr(winnowing, "_PART", part)
        for t in texts:
            for k, w in ((5, 4), (12, 9), (24, 64)):
                assert prints(t, k, w) == brute_fingerprint(t, k, w)


def test_shared_passages_share_a_fingerprint():
    """w + k - 1 characters in a row, in any case and spacing, are found anywhere; equal texts are alike."""
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefghij klm") for _ in range(n))
    for _ in range(60):
        passage = letters(140)
        while len(normal(passage)) < 24 + 64 - 1:
            passage += "q"
        a, b = letters(rng.randrange(900)) + passage + letters(200), letters(rng.randrange(900)) + passage.upper().replace(" ", "\n ") + letters(99)
        assert {h for _, h in prints(a, 24, 64)} & {h for _, h in prints(b, 24, 64)}
        assert not {h for _, h in prints(letters(500), 24, 64)} & {h for _, h in prints(letters(500), 24, 64)}


def share(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_edited(rows, k, w):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        m = len(text) // 2
        edited = text[: len(text) - m] + after[:m]
        f, g, h = (brute_fingerprint(x, k, w) for x in (text, edited, after))
        said = lambda f: " ".join(f"{p}:{x:016x}" for p, x in f)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), said(f), said(g), round(share(f, g), 12), round(share(f, h), 12)))
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", [1, 2, 7, 40])
def test_edited_fingerprints_equal_brute_force(spark, partitions):
    rng = random.Random(6)
    rows = [(i * 7 - 30, rng.choice([*TEXTS, None, "".join(rng.choice("abc dé😀") for _ in range(rng.randrange(200)))])) for i in range(60)] + [(None, "last of all")]
    df = clashing(spark.createDataFrame(rows, "doc_id bigint, text string")).repartition(5)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = winnowing.edited_fingerprints(df, k=6, w=5).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert sorted(((*r[:5], round(r[5], 12), round(r[6], 12)) for r in got), key=str) == brute_edited(rows, 6, 5)


def test_edited_fingerprints_of_odd_tables(spark):
    of = lambda rows: winnowing.edited_fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert of([]) == []
    (alone,) = of([(4, "abcdef")])  # its own next
    assert alone.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and alone.near_next == 1.0
    assert [r.n_chars for r in of([(None, None)])] == [0]
    rows = [(3, "repeated row")] * 50 + [(3, "other text"), (1, "z" * 30), (None, "x"), (None, "y")]
    got = of(rows)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert len({r.fingerprint for r in got if r.n_chars == 12}) == 1
    assert sum(r.near_next == 1.0 for r in got if r.doc_id == 3) >= 49
    long = "lorem IPSUM é " * 400_000  # 5.6 million characters in two parts
    a, b = sorted(of([(2, long), (1, long)]), key=lambda r: r.doc_id)
    assert a.fingerprint == b.fingerprint and a.near_next == 1.0 and a.near_edited > 0.5


def test_fingerprint_rows(spark):
    df = clashing(spark.createDataFrame([("a", TEXTS[5]), ("b", None), (None, TEXTS[6])], "doc_id string, text string"))
    got = Counter((r.doc_id, r.place, r.hash % 2**64) for r in winnowing.fingerprints(df, k=6, w=5).collect())
    assert got == Counter((d, p, h) for d, t in (("a", TEXTS[5]), (None, TEXTS[6])) for p, h in brute_fingerprint(t, 6, 5))


# ---- ranked search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute_search(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, total, df = len(bags), sum(sum(b.values()) for _, b in bags), Counter(t for _, b in bags for t in b)
    out = []
    for item, query in items:
        scores = []
        for d, b in bags:
            m = 100 - 50 + 50 * sum(b.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 20 * m)) for t in set(terms(query)) if b[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, **more):
    d = clashing(spark.createDataFrame(docs, "doc_id bigint, text string")).repartition(3)
    q = clashing(spark.createDataFrame(items, "item_id bigint, text string"))
    return sorted((tuple(r) for r in ranked.ranked_search(d, q, **more).collect()), key=str)


def corpus(rng):
    word = lambda: rng.choice(["the", "The", "über", "x1", "naïve", "日本", f"w{rng.randrange(80)}"])
    docs = [(i, rng.choice([" ", "-", "\n", "{", "_"]).join(word() for _ in range(rng.randrange(1, 60)))) for i in range(150)]
    docs += [(1000 + i, "the same copy of w1 w2 w3") for i in range(120)] + [(2000, None), (2001, ""), (2002, "!!! --"), (None, "w1 w2 w3 w4"), (7, docs[7][1]), (2003, "w5 " * 200_000)]
    items = [(i, " ".join(word() for _ in range(8))) for i in range(12)] + [(50, "w1 w2 w3 COPY"), (51, None), (52, "?!"), (53, "unseen words"), (None, "w7 w7"), (60, "w9"), (60, "w9")]
    return docs, items


def test_search_equals_brute_force(spark):
    docs, items = corpus(random.Random(8))
    assert searched(spark, docs, items, k=5) == brute_search(docs, items, 5)
    assert searched(spark, docs, items, k=50, window=64) == brute_search(docs, items, 50)


def test_search_in_several_passes(spark, monkeypatch):
    docs, items = corpus(random.Random(9))
    monkeypatch.setattr(ranked, "MOST_TERMS", 20)
    assert searched(spark, docs, items, k=9, window=7) == brute_search(docs, items, 9)


def test_search_odd_tables(spark):
    assert searched(spark, [], []) == searched(spark, [], [(1, "x")]) == searched(spark, [(1, "x")], []) == searched(spark, [(1, None)], [(1, "x")]) == []
    assert searched(spark, [(1, "x"), (2, "y")], [(3, "X")]) == brute_search([(1, "x"), (2, "y")], [(3, "X")], 50)


def test_length_norm_beyond_64_bits():
    assert ranked._length_norms(np.array([10, 10**9]), 10**10, 3 * 10**12).tolist() == [50 + 50 * 10 * 10**10 // (3 * 10**12), 50 + 50 * 10**19 // (3 * 10**12)]
