"""Texts of 1 to 2 MB through the operators: white space, one letter, one unbroken word, prose and its near copy; and a pipeline without rows."""

import random
import re
import zlib

import corpus_pipeline as pipeline
import pytest
from tidemark.llm.ctw import lm_scores
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.jaccard import jaccard_components
from tidemark.llm.language import identify_languages
from tidemark.llm.media import text_media_report
from tidemark.llm.quality import quality_scores
from tidemark.llm.suffix import repeated_passages

N_WORDS = 200_000


@pytest.fixture(scope="module")
def long_docs(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(50_000)}" for _ in range(N_WORDS)]
    other = list(words)
    for _ in range(500):
        other[rng.randrange(N_WORDS)] = "edited"
    texts = {1: " " * 1_500_000, 2: "\n" * 1_000_000, 3: "a" * 1_200_000, 4: "".join(rng.choice("abcdefghij") for _ in range(1_000_000)), 5: " ".join(words), 6: " ".join(other), 7: "a short text", 8: "Ä€😀" * 200_000, 9: " ".join(words).upper()}
    rows = [(i, t, "en" if i % 2 else "de") for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4).cache(), texts


def test_dedup_and_near_copies(long_docs):
    df, texts = long_docs
    got = {r.doc_id: r for r in exact_dedup(df).collect()}
    assert {i: r.keep_id for i, r in got.items()} == {i: 9 if i in (5, 9) else i for i in texts}
    near = {r.doc_id: (r.n_shingles > 0, r.component_id) for r in jaccard_components(df).collect()}
    assert near == {1: (False, 1), 2: (False, 2), 3: (True, 3), 4: (True, 4), 5: (True, 5), 6: (True, 5), 7: (True, 7), 8: (True, 8), 9: (True, 5)}


def test_scores_of_long_texts(long_docs):
    df, texts = long_docs
    got = {r.doc_id: r for r in lm_scores(df).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) + 1 for i, t in texts.items()}
    assert got[5].score == got[9].score < 0  # in A-Z only their case differs
    langs = {r.doc_id: r for r in identify_languages(df).collect()}
    assert langs[1].lang_pred == langs[2].lang_pred == "und" and all(0 <= r.score <= 1 for r in langs.values())


def test_repeated_passages_of_long_texts(long_docs):
    df, texts = long_docs
    spans = repeated_passages(df.filter("doc_id in (5, 6, 7)")).collect()
    kept, gone = ({r.doc_id for r in spans if r.kept == k} for k in (True, False))
    assert kept >= {5} and gone == {6}
    assert sum(r.n_words for r in spans if r.doc_id == 6 and not r.kept) > 0.9 * N_WORDS


def test_quality_and_media_of_long_texts(spark, long_docs):
    df, texts = long_docs
    ratings = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id bigint, grade int")
    assert quality_scores(df, ratings, n_grades=2, accept=1).filter("tail_probability between 0 and 1").count() == len(texts)
    got = {r.doc_id: r for r in text_media_report(df).collect()}
    assert {i: r.n_bytes for i, r in got.items()} == {i: len(t.encode()) for i, t in texts.items()}
    raw = texts[8].encode()
    assert got[8].tail_crc32 == zlib.crc32((raw + bytes(-len(raw) % 64))[-64:])


def test_pipeline_without_rows(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert pipeline.run(spark, d).count() == 0
