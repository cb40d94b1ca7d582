import random
from collections import Counter

import corpus_pipeline as pipeline
import pytest


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    say = {"en": "the and", "de": "der und", "fr": "le et", "es": "el y"}
    rows, labels = [], []
    for i in range(160):
        lang = ["en", "en", "en", "de", "fr", "es"][i % 6]
        bad = i % 8 == 7
        body = f"{text(60)} {say[lang]}" + (" filth scum" * 3 if bad else "")
        rows.append((i, body, lang, "src0"))
        labels.append((i, 1, int(bad)))
    rows += [(1000, rows[0][1].upper(), "en", "src1"), (1001, rows[1][1] + " tail", "en", "src1"), (1002, None, None, None), (1003, "", "en", "src2")]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").selectExpr("*", "cast(length(text) as bigint) n_chars").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows


def test_stages(spark, world, tmp_path):
    d, rows = world
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    columns = docs.columns
    for k, (_, f) in enumerate(pipeline.STAGES):
        f(spark, docs, d).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
        seen.append([r.doc_id for r in docs.collect()])
    quality, exact, near, mixed, packed = seen
    assert set(range(160)) - set(quality) == {i for i in range(160) if i % 8 == 7}
    assert 0 not in exact and 1000 in exact and set(quality) - set(exact) <= {0, 1002, 1003}
    assert 1001 not in near and 1 in near and set(exact) - set(near) == {1001}
    assert set(mixed) == set(near) and len(mixed) > len(near)
    assert Counter(set(packed)) == Counter(set(mixed))


def test_run(spark, world):
    d, _ = world
    out = pipeline.run(spark, d)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 100
