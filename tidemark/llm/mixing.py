"""Mixing to target weights with soft membership.

A classifier fitted on a labelled table gives every document its posterior over domains. Rates, one for each document,
are fitted so that the expected domain tokens, the sum of rate * tokens * posterior, match the targets: projected
gradient descent on the least squares of the residual, over all documents. Each step is one aggregation of as many sums as
there are domains; the gradient of a document is a product with that short vector, so a row needs nothing but the
vectors of the steps so far to know its rate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stage, slices, words
from .features import BITS, descend, hashed_features, labelled_sample, sums


def fit_softmax(x: np.ndarray, at: np.ndarray, label: np.ndarray, n_classes: int, rounds: int = 60, rate: float = 0.1, shrink: float = 1e-4, min_docs: int = 4) -> np.ndarray:
    """Weights (features + 1 x classes) of a multinomial logistic regression; the last row is the bias."""
    weights = np.zeros(((1 << BITS) + 1, n_classes))
    n = len(label)
    if n == 0:
        return weights
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(at))
    often = np.bincount(x, minlength=1 << BITS)[x] >= min_docs
    used, xi = np.unique(x[often], return_inverse=True)
    owner, xi = owner[often], xi.astype(np.int32)
    del often
    hot = np.eye(n_classes)[label]

    def gradient(p: np.ndarray) -> np.ndarray:
        p = p.reshape(-1, n_classes)
        f = np.stack([np.bincount(owner, p[xi, k], n) for k in range(n_classes)], axis=1) + p[-1]
        e = np.exp(f - f.max(axis=1, keepdims=True))
        g = (e / e.sum(axis=1, keepdims=True) - hot) / n
        return np.concatenate([np.stack([np.bincount(xi, g[owner, k], len(used)) for k in range(n_classes)], axis=1) + shrink * p[:-1], g.sum(axis=0)[None]]).ravel()

    p = descend(gradient, np.zeros((len(used) + 1) * n_classes), rounds, rate).reshape(-1, n_classes)
    weights[used], weights[-1] = p[:-1], p[-1]
    return weights


def domain_posteriors(df: DataFrame, labelled: DataFrame, domains: list[str], id_col: str, text_col: str, domain_col: str, sample: int, carry: str | None = None) -> DataFrame:
    """(id, n_tokens, posterior): words of the whole text, and the classifier's probabilities in the order of domains. carry: a column kept beside them."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.col(carry).alias("carried")] if carry else []))
    kept = ["id", *(["carried"] if carry else [])]
    rated = labelled.select(F.col(id_col).alias("id"), F.col(domain_col).alias("domain")).filter(F.col("domain").isin(domains))
    x, at, label = labelled_sample(docs, rated, "domain", sample)
    number = {d: i for i, d in enumerate(domains)}
    weights = fit_softmax(x, at, np.array([number[v] for v in label], np.int64), len(domains))
    model = df.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offsets in slices(batches, "text"):
            x, at = hashed_features(data, offsets)
            f = sums(model.value[:-1], x, at) + model.value[-1]
            e = np.exp(f - f.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(words(data, offsets).count.astype(np.int64)), lists], [*kept, "n_tokens", "posterior"])

    out = T.StructType([*[docs.schema[c] for c in kept], T.StructField("n_tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))])
    return docs.mapInArrow(run, out)


def _rate(posterior: Column, steps: list[np.ndarray], floor: float) -> Column:
    """Rate after these steps: it starts at 1, moves by posterior . step, and is projected to at least floor."""
    table = F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in steps])
    dot = lambda s: F.aggregate(F.zip_with(posterior, s, lambda p, v: p * v), F.lit(0.0), lambda a, v: a + v)
    start = F.lit(max(1.0, floor))
    return F.aggregate(table, start, lambda r, s: F.greatest(r - dot(s), F.lit(float(floor)))) if steps else start


def mixing_rates(df: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", floor: float = 0.0, sample: int = 4000, rounds: int = 30, close: float = 1e-3, carry: str | None = None) -> DataFrame:
    """One row per document: id, n_tokens, posterior (in the order of the sorted domains), rate; and the column `carry` if one is named.

    targets are the domains' weights; they are normalised. With floor 0 the mixture has as many tokens as the corpus;
    with a floor (each rate is at least that), as many as the domain with the largest demand needs to have no rate below it;
    then members of several domains can make the exact targets unreachable, and the rates are the nearest in least squares.
    labelled has id_col and domain_col. A null or empty text has no tokens: its rate stays at its start, and matters to no sum.
    Null and repeated ids are treated like any other row; texts of any length are read whole, and other columns are ignored. An empty
    table gives an empty result. The steps stop when the residual is within `close` of the total,
    or after `rounds`. The residual is scaled by the inverse root of the domains' Gram matrix, which makes 1 the right step length.
    """
    stage = Stage(df.sparkSession, "mixing")
    domains = sorted(targets)
    k = len(domains)
    rows = stage.write(domain_posteriors(df, labelled, domains, id_col, text_col, domain_col, sample, carry), "posteriors", "zstd")
    # distances between rates are weighted by tokens, so that a document's length doesn't change its rate
    p, t = F.col("posterior"), F.col("n_tokens").cast("double")
    gram = rows.agg(*[F.sum(t * p[i]).alias(f"s{i}") for i in range(k)], *[F.sum(t * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    have = np.array([gram[f"s{i}"] or 0.0 for i in range(k)])
    g = np.array([[gram[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    share = np.array([targets[d] for d in domains], float) / sum(targets.values())
    total = have.sum() if floor <= 0 else max(have[i] * max(1.0, floor) / share[i] for i in range(k) if share[i] > 0)
    goal, inverse, steps = total * share, np.linalg.pinv(g, rcond=1e-9), []
    for _ in range(rounds):
        rate = _rate(p, steps, floor)
        now = rows.agg(*[F.sum(t * p[i] * rate).alias(f"s{i}") for i in range(k)]).first()
        miss = np.array([now[f"s{i}"] or 0.0 for i in range(k)]) - goal
        if np.abs(miss).sum() <= close * total:
            break
        steps.append(inverse @ miss)
    return rows.withColumn("rate", _rate(p, steps, floor)).withColumnsRenamed({"id": id_col} | ({"carried": carry} if carry else {}))


def _repeated(rate: Column, key: Column) -> Column:
    """An array with an entry for each copy: the rate's whole part, and one more with the probability of the rest, by a hash of the key."""
    part = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    times = F.floor(rate) + F.when(part < rate - F.floor(rate), 1).otherwise(0)
    return F.array_repeat(F.lit(0), times.cast("int"))


def apply_rates(df: DataFrame, rates: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """df with each row repeated as the rate of its id says: the whole part, and once more with the probability of the rest, by a hash of the id.

    Of an id with several rates the mean counts. Rows of df whose id has no rate, or is null, stay once.
    """
    doc = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc")
    r = rates.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg("rate").alias("rate"))
    joined = df.select(F.col(id_col).alias("id"), doc).join(r, "id", "left")
    copies = F.explode(_repeated(F.coalesce("rate", F.lit(1.0)), F.col("id").cast("string")))
    return joined.select("doc", copies.alias("copy")).select("doc.*")


def mix_documents(df: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df with each row repeated as its own rate says (see mixing_rates for the options): rows keep all their columns.

    Rates go with rows, not ids, so repeated and null ids and columns of any name are safe, and no join is needed. Rows with the same
    id and text get the same number of copies.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.select(whole.alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rated = mixing_rates(rows, labelled.withColumnRenamed(id_col, "id"), targets, "id", "text", carry="doc", **options)
    key = F.concat_ws("\n", F.col("doc")[id_col].cast("string"), F.col("doc")[text_col])
    return rated.select("doc", F.explode(_repeated(F.col("rate"), key)).alias("copy")).select("doc.*")
