"""Probabilistic classifiers for pair rows, fitted with Spark ML on vectors that Spark assembles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import calibration_day, date_blocks
from .pairs import swapped


class Preprocessor:
    """Median imputation (interpolated), standardisation by the population's deviation, most frequent category, one-hot codes.

    Medians, means, deviations and modes come from one aggregation each over the training rows.
    """

    def __init__(self, numeric: Sequence[str], categorical: Sequence[str] = ()):
        self.numeric, self.categorical, self.fill, self.scale, self.mode = list(numeric), list(categorical), {}, {}, {}

    def fit(self, df: DataFrame) -> Preprocessor:
        row = df.agg(*[F.percentile(F.col(c).cast("double"), 0.5).alias(c) for c in self.numeric], *[F.mode(c, True).alias(f"mode_{c}") for c in self.categorical]).first()
        self.fill = {c: row[c] if row[c] is not None else 0.0 for c in self.numeric}
        self.mode = {c: row[f"mode_{c}"] or "Unknown" for c in self.categorical}
        filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(self.fill[c])).alias(c) for c in self.numeric])
        row = filled.agg(*[f(c).alias(f"{n}_{c}") for c in self.numeric for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        self.scale = {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in self.numeric}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        cols: dict[str, Column] = {f"_x_{c}": (F.coalesce(F.col(c).cast("double"), F.lit(self.fill[c])) - self.scale[c][0]) / self.scale[c][1] for c in self.numeric}
        return df.withColumns(cols | {f"_c_{c}": F.coalesce(F.col(c), F.lit(self.mode[c])) for c in self.categorical})


def _balanced(df: DataFrame, label: str) -> tuple[DataFrame, float]:
    """df with a weight that makes both classes count the same, and the sum of weights."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # two rows
    n = sum(counts.values())
    weight = reduce(lambda w, kv: w.when(F.col(label) == kv[0], n / (len(counts) * kv[1])), counts.items(), F.when(F.lit(False), 0.0))
    return df.withColumn("_weight", weight), float(n)


class Model:
    """A fitted preprocessor and classifier; `score` adds a probability column."""

    def __init__(self, pre: Preprocessor, stages: PipelineModel, calibration: tuple[float, float] | None = None):
        self.pre, self.stages, self.calibration = pre, stages, calibration

    def score(self, df: DataFrame, name: str = "probability") -> DataFrame:
        keep = df.columns
        p = vector_to_array("probability")[1]
        if self.calibration:
            a, b = self.calibration
            z = F.ln(F.greatest(p, F.lit(1e-9)) / F.greatest(1 - p, F.lit(1e-9)))
            p = 1 / (1 + F.exp(-(F.lit(a) * z + F.lit(b))))
        scored = self.stages.transform(self.pre.transform(df.drop("probability", "prediction", "rawPrediction")))
        return scored.select(*[F.col(c) for c in keep if c != name and c in scored.columns and c not in ("probability",)], p.alias(name))


def fit(df: DataFrame, kind: str, numeric: Sequence[str], categorical: Sequence[str] = (), label: str = "label", c: float = 0.1, seed: int = 7) -> Model:
    """logistic (penalty 1 / c), forest or boosted. Rows without a label drop out; both classes count the same."""
    rows, weights = _balanced(df.filter(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double")), label)
    pre = Preprocessor(numeric, categorical).fit(rows)
    codes = [s for k in categorical for s in (StringIndexer(inputCol=f"_c_{k}", outputCol=f"_i_{k}", handleInvalid="keep"), OneHotEncoder(inputCol=f"_i_{k}", outputCol=f"_o_{k}", dropLast=False))]
    assemble = VectorAssembler(inputCols=[f"_x_{k}" for k in numeric] + [f"_o_{k}" for k in categorical], outputCol="_features")
    common = {"featuresCol": "_features", "labelCol": label, "weightCol": "_weight"}
    learner = {
        "logistic": lambda: LogisticRegression(**common, regParam=1 / (c * weights), elasticNetParam=0.0, standardization=False, maxIter=200),
        "forest": lambda: RandomForestClassifier(**common, numTrees=100, maxDepth=8, seed=seed),
        "boosted": lambda: GBTClassifier(**common, maxIter=60, maxDepth=2, stepSize=0.1, subsamplingRate=0.8, seed=seed),
    }[kind]()
    return Model(pre, Pipeline(stages=[*codes, assemble, learner]).fit(pre.transform(rows)))


def fit_calibrated(df: DataFrame, kind: str, numeric: Sequence[str], categorical: Sequence[str] = (), label: str = "label", day: str = "event_day") -> Model:
    """Fitted on the first 80 % of days; then a sigmoid of the log odds is fitted on the rest, with Platt's smoothed targets as weighted rows."""
    boundary = calibration_day(df, day=day).first()
    cut = F.lit(boundary.boundary if boundary else None).cast("date")
    model = fit(df.filter(F.col(day) < cut), kind, numeric, categorical, label)
    late = model.score(df.filter((F.col(day) >= cut) & F.col(label).isNotNull()), "_p").select(F.col(label).cast("double").alias("y"), F.ln(F.greatest("_p", F.lit(1e-9)) / F.greatest(1 - F.col("_p"), F.lit(1e-9))).alias("z"))
    pos, n = late.agg(F.coalesce(F.sum("y"), F.lit(0.0)), F.count("y")).first()
    if not n:
        return model
    high, low = (pos + 1) / (pos + 2), 1 / (n - pos + 2)
    soft = late.withColumn("t", F.when(F.col("y") == 1, high).otherwise(low)).select("z", F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.col("t").alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - F.col("t")).alias("w")))).alias("r")).select("z", "r.y", "r.w")
    vectors = VectorAssembler(inputCols=["z"], outputCol="v").transform(soft)
    line = LogisticRegression(featuresCol="v", labelCol="y", weightCol="w", standardization=False).fit(vectors)
    return Model(model.pre, model.stages, (float(line.coefficients[0]), float(line.intercept)))


def logistic_gradient(model: Model, df: DataFrame, label: str = "label", c: float = 0.1) -> DataFrame:
    """(feature, n, gradient): the slope of the penalised loss that fit(df, "logistic", ...) minimises, at the model's weights; near 0 if it did. No categories."""
    rows, weights = _balanced(df.filter(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double")), label)
    line = model.stages.stages[-1]
    beta = dict(zip(model.pre.numeric, map(float, line.coefficients), strict=True))
    x = model.pre.transform(rows)
    score = reduce(lambda a, b: a + b, [F.col(f"_x_{k}") * v for k, v in beta.items()]) + F.lit(float(line.intercept))
    rest = F.col("_weight") * (1 / (1 + F.exp(-score)) - F.col(label))
    slopes = [(k, F.sum(rest * F.col(f"_x_{k}")) / weights + v / (c * weights)) for k, v in beta.items()] + [("intercept", F.sum(rest) / weights)]
    one = x.agg(F.array(*[F.struct(F.lit(k).alias("feature"), F.count(F.lit(1)).alias("n"), g.alias("gradient")) for k, g in slopes]).alias("g"))
    return one.select(F.inline("g"))


class Formula:
    """A model that is an expression of the columns: baselines such as one half, or a rating's expectation."""

    def __init__(self, probability: Column):
        self.probability = probability

    def score(self, df: DataFrame, name: str = "probability") -> DataFrame:
        return df.withColumn(name, self.probability)


def block_losses(scored: DataFrame, models: Sequence[str], label: str = "label", block: str = "block", clip: float = 1e-6) -> DataFrame:
    """(model, block, loss): mean log loss of each model's probability column in each block of labelled rows."""
    y = F.col(label).cast("double")
    p = lambda m: F.greatest(F.lit(clip), F.least(F.lit(1 - clip), F.col(m)))
    items = F.array(*[F.struct(F.lit(m).alias("model"), (-(y * F.ln(p(m)) + (1 - y) * F.ln(1 - p(m)))).alias("loss")) for m in models])
    long = scored.filter(y.isNotNull()).select(block, F.explode(items).alias("i")).select(block, "i.*")
    return long.groupBy("model", block).agg(F.avg("loss").alias("loss"))


def inverse_loss_weights(losses: DataFrame) -> DataFrame:
    """(model, weight): one over each model's mean loss over its blocks; weights add up to 1."""
    inverse = losses.groupBy("model").agg((1 / F.avg("loss")).alias("w"))
    return inverse.crossJoin(F.broadcast(inverse.agg(F.sum("w").alias("total")))).select("model", (F.col("w") / F.col("total")).alias("weight"))  # a row for each model


class Ensemble:
    """Weighted mean of models' probabilities."""

    def __init__(self, models: dict[str, Model], weights: dict[str, float]):
        self.models, self.weights = models, weights

    def score(self, df: DataFrame, name: str = "probability") -> DataFrame:
        out = df
        for k, m in self.models.items():
            out = m.score(out, f"_p_{k}")
        total = sum(self.weights.values())
        return out.withColumn(name, reduce(lambda a, b: a + b, [F.col(f"_p_{k}") * (w / total) for k, w in self.weights.items()])).drop(*[f"_p_{k}" for k in self.models])


def fit_ensemble(df: DataFrame, kinds: Sequence[str], numeric: Sequence[str], categorical: Sequence[str] = (), label: str = "label", day: str = "event_day", blocks: int = 4) -> Ensemble:
    """Models weighted by one over their mean log loss on later blocks of days, then fitted again on everything."""
    rows = df.persist()  # fitted on many times; rows that an executor loses are computed again
    cut = rows.join(F.broadcast(date_blocks(rows, blocks, day)), day)
    parts = []
    for b in range(2, blocks + 1):
        train, scored = cut.filter(F.col("block") < b), cut.filter((F.col("block") == b) & F.col(label).isNotNull())
        for k in kinds:
            scored = fit(train, k, numeric, categorical, label).score(scored, f"_p_{k}")
        parts.append(block_losses(scored, [f"_p_{k}" for k in kinds], label))
    weights = {r.model.removeprefix("_p_"): r.weight for r in inverse_loss_weights(reduce(DataFrame.unionByName, parts)).collect()}  # a row for each kind
    out = Ensemble({k: fit_calibrated(rows, k, numeric, categorical, label, day) for k in kinds}, weights)
    rows.unpersist()
    return out


def score_both_ways(model: Model | Ensemble | Formula, pairs: DataFrame, name: str = "probability") -> DataFrame:
    """Pairs with the mean of the model's probability for side a and one minus its probability with the sides exchanged.

    Each row is scored, turned round, scored again and turned back: no join brings both scores together.
    """
    back = model.score(swapped(model.score(pairs, "_there")), "_back")
    return swapped(back).withColumn(name, (F.col("_there") + 1 - F.col("_back")) / 2).drop("_there", "_back")


def safe_features(df: DataFrame, suffix: str = "_diff") -> list[str]:
    """Numeric difference columns that don't hold the contest's own outcome."""
    from .contracts import leaking_features

    found = [c for c, t in df.dtypes if c.endswith(suffix) and t in ("int", "bigint", "double", "float")]
    return [c for c in found if c not in leaking_features(found)]


class FeatureRegistry:
    """Fixed lists of features by version."""

    def __init__(self, versions: dict[str, Sequence[str]]):
        self.versions = {k: list(v) for k, v in versions.items()}

    def select(self, df: DataFrame, version: str, keys: Sequence[str] = ()) -> DataFrame:
        """The keys and the version's features; missing ones raise with their names."""
        if lacking := [c for c in self.versions[version] if c not in df.columns]:
            raise ValueError(f"{version} needs {', '.join(lacking)}")
        return df.select(*keys, *self.versions[version])
