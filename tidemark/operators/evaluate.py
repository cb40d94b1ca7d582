"""Chronological evaluation: splits, metrics, calibration, symmetry, bootstrap, forecast scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import Steps


def holdout(df: DataFrame, start: Column, day: str = "event_day") -> DataFrame:
    """df with split: train before the start, test from it on; undated rows drop out."""
    return df.filter(F.col(day).isNotNull()).withColumn("split", F.when(F.col(day) < start, "train").otherwise("test"))


def date_blocks(df: DataFrame, blocks: int = 4, day: str = "event_day") -> DataFrame:
    """(day, block): distinct days cut into nearly equal runs, larger ones first. The table of days is small."""
    return df.select(day).filter(F.col(day).isNotNull()).distinct().withColumn("block", F.ntile(blocks).over(Window.orderBy(day)).cast("bigint"))


def expanding_folds(df: DataFrame, blocks: int = 4, day: str = "event_day") -> DataFrame:
    """df once for each fold it takes part in: fold f tests on block f + 1 and trains on all blocks before."""
    cut = df.join(F.broadcast(date_blocks(df, blocks, day)), day)
    folds = F.explode(F.sequence(F.greatest(F.col("block") - 1, F.lit(1).cast("bigint")), F.lit(blocks - 1).cast("bigint")))
    return cut.filter(F.lit(blocks > 1)).withColumn("fold", folds).withColumn("part", F.when(F.col("block") == F.col("fold") + 1, "test").otherwise("train"))


def calibration_day(df: DataFrame, share: float = 0.8, day: str = "event_day") -> DataFrame:
    """One row, `boundary`: the day at this share of the distinct days."""
    days = df.select(day).filter(F.col(day).isNotNull()).distinct()
    ranked = days.withColumn("n", F.row_number().over(Window.orderBy(day)) - 1).crossJoin(F.broadcast(days.agg(F.count(F.lit(1)).alias("total"))))
    return ranked.filter(F.col("n") == F.least(F.floor(F.col("total") * share), F.col("total") - 1)).select(F.col(day).alias("boundary"))


def metrics(df: DataFrame, label: str = "label", probability: str = "probability", clip: float = 1e-6) -> DataFrame:
    """One row: n, accuracy, balanced_accuracy, log_loss, brier, auc. Labels are 0 or 1; rows without a label or probability take no part.

    The rows are counted by probability, once, and the counts are written: all metrics are sums over them. AUC is the rank sum over distinct
    probabilities, accumulated over ranges of them.
    """
    y = F.col(label).cast("double")
    d = df.select(y.alias("y"), F.col(probability).cast("double").alias("p")).filter("y is not null and p is not null")
    counts = Steps(df.sparkSession, "metrics").write(d.groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")))
    q = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), F.col("p")))
    pos, neg, yes = F.col("pos"), F.col("neg"), F.col("p") >= 0.5
    n, of_pos, of_neg = F.sum(pos + neg), F.nullif(F.sum(pos), F.lit(0.0)), F.nullif(F.sum(neg), F.lit(0.0))
    right = lambda when, c: F.sum(F.when(when, c).otherwise(0.0))
    one = counts.agg(
        F.coalesce(n, F.lit(0.0)).cast("bigint").alias("n"),
        ((right(yes, pos) + right(~yes, neg)) / n).alias("accuracy"),
        ((right(yes, pos) / of_pos + right(~yes, neg) / of_neg) / 2).alias("balanced_accuracy"),
        (F.sum(-(pos * F.ln(q) + neg * F.ln(1 - q))) / n).alias("log_loss"),
        (F.sum(pos * (F.col("p") - 1) ** 2 + neg * F.col("p") ** 2) / n).alias("brier"),
    )
    # ranges that hold about as many distinct probabilities each, wherever these lie
    cuts = sorted(set(counts.agg(F.percentile_approx("p", [i / 128 for i in range(1, 128)], 2000)).first()[0] or []))
    parts = counts.withColumn("b", F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col("p"))) if cuts else F.lit(0))
    below = parts.groupBy("b").agg(F.sum("neg").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select("b", "base")
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("b").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    auc = parts.withColumn("inside", inside).join(F.broadcast(below), "b").agg((F.sum(pos * (F.col("base") + F.col("inside") + neg / 2)) / F.nullif(F.sum(pos) * F.sum(neg), F.lit(0.0))).alias("auc"))
    return one.crossJoin(auc)


def calibration(df: DataFrame, bins: int = 10, right_closed: bool = True, label: str = "label", probability: str = "probability") -> DataFrame:
    """(bin, n, mean_probability, observed): all bins, also empty ones. Right-closed bins take 0 into the first, left-closed ones 1 into the last."""
    p = F.col(probability)
    b = F.greatest(F.lit(1), F.ceil(p * bins)) if right_closed else F.least(F.lit(bins), F.floor(p * bins) + 1)
    got = df.filter(p.isNotNull() & F.col(label).isNotNull()).groupBy(b.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_probability"), F.avg(F.col(label).cast("double")).alias("observed"))
    every = df.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin")
    return every.join(got, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def symmetry_error(rows: DataFrame, probability: str = "probability", contest: str = "contest_id") -> DataFrame:
    """One row: how far both orientations' probabilities are from adding up to 1."""
    pick = lambda d: F.max(F.when(F.col("row_direction") == d, F.col(probability)))
    e = rows.groupBy(contest).agg(F.abs(pick("a_minus_b") + pick("b_minus_a") - 1).alias("e")).filter("e is not null")
    return e.agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("mean_error"), F.median("e").alias("median_error"), F.max("e").alias("max_error"), F.count_if(F.col("e") > 0.05).alias("over_005"))


def day_bootstrap(df: DataFrame, value: str, replicates: int = 200, day: str = "event_day") -> DataFrame:
    """One row: mean of the value with a 95 % interval from resampling whole days.

    Days are summed first; a replicate draws as many days as there are, each by a hash of its number, so any engine can repeat it.
    """
    days = df.filter(F.col(value).isNotNull() & F.col(day).isNotNull()).groupBy(day).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    numbered = days.withColumn("i", F.row_number().over(Window.orderBy(day)) - 1)
    total = F.broadcast(days.agg(F.count(F.lit(1)).alias("days")))
    draws = df.sparkSession.range(replicates).withColumnRenamed("id", "r").crossJoin(total).select("r", "days", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("days") - 1)).alias("k"))
    draws = draws.withColumn("i", F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", "r", "k").cast("binary")), 1, 8), 16, 10).cast("bigint"), F.col("days")).cast("int"))
    means = draws.join(numbered.select("i", "s", "n"), "i").groupBy("r").agg((F.sum("s") / F.sum("n")).alias("m"))
    mean = days.agg((F.sum("s") / F.sum("n")).alias("mean"))
    return mean.crossJoin(means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high")))


def ledger_scores(forecasts: DataFrame, outcomes: DataFrame, key: str = "forecast_id") -> DataFrame:
    """One row: forecasts, scored ones, Brier score. A forecast's latest outcome (by seq) counts, corrections included."""
    last = outcomes.groupBy(key).agg(F.max_by("outcome", "seq").alias("outcome"))
    joined = forecasts.join(last, key, "left")
    return joined.agg(F.count(F.lit(1)).alias("forecasts"), F.count("outcome").alias("scored"), F.avg((F.col("probability") - F.col("outcome")) ** 2).alias("brier"))


def hash_folds(df: DataFrame, folds: int, key: str = "contest_id", seed: int = 0) -> DataFrame:
    """df with `fold` by a hash of the key, so that all rows of a contest share one; the order of time is not kept."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(folds)).cast("int"))


def fold_count(df: DataFrame, label: str = "label", requested: int = 5) -> DataFrame:
    """One row, `folds`: by the rarer class's rows 5 (or fewer if asked for), 3 or 2; null with fewer than 2 rows of it, or none at all."""
    least = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"))
    return least.select(F.when(F.col("least") >= 5, min(requested, 5)).when(F.col("least") >= 3, 3).when(F.col("least") >= 2, 2).alias("folds"))


def stratified_folds(df: DataFrame, label: str = "label", key: str = "contest_id", seed: int = 42) -> DataFrame:
    """Labelled rows with `fold`: shuffled by a hash of the key, every class dealt evenly over fold_count folds; no rows if there can be none.

    Rows are ranked within 4096 ranges of the hash, and ranges are added up, so that no class is one task.
    """
    n = fold_count(df, label).first().folds
    h = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    rows = df.filter(F.col(label).isNotNull() & F.lit(n is not None)).withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 3))
    sizes = rows.groupBy(F.col(label).alias("_l"), F.col("_b").alias("_c")).agg(F.count(F.lit(1)).alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy("_l").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)) - 1
    placed = rows.withColumn("_i", inside).join(F.broadcast(sizes.withColumn("_base", before)), (F.col(label) == F.col("_l")) & (F.col("_b") == F.col("_c")))  # 4096 rows a class
    return placed.withColumn("fold", F.pmod(F.col("_i") + F.col("_base"), F.lit(n or 1)).cast("int")).drop("_h", "_b", "_l", "_c", "_s", "_i", "_base")


def split_overlap(train: DataFrame, test: DataFrame, key: str = "contest_id") -> DataFrame:
    """Keys that stand in both parts; a sound split has none."""
    return train.select(key).intersect(test.select(key))


def register_protocol(df: DataFrame, boundaries: dict[str, str], name: str, day: str = "event_day", contest: str = "contest_id") -> DataFrame:
    """(protocol, part, contests, rows, first_day, last_day, digest): parts of a frozen evaluation; a part runs up to its boundary day, the last has none.

    The digest is over the part's contests and days, so a later run can tell whether its input is the one that was registered.
    """
    part = None
    for label, until in boundaries.items():
        condition = F.col(day) < F.lit(until).cast("date") if until else F.lit(True)
        part = F.when(condition, label) if part is None else part.when(condition, label)
    rows = df.filter(F.col(day).isNotNull()).withColumn("part", part).filter("part is not null")
    return rows.groupBy("part").agg(
        F.count_distinct(contest).alias("contests"),
        F.count(F.lit(1)).alias("rows"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
        F.sha2(F.sum(F.xxhash64(contest, day).cast("decimal(38,0)")).cast("string"), 256).alias("digest"),
    ).withColumn("protocol", F.lit(name))


def retrospective(cases: DataFrame, models: Sequence[str], boundaries: dict[str, str], name: str, bins: int = 10, replicates: int = 200, label: str = "label", day: str = "event_day", contest: str = "contest_id") -> DataFrame:
    """(model, part, section, item, value): one frozen evaluation of several probability columns over the parts of a protocol, baselines being models like any other.

    Sections: protocol (contests of each part), metrics, calibration (bins with rows: their share observed), and interval (of the Brier score, from resampling days).
    Cases are written once; every number comes from these rows.
    """
    rows = Steps(cases.sparkSession, "retrospective").write(cases.select(contest, day, label, *models).filter(F.col(day).isNotNull() & F.col(label).isNotNull()))
    parts = register_protocol(rows, boundaries, name, day, contest)
    text = lambda x: F.lit(x).cast("string")
    out = parts.select(text(None).alias("model"), "part", F.lit("protocol").alias("section"), F.lit("contests").alias("item"), F.col("contests").cast("double").alias("value"))
    since = None
    for part, until in boundaries.items():
        own = rows
        if since:
            own = own.filter(F.col(day) >= F.lit(since).cast("date"))
        if until:
            own = own.filter(F.col(day) < F.lit(until).cast("date"))
        since = until
        for m in models:
            p = own.withColumn("probability", F.col(m))
            long = lambda df, names, section, m=m, part=part: df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("item"), F.col(n).cast("double").alias("value")) for n in names])).alias("i")).select(F.lit(m).alias("model"), F.lit(part).alias("part"), F.lit(section).alias("section"), "i.item", "i.value")
            out = out.unionByName(long(metrics(p, label), ["n", "accuracy", "balanced_accuracy", "log_loss", "brier", "auc"], "metrics"))
            shown = calibration(p, bins, label=label).filter("n > 0")
            out = out.unionByName(shown.select(F.lit(m).alias("model"), F.lit(part).alias("part"), F.lit("calibration").alias("section"), F.concat(F.lit("bin "), F.col("bin").cast("string")).alias("item"), F.col("observed").alias("value")))
            error = p.withColumn("e", (F.col("probability") - F.col(label)) ** 2)
            out = out.unionByName(long(day_bootstrap(error, "e", replicates, day), ["mean", "low", "high"], "interval"))
    return out
