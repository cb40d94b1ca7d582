"""Shrunk rates compiled from a list of families: one projection for all of them, and a table that says what each column is.

A family is a rate: a numerator and a denominator column, a neutral rate, and how much support counts as enough. All families share one pass
over the observations for the daily sums of their priors (grouping sets of day, and of day and group), one for the moments of their populations, and one shuffle by entity
for the histories.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import Steps
from .history import before, if_dated
from .pairs import swapped
from .shrinkage import mom_strength, smoothed, support_scaled, supported_source, valid_pair


@dataclass(frozen=True)
class Family:
    """A rate: its columns, the rate of no information, the strength of its prior, the denominator from which a group's rate is used, and from which one's own counts as supported."""

    name: str
    num: str
    den: str
    neutral: float
    strength: float
    group_least: float
    low_support: float
    fallback: float = 50.0


#: Fixed strengths of the first two variants.
FIXED = {"s20": 20.0, "s50": 50.0}
VARIANTS = (*FIXED, "own_strength", "support_scaled", "moments")
#: (part of a side's columns, what it is made of, the prior it shows, note)
PARTS = (
    ("rate", "raw", "", "own rate before the day"),
    ("num", "support", "", "sum of valid numerators before the day"),
    ("den", "support", "", "sum of valid denominators before the day"),
    ("prior", "prior", "group/global/neutral", "the prior that the shrunk rates lean on"),
    ("global_prior", "prior", "global", "the prior where it is the rate of all groups"),
    ("group_prior", "prior", "group", "the prior where it is the group's rate"),
    ("prior_source", "prior", "group/global/prior_only", "which prior it is, where there is support of one's own"),
    ("prior_den", "prior", "group/global/neutral", "denominator of the prior"),
    *((v, v, "group/global/neutral", "shrunk rate") for v in VARIANTS),
    ("support_scaled_strength", "support_scaled", "", "strength that falls with support"),
    ("moments_strength", "moments", "", "strength by the population's moments"),
    ("prior_only", "flag", "prior_only", "no support of one's own"),
    ("low_support", "flag", "", "less support than the family asks for"),
)
PAIR_PARTS = ("support_diff", "support_min", "support_asymmetry", "either_low_support", "both_low_support", "either_prior_only")


def available(df: DataFrame, families: Sequence[Family]) -> list[Family]:
    """The families whose columns are there."""
    return [f for f in families if {f.num, f.den} <= set(df.columns)]


def _running(obs: DataFrame, families: Sequence[Family], day: str, group: str) -> DataFrame:
    """(day, group, _all, n_<family>, d_<family>): sums of earlier days, of each group and (_all = 1, without group) of all."""
    dated = obs.filter(F.col(day).isNotNull())
    ok = {f.name: valid_pair(F.col(f.num), F.col(f.den)) for f in families}
    sums = [F.sum(F.when(ok[f.name], F.col(c)).otherwise(0.0)).alias(f"{p}_{f.name}") for f in families for p, c in (("n", f.num), ("d", f.den))]
    daily = dated.groupingSets([[F.col(day)], [F.col(day), F.col(group)]], F.col(day), F.col(group)).agg(F.grouping(group).alias("_all"), *sums)
    so_far = Window.partitionBy("_all", group).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    return daily.select(day, group, "_all", *[F.coalesce(F.sum(f"{p}_{f.name}").over(so_far), F.lit(0.0)).alias(f"{p}_{f.name}") for f in families for p in "nd"])


def _met_priors(rows: DataFrame, running: DataFrame, families: Sequence[Family], day: str, group: str) -> DataFrame:
    names = [f"{p}_{f.name}" for f in families for p in "nd"]
    own = running.filter("_all = 0").select(day, group, *[F.col(c).alias(f"_g{c}") for c in names])
    every = running.filter("_all = 1").select(day, *[F.col(c).alias(f"_a{c}") for c in names])
    out = rows.join(own, [day, group], "left").join(every, day, "left")
    made = {}
    for f in families:
        gn, gd, an, ad = (F.col(f"_{s}{p}_{f.name}") for s in "ga" for p in "nd")
        by_group, by_all = gd >= f.group_least, ad > 0
        made[f"{f.name}_prior"] = F.when(by_group, gn / gd).when(by_all, an / ad).otherwise(F.lit(f.neutral))
        made[f"{f.name}_source"] = F.when(by_group, "group").when(by_all, "global").otherwise("neutral")
        made[f"{f.name}_prior_den"] = F.when(by_group, gd).when(by_all, ad).otherwise(F.lit(0.0))
    return out.withColumns(made).drop(*[f"_{s}{c}" for s in "ga" for c in names])


def with_priors(obs: DataFrame, families: Sequence[Family], day: str = "event_day", group: str = "grp") -> DataFrame:
    """obs with <family>_prior, _prior_source and _prior_den of each family, from rows of earlier days.

    The sums by day and by day and group come from one pass with grouping sets; running sums then see a row for each day (and group), not each observation.
    """
    return _met_priors(obs, _running(obs, families, day, group), families, day, group)


def day_strengths(obs: DataFrame, families: Sequence[Family], key: str = "entity_id", day: str = "event_day") -> DataFrame:
    """(day, <family>_moments_strength): prior strengths by the moments of all entities' totals before each day, all families in one pass.

    Entities' sums by day change the totals that the moments are made of; the changes are added up by day and run over days. Sums and totals share one shuffle by entity.
    """
    dated = obs.filter(F.col(day).isNotNull()).select(key, day, *dict.fromkeys(c for f in families for c in (f.num, f.den))).repartition(F.col(key))
    pick = lambda f, c: F.sum(F.when(valid_pair(F.col(f.num), F.col(f.den)), F.col(c)))
    daily = dated.groupBy(key, day).agg(*[pick(f, c).alias(f"{p}_{f.name}") for f in families for p, c in (("x", f.num), ("n", f.den))])
    w, last = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(key).orderBy(day)
    total = daily.select(key, day, *[F.sum(f"{p}_{f.name}").over(w).alias(f"{p}_{f.name}") for f in families for p in "xn"])
    parts = {}
    for f in families:
        x, n = F.col(f"x_{f.name}"), F.col(f"n_{f.name}")
        parts |= {f"sx_{f.name}": x, f"sn_{f.name}": n, f"sq_{f.name}": n * n, f"sr_{f.name}": x * x / n, f"sc_{f.name}": F.when(n.isNotNull(), 1.0)}
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    change = total.select(day, *[(zero(v) - zero(F.lag(v).over(last))).alias(k) for k, v in parts.items()])
    per_day = change.groupBy(day).agg(*[F.sum(k).alias(k) for k in parts])
    so_far = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are days
    sums = per_day.select(day, *[zero(F.sum(k).over(so_far)).alias(k) for k in parts])
    of = lambda f: mom_strength(*[F.col(f"{s}_{f.name}") for s in ("sx", "sn", "sq", "sr", "sc")], f.fallback).alias(f"{f.name}_moments_strength")
    return sums.select(day, *[of(f) for f in families])


def _own_sums(families: Sequence[Family], key: str, day: str) -> dict[str, Column]:
    w = before(key, day)
    valid = lambda f, c: F.sum(F.when(valid_pair(F.col(f.num), F.col(f.den)), F.col(c))).over(w)
    return {f"{f.name}_{p}": if_dated(F.coalesce(valid(f, c), F.lit(0.0)), day) for f in families for p, c in (("num", f.num), ("den", f.den))}


def _derived(f: Family, day: str, side: str = "") -> dict[str, Column]:
    """The columns that follow from a side's sums (their names end in `side`) and from the day's and group's prior and strength, which both sides share."""
    n, d = (F.col(f"{f.name}_{x}{side}") for x in ("num", "den"))
    p, s = (F.col(f"{f.name}_{x}") for x in ("prior", "source"))
    source, scaled = supported_source(d, s), support_scaled(d, f.strength)
    strengths = {k: F.lit(v) for k, v in FIXED.items()} | {"own_strength": F.lit(f.strength), "support_scaled": scaled, "moments": F.col(f"{f.name}_moments_strength")}
    made = {v: smoothed(n, d, p, k) for v, k in strengths.items()}
    made |= {"rate": F.when(d > 0, n / d), "global_prior": F.when(source == "global", p), "group_prior": F.when(source == "group", p), "prior_source": if_dated(source, day)}
    made |= {"support_scaled_strength": if_dated(scaled, day), "prior_only": if_dated((source == "prior_only").cast("int"), day), "low_support": (d < f.low_support).cast("int")}
    return {f"{f.name}_{k}{side}": v for k, v in made.items()}


def side_features(obs: DataFrame, families: Sequence[Family], key: str = "entity_id", day: str = "event_day", group: str = "grp") -> DataFrame:
    """obs with <family>_<part> for each available family and each of PARTS, as known before the row's day. Undated rows get null."""
    have = available(obs, families)
    out = with_priors(obs, have, day, group).join(day_strengths(obs, have, key, day), day, "left").withColumns(_own_sums(have, key, day))
    return out.withColumns(reduce(lambda x, f: x | _derived(f, day), have, {})).drop(*[f"{f.name}_source" for f in have])


def side_columns(families: Sequence[Family]) -> list[str]:
    return [f"{f.name}_{p[0]}" for f in families for p in PARTS]


def pair_features(sides: DataFrame, families: Sequence[Family], contest: str = "contest_id", keep: Sequence[str] = ("event_day", "grp")) -> DataFrame:
    """One row for each contest of two rows: both sides' columns (_a, _b), <family>_<variant>_diff and the pair's support columns. One aggregation by contest."""
    have = available(sides, families)
    names = side_columns(have)
    both = sides.groupBy(contest, *keep).agg(F.array_sort(F.collect_list(F.struct("entity_id", *names))).alias("s")).filter(F.size("s") == 2)
    a, b = F.col("s")[0], F.col("s")[1]
    out = [contest, *keep, a["entity_id"].alias("entity_a"), b["entity_id"].alias("entity_b")]
    out += [x for n in names for x in (a[n].alias(f"{n}_a"), b[n].alias(f"{n}_b"))]
    return both.select(*out).withColumns(reduce(lambda d, f: d | _pair_columns(f), have, {}))


def paired_features(obs: DataFrame, families: Sequence[Family], only: Column | None = None, steps: Steps | None = None) -> DataFrame:
    """pair_features of side_features, of contests of the rows where `only` holds: the same rows from less that is shuffled.

    Rows meet by contest with their own sums alone. What depends on day and group is the same for both sides: it's written, as many rows as there are days and groups, and meets
    the pairs; all that follows from both is computed there.
    """
    have, steps, keep = available(obs, families), steps or Steps(obs.sparkSession, "smoothing"), ("event_day", "grp")
    running, strengths = steps.write(_running(obs, have, *keep)), steps.write(day_strengths(obs, have))
    sums = [f"{f.name}_{p}" for f in have for p in ("num", "den")]
    rows = obs.withColumns(_own_sums(have, "entity_id", "event_day"))
    rows = rows if only is None else rows.filter(only)
    contest = Window.partitionBy("contest_id", *keep)
    second = F.lead(F.struct("entity_id", *sums)).over(contest.orderBy("entity_id"))
    both = rows.select("contest_id", *keep, "entity_id", *sums).withColumns({"_b": second, "_n": F.count(F.lit(1)).over(contest)}).filter("_n = 2 and _b is not null")
    sides = [c.alias(f"{n}_{x}") for k, n in (("entity_id", "entity"), *((c, c) for c in sums)) for x, c in (("a", F.col(k)), ("b", F.col("_b")[k]))]
    met = _met_priors(both.select("contest_id", *keep, *sides), running, have, *keep).join(strengths, "event_day", "left")
    shared = {f"{f.name}_{p}_{x}": F.col(f"{f.name}_{p}") for f in have for p in ("prior", "prior_den", "moments_strength") for x in "ab"}
    made = reduce(lambda d, f: d | _derived(f, "event_day", "_a") | _derived(f, "event_day", "_b"), have, shared)
    out = met.withColumns(made).select("contest_id", *keep, "entity_a", "entity_b", *[f"{c}_{x}" for c in side_columns(have) for x in "ab"])
    return out.withColumns(reduce(lambda d, f: d | _pair_columns(f), have, {}))


def _pair_columns(f: Family) -> dict[str, Column]:
    side = lambda p, s: F.col(f"{f.name}_{p}_{s}")
    out = {f"{f.name}_{v}_diff": side(v, "a") - side(v, "b") for v in VARIANTS}
    flag = lambda p, s: F.coalesce(side(p, s), F.lit(0)) == 1
    return out | {
        f"{f.name}_support_diff": side("den", "a") - side("den", "b"),
        f"{f.name}_support_min": F.least(side("den", "a"), side("den", "b")),
        f"{f.name}_support_asymmetry": F.abs(side("den", "a") - side("den", "b")),
        f"{f.name}_either_low_support": (flag("low_support", "a") | flag("low_support", "b")).cast("int"),
        f"{f.name}_both_low_support": (flag("low_support", "a") & flag("low_support", "b")).cast("int"),
        f"{f.name}_either_prior_only": (flag("prior_only", "a") | flag("prior_only", "b")).cast("int"),
    }


def injected(obs: DataFrame, requests: DataFrame, families: Sequence[Family]) -> DataFrame:
    """Pair features of requests (contest_id, event_day, grp, entity_a, entity_b), in both directions, named in row_direction.

    A request's sides are put among the observations as rows without values: they see what was known before their day and are seen by none, so a request has the
    features that a contest of that day would have. Contest ids of requests mustn't be those of contests. entity_a and entity_b stand as they were asked.
    """
    have = available(obs, families)
    side = lambda x, y: F.struct(F.col(f"entity_{x}").alias("entity_id"), F.col(f"entity_{y}").alias("opponent_id"))
    asked = requests.select("contest_id", "event_day", "grp", F.explode(F.array(side("a", "b"), side("b", "a"))).alias("s")).select("contest_id", "event_day", "grp", "s.entity_id")
    columns = ["contest_id", "event_day", "grp", "entity_id", *sorted({c for f in have for c in (f.num, f.den)})]
    rows = obs.select(*columns, F.lit(False).alias("_asked")).unionByName(asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    pairs = paired_features(rows, have, F.col("_asked"))
    first = pairs.join(requests.select("contest_id", F.col("entity_a").alias("_first")), "contest_id")
    back = swapped(first)
    wanted = F.col("entity_a") == F.col("_first")
    there = first.filter(wanted).unionByName(back.filter(wanted)).drop("_first")
    return there.withColumn("row_direction", F.lit("a_minus_b")).unionByName(swapped(there).withColumn("row_direction", F.lit("b_minus_a")))


def manifest(df: DataFrame, families: Sequence[Family]) -> list[tuple[str, str, str, str, str, str]]:
    """(column, family, side, made_of, prior, note) of each column that pair_features makes, in its order; only of families whose columns df has."""
    out = []
    have = available(df, families)
    for f in have:
        out += [(f"{f.name}_{part}_{s}", f.name, s, kind, prior, note) for part, kind, prior, note in PARTS for s in "ab"]
    for f in have:
        out += [(f"{f.name}_{v}_diff", f.name, "diff", v, "group/global/neutral", "difference of shrunk rates") for v in VARIANTS]
        out += [(f"{f.name}_{p}", f.name, "pair", "support", "prior_only" if "prior_only" in p else "", "support of both sides") for p in PAIR_PARTS]
    return out


@contextmanager
def methods_the_jvm_compiles(spark: SparkSession) -> Iterator[None]:
    """What is executed within has no generated method over 8000 bytes, which HotSpot never compiles: plans that have one are run by smaller ones.

    The families' columns are such a plan. Execute in it (write), as a frame that is only made here is planned where it is executed.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    was = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def manifest_rows(pairs: DataFrame, listed: Sequence[tuple]) -> DataFrame:
    """The manifest as a table, with n_known and mean of each column over the pairs. One aggregation for all columns; a text column has no mean."""
    kinds = dict(pairs.dtypes)
    number = lambda c: F.try_divide(F.sum(F.col(c).cast("double")), F.count(c)) if kinds[c] != "string" else F.lit(None).cast("double")
    item = lambda x: F.struct(*[F.lit(v).alias(n) for n, v in zip(("column_name", "family", "side", "made_of", "prior", "note"), x, strict=True)], F.count(x[0]).alias("n_known"), number(x[0]).alias("mean"))
    return pairs.agg(F.array(*[item(x) for x in listed]).alias("m")).select(F.explode("m").alias("m")).select("m.*")
