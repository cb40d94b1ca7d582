"""The whole answer to "who wins, a or b, on that day": both histories, ratings, probability, market and reliability in one row for each request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import confidence_tier, decimal_odds, edge_label, expected_score, no_vig, shrink_to_half
from .compare import reliability
from .history import Spec, as_of_lookup, before, career_rates, career_specs, snapshots
from .ratings import rating_snapshots

SIDE = ("contests", "wins", "losses", "win_rate", "accuracy", "per_minute", "days_since_last", "in_group", "rating")
#: Points off the reliability of 100: (name, for each side, points).
PENALTIES = (("few_contests", 15), ("not_in_group", 10), ("long_ago", 10), ("no_rating", 20))


def ratings_after(snapshots_: DataFrame, pairs: DataFrame | None = None, k: float = 32.0) -> DataFrame:
    """(entity_id, event_day, contest_id, rating): each side's rating after each decisive contest. snapshots_: not frozen by day; without pairs, with scores."""
    seen = snapshots_.filter("score_a is not null") if pairs is None else snapshots_.join(pairs.filter("score_a is not null").select("contest_id", "score_a"), "contest_id")
    gain = F.lit(k) * (F.col("score_a") - expected_score(F.col("rating_a"), F.col("rating_b")))
    side = lambda x, sign: F.struct(F.col(f"entity_{x}").alias("entity_id"), (F.col(f"rating_{x}") + sign * gain).alias("rating"))
    return seen.select("contest_id", "event_day", F.explode(F.array(side("a", 1), side("b", -1))).alias("s")).select("s.entity_id", "event_day", "contest_id", "s.rating")


def _sides(obs: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, side, history before the day) for both sides of each request. Sides stand among the entities' observations as rows that count nothing."""
    side = lambda x: F.struct(F.lit(x).alias("side"), F.col(f"entity_{x}").alias("entity_id"))
    asked = requests.select("request_id", "event_day", "grp", F.explode(F.array(side("a"), side("b"))).alias("s")).select("request_id", "event_day", "grp", "s.side", "s.entity_id")
    own = obs.join(asked.select("entity_id").distinct(), "entity_id", "left_semi")
    rows = own.withColumn("_real", F.lit(True)).unionByName(asked.withColumn("_real", F.lit(False)), allowMissingColumns=True)
    specs = [Spec(s.name, s.agg, F.when(F.col("_real"), s.value)) for s in career_specs()]
    out = snapshots(rows, specs).withColumn("in_group", F.count(F.when(F.col("_real"), 1)).over(before(["entity_id", "grp"], "event_day")))
    return career_rates(out.filter("not _real"))


def whole_answers(obs: DataFrame, requests: DataFrame, start: float = 1500.0, k: float = 32.0, shrink: float = 0.9, few: int = 5, long_days: int = 730) -> DataFrame:
    """requests (request_id, entity_a, entity_b, event_day, grp, odds_a, odds_b) with both sides' SIDE columns (_a, _b) and differences, probability_a, tier,
    market_a, edge, edge_reading, reliability_score, reliability, reliability_reasons and pick.

    Only what was known before a request's day counts: contests of the day itself don't. The probability is the ratings' expectation, shrunk to one half; a side without a rated contest
    has the rating that all start with. Odds are texts in either notation; without both there is no market. A request without a day has a null history.
    """
    sides = _sides(obs, requests)
    rated = ratings_after(rating_snapshots(obs, by_group=False, k=k, start=start, frozen=False, with_score=True), k=k)
    sides = as_of_lookup(sides.drop("contest_id"), rated, "entity_id", "event_day", "event_day", ["contest_id", "rating"]).select("request_id", "side", *SIDE)
    one = lambda s, p: sides.filter(F.col("side") == s).select("request_id", *[F.col(c).alias(f"{c}_{p}") for c in SIDE])
    out = requests.join(one("a", "a"), "request_id", "left").join(one("b", "b"), "request_id", "left")
    ra, rb = (F.coalesce(f"rating_{s}", F.lit(start)) for s in "ab")
    p = shrink_to_half(expected_score(ra, rb), shrink)
    market, _ = no_vig(decimal_odds(F.col("odds_a")), decimal_odds(F.col("odds_b")))
    out = out.withColumns({f"{c}_diff": F.col(f"{c}_a") - F.col(f"{c}_b") for c in SIDE} | {"probability_a": p, "tier": confidence_tier(p), "market_a": market, "edge": p - market})
    fails = lambda s: {"few_contests": F.coalesce(F.col(f"contests_{s}"), F.lit(0)) < few, "not_in_group": F.coalesce(F.col(f"in_group_{s}"), F.lit(0)) == 0, "long_ago": F.col(f"days_since_last_{s}") > long_days, "no_rating": F.col(f"rating_{s}").isNull()}
    rules: dict[str, tuple[Column, int]] = {f"{name}_{s}": (fails(s)[name], points) for s in "ab" for name, points in PENALTIES}
    out = reliability(out, rules)
    pick = F.when(F.col("probability_a") > 0.5, F.col("entity_a")).when(F.col("probability_a") < 0.5, F.col("entity_b"))
    return out.withColumns({"edge_reading": edge_label(F.col("edge"), F.col("reliability")), "pick": pick})


def as_documents(answers: DataFrame) -> DataFrame:
    """(request_id, answer): each answer as one JSON document: sides, differences, forecast, market, reliability. Nulls are written."""
    side = lambda s: F.struct(F.col(f"entity_{s}").alias("entity"), *[F.col(f"{c}_{s}").alias(c) for c in SIDE])
    parts = F.struct(
        F.struct("request_id", "event_day", "grp").alias("request"),
        F.struct(side("a").alias("a"), side("b").alias("b")).alias("sides"),
        F.struct(*[F.col(f"{c}_diff").alias(c) for c in SIDE]).alias("differences"),
        F.struct("probability_a", "tier", "pick").alias("forecast"),
        F.struct("market_a", "edge", "edge_reading").alias("market"),
        F.struct(F.col("reliability_score").alias("score"), F.col("reliability").alias("level"), F.col("reliability_reasons").alias("reasons")).alias("reliability"),
    )
    return answers.select("request_id", F.to_json(parts, {"ignoreNullFields": "false"}).alias("answer"))
