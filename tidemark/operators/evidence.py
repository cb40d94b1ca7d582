"""What a comparison rests on: contests normalised for description, cleaned observations, requests, aliases, evidence rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import age_columns, clean_text, finite_non_negative, group_key, iso_date, name_key, safe_div


def normalised_contests(asked: DataFrame, rows: DataFrame, counts: Sequence[str], limits: Sequence[tuple[str, str]], seconds: str = "seconds", control: str | None = None) -> DataFrame:
    """For each (contest_id, entity_id, opponent_id) asked for: paired, duration, own and other (structs of the counts), issues and other_issues (maps).

    A side's row counts only if the contest has exactly one of that entity; the other's only if both do and they differ. Counts that are
    missing, negative or not finite are null, and so are both of a limit's pair (part, whole) where the part exceeds the whole. The duration is
    null unless it is positive and, in a pair, the same on both sides; a control time over the duration is null. issues says why.
    """
    sides = asked.select("contest_id", "entity_id", "opponent_id").distinct()
    facts = rows.select("contest_id", F.col("entity_id").alias("_who"), F.struct(*[finite_non_negative(F.col(c)).alias(c) for c in counts], finite_non_negative(F.col(seconds)).alias("_seconds")).alias("_row"))
    met = sides.join(facts, "contest_id", "left")
    mine, theirs = F.col("_who") == F.col("entity_id"), F.col("_who") == F.col("opponent_id")
    one = met.groupBy("contest_id", "entity_id", "opponent_id").agg(
        F.count_if(mine).alias("_n_own"), F.count_if(theirs).alias("_n_other"), F.first(F.when(mine, F.col("_row")), True).alias("_own"), F.first(F.when(theirs, F.col("_row")), True).alias("_other")
    )
    unique = F.col("_n_own") == 1
    paired = unique & (F.col("_n_other") == 1) & F.coalesce(F.col("opponent_id") != F.col("entity_id"), F.lit(False))
    one = one.select("contest_id", "entity_id", "opponent_id", paired.alias("paired"), F.when(unique, F.col("_own")).alias("_own"), F.when(paired, F.col("_other")).alias("_other"))
    length = lambda side: F.when(F.col(side)["_seconds"] > 0, F.col(side)["_seconds"])
    differ = F.col("paired") & ~length("_own").eqNullSafe(length("_other"))
    one = one.withColumn("_differ", differ).withColumn("duration", F.when(~F.col("_differ"), length("_own")))

    def told(side: str) -> tuple[Column, Column]:
        """The side's counts, and the reasons of those that are null."""
        values, reasons = {c: F.col(side)[c] for c in counts}, {c: F.when(F.col(side)[c].isNull(), "missing_or_invalid") for c in counts}
        for part, whole in limits:
            over = F.coalesce(F.col(side)[part] > F.col(side)[whole], F.lit(False))
            for c in (part, whole):
                values[c], reasons[c] = F.when(~over, values[c]), F.when(over, "part_exceeds_whole").otherwise(reasons[c])
        if control:
            over = F.coalesce(values[control] > F.col("duration"), F.lit(False))
            values[control], reasons[control] = F.when(~over, values[control]), F.when(over, "longer_than_contest").otherwise(reasons[control])
        if side == "_own":
            reasons["duration"] = F.when(F.col("_differ"), "durations_differ")
        entries = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), r.alias("value")) for c, r in reasons.items()]), lambda x: x["value"].isNotNull())
        return F.struct(*[v.alias(c) for c, v in values.items()]), F.map_from_entries(entries)

    (own, issues), (other, other_issues) = told("_own"), told("_other")
    return one.select("contest_id", "entity_id", "opponent_id", "paired", "duration", own.alias("own"), other.alias("other"), issues.alias("issues"), other_issues.alias("other_issues"))


def cleaned_observations(df: DataFrame, totals: Mapping[str, Sequence[str]], filled: Sequence[str], differences: Mapping[str, tuple[str, str]], per_minute: Sequence[str] = (), per_15: Sequence[str] = (), seconds: str = "seconds") -> DataFrame:
    """df with totals from their parts where the whole column is absent, numbers with 0 for what is missing, minutes, differences and their rates.

    Parts that are absent too count as 0. A rate is null where there are no minutes.
    """
    number = lambda d, c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if c in d.columns else F.lit(0.0)
    out = df.withColumns({t: sum((number(df, p) for p in parts), F.lit(0.0)) for t, parts in totals.items() if t not in df.columns})
    out = out.withColumns({c: number(out, c) for c in dict.fromkeys([*filled, seconds])})
    out = out.withColumn("minutes", F.col(seconds) / 60).withColumns({d: F.col(a) - F.col(b) for d, (a, b) in differences.items()})
    rate = lambda c, factor: F.when(F.col("minutes") > 0, F.col(c) / F.col("minutes") * factor)
    return out.withColumns({f"{c}_per_minute": rate(c, 1.0) for c in per_minute} | {f"{c}_per_15": rate(c, 15.0) for c in per_15})


def alias_columns(df: DataFrame, aliases: Sequence[tuple[str, str]], age: str | None = None, method_totals: Mapping[str, tuple[str, str]] | None = None, known: str | None = None) -> DataFrame:
    """df with (source, target) columns where the source is there and the target isn't, what models take of an age, and shares of contests by method.

    method_totals: target -> (wins, losses) by that method; the share is of the contests with a known method, null where there are none.
    """
    out = df
    for source, target in aliases:
        if source in out.columns and target not in out.columns:
            out = out.withColumn(target, F.col(source))
    new = age_columns(F.col(age).cast("double")) if age and age in out.columns else {}
    if known and known in out.columns:
        total = lambda pair: sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in pair if c in df.columns), F.lit(0.0))
        new |= {target: safe_div(total(pair), F.col(known).cast("double")) for target, pair in (method_totals or {}).items()}
    return out.withColumns({c: v for c, v in new.items() if c not in out.columns})


def checked_requests(requests: DataFrame, groups: Sequence[str], aliases: Mapping[str, str] | None = None) -> DataFrame:
    """requests (day as text, grp, a_name, a_id, b_name, b_id) with `canonical_grp` and `problem`: bad_day, unknown_group, same_entity or null.

    A group is known by its normalised name. Two sides are the same with the same id and the same name key.
    """
    known = F.create_map(*[x for g in groups for x in (F.lower(clean_text(F.lit(g))), F.lit(g))])
    canonical = F.try_element_at(known, F.lower(group_key(F.col("grp"), dict(aliases or {}))))
    same = F.col("a_id").eqNullSafe(F.col("b_id")) & name_key(F.col("a_name")).eqNullSafe(name_key(F.col("b_name")))
    problem = F.when(iso_date(F.col("day")).isNull(), "bad_day").when(canonical.isNull(), "unknown_group").when(same, "same_entity")
    return requests.withColumns({"canonical_grp": canonical, "problem": problem})


def profile_aliases(profiles: DataFrame, columns: Sequence[str], order: str, canonical: str | None = None, route: str | None = None, routes: Sequence[str] = ()) -> DataFrame:
    """(name_key, display): every name of a profile leads to its canonical display name, or to itself where that is blank; later rows win.

    With a route column only rows whose route is blank or one of `routes` (any case) take part.
    """
    rows = profiles if route is None else profiles.filter(F.lower(F.trim(F.coalesce(route, F.lit("")))).isin("", *routes))
    there = [c for c in columns if c in rows.columns]
    some = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    display = some(canonical) if canonical in rows.columns else F.lit(None).cast("string")
    names = F.filter(F.array(*[some(c) for c in there]), lambda x: x.isNotNull()) if there else F.array().cast("array<string>")
    each = rows.select(F.col(order).alias("_o"), display.alias("_d"), F.posexplode(names).alias("_i", "_n")).withColumn("_d", F.coalesce("_d", "_n"))
    both = each.select("_o", "_i", "_d", F.posexplode(F.array("_n", "_d")).alias("_j", "_x"))
    keyed = both.withColumn("name_key", name_key(F.col("_x"))).filter(F.col("name_key") != "")
    return keyed.groupBy("name_key").agg(F.max_by("_d", F.struct("_o", "_i", "_j", "_d")).alias("display"))


def entity_rows(df: DataFrame, name: str, column: str = "name") -> DataFrame:
    """Rows whose name has the same key."""
    return df.filter(name_key(F.col(column)) == name_key(F.lit(name)))


def evidence_rows(metrics: DataFrame, contests: DataFrame, chosen: Mapping[str, str], key: str = "contest_id") -> DataFrame:
    """(key, metric, label, unit, a, b, support) of the chosen metrics; support says how many earlier contests each side has (contests_a, contests_b)."""
    names = F.create_map(*[x for m, label in chosen.items() for x in (F.lit(m), F.lit(label))])
    count = lambda c: F.coalesce(F.col(c).cast("bigint").cast("string"), F.lit("N/A"))
    support = F.concat(F.lit("earlier contests: a "), count("contests_a"), F.lit(", b "), count("contests_b"))
    picked = metrics.filter(F.col("metric").isin(*chosen)).withColumn("label", F.element_at(names, F.col("metric")))
    return picked.join(contests.select(key, support.alias("support")), key, "left").select(key, "metric", "label", "unit", "a", "b", "support")


def overview(metrics: DataFrame, order: Sequence[str], key: str = "contest_id") -> DataFrame:
    """(key, place, metric, unit, a, b, diff): the listed metrics in the list's order."""
    return metrics.filter(F.col("metric").isin(*order)).select(key, F.array_position(F.array(*[F.lit(m) for m in order]), F.col("metric")).alias("place"), "metric", "unit", "a", "b", "diff")


def input_status(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, status): missing where there is no such column, empty where all its values are null, else ok. One aggregation."""
    there = [f for f in features if f in rows.columns]
    one = rows.agg(*[F.count(F.col(f)).alias(f) for f in there]) if there else rows.sparkSession.range(1)
    items = [F.struct(F.lit(f).alias("feature"), F.when(F.col(f) == 0, "empty").otherwise("ok").alias("status")) if f in there else F.struct(F.lit(f).alias("feature"), F.lit("missing").alias("status")) for f in features]
    return one.select(F.explode(F.array(*items)).alias("i")).select("i.*")


