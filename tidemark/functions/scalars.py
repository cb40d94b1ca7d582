"""Column functions: guards, parsers, normalisers, buckets. Every one is an expression; none is a Python function of rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing value.
BLANK_TOKENS = ("", "nan", "none", "null", "--", "---")


def safe_div(num: Column, den: Column, default: float | None = None) -> Column:
    """num / den; default (null) where either is null or den is 0."""
    out = F.when(den != 0, num / den)
    return out if default is None else F.coalesce(out, F.lit(default))


def clip01(x: Column) -> Column:
    """x within [0, 1]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def clipped_rate(num: Column, den: Column, fallback: Column | None = None) -> Column:
    rate = clip01(F.when(den > 0, num / den))
    return rate if fallback is None else F.coalesce(rate, fallback)


def finite_non_negative(x: Column) -> Column:
    """x as a number, or null where it is missing, negative, infinite or not a number."""
    v = x.try_cast("double")
    return F.when(~F.isnan(v) & (v >= 0) & (v < float("inf")), v)


def blankish(x: Column) -> Column:
    """True where a text is null or stands for a missing value."""
    return x.isNull() | F.lower(F.trim(x)).isin(*BLANK_TOKENS)


def clean_text(x: Column) -> Column:
    """No-break spaces and runs of white space become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(F.translate(x, " ", " "), r"\s+", " "))


def canonical_value(x: Column) -> Column:
    """Text form for comparisons: blank is null, midnight is dropped from dates, numbers lose trailing zeros, white space collapses."""
    t = clean_text(x)
    day = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})(?:[T ]00:00:00(?:\.0+)?)?$", 1)
    number = F.regexp_extract(t, r"^([+-]?\d+(?:\.\d+)?)$", 1).try_cast("decimal(38,10)").cast("string")
    short = F.regexp_replace(F.regexp_replace(number, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(F.nullif(t, F.lit("")).isNull(), None).when(day != "", day).otherwise(F.coalesce(F.when(short == "-0", "0").otherwise(short), t))


def _given(x: Column) -> Column:
    """A cell's cleaned text; null for the marks of an empty cell."""
    t = clean_text(x)
    return F.when(~t.isin("", "--", "---"), t)


def parse_int(x: Column) -> Column:
    """First whole number in a text; null for the marks of an empty cell."""
    return F.regexp_extract(_given(x), r"(-?\d+)", 1).try_cast("bigint")


def parse_float(x: Column) -> Column:
    """The text as a number, percent signs taken off; else the first number in it."""
    t = F.regexp_replace(_given(x), "%", "")
    whole = F.when(F.trim(t).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
    return F.coalesce(whole, F.regexp_extract(t, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double"))


def parse_percent(x: Column) -> Column:
    """A share: values over 1 are taken as percent."""
    v = parse_float(x)
    return F.when(v > 1, v / 100).otherwise(v)


def parse_of_pair(x: Column) -> Column:
    """'x of y' as struct(made, tried); one number leaves tried null."""
    found = F.regexp_extract_all(x, F.lit(r"(\d+)"), 1)
    number = lambda i: F.try_element_at(found, F.lit(i)).try_cast("bigint")
    return F.struct(number(1).alias("made"), number(2).alias("tried"))


def clock_seconds(x: Column) -> Column:
    """mm:ss or hh:mm:ss as seconds; a text without a colon is a number of seconds; null if malformed."""
    t = _given(x)
    parts = F.split(t, ":")
    ok = t.rlike(r"^\s*[+-]?\d+\s*(:\s*[+-]?\d+\s*){1,2}$")
    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, v: a * 60 + F.trim(v).try_cast("bigint"))
    return F.when(t.contains(":"), F.when(ok, total)).otherwise(parse_int(t))


def elapsed_seconds(period: Column, clock: Column, period_seconds: int = 300) -> Column:
    """Seconds since the start, from the period's number and its clock."""
    return F.greatest(F.lit(0).cast("bigint"), (period - 1) * period_seconds + clock_seconds(clock))


def id_from_url(url: Column) -> Column:
    """Last path segment of a cleaned URL."""
    return F.element_at(F.split(F.regexp_replace(clean_text(url), r"/+$", ""), "/"), -1)


def url_slug(url: Column) -> Column:
    """Readable, collision-safe file name of a URL: up to 80 of its letters and digits, and 16 digits of its SHA-1."""
    safe = F.regexp_replace(F.regexp_replace(url, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", "")
    return F.concat(F.substring(safe, 1, 80), F.lit("_"), F.substring(F.sha1(url.cast("binary")), 1, 16), F.lit(".html"))


def with_scheme(url: Column) -> Column:
    return F.when(url.rlike(r"^https?://"), url).otherwise(F.concat(F.lit("http://"), url))


def height_cm(x: Column) -> Column:
    """5' 11" in centimetres, to two places; both feet and inches must be there."""
    part = lambda i: F.regexp_extract(_given(x), r"(\d+)\s*'\s*(\d+)", i).try_cast("double")
    return F.round((part(1) * 12 + part(2)) * 2.54, 2)


def reach_cm(x: Column) -> Column:
    """Inches in centimetres, to two places."""
    return F.round(parse_float(x) * 2.54, 2)


def iso_date(x: Column) -> Column:
    """A real date written as YYYY-MM-DD, else null."""
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(x, "yyyy-MM-dd"))


def age_years(birth: Column, day: Column, known_age: Column | None = None, known_on: Column | None = None) -> Column:
    """Age in years of 365.25 days, from the day of birth; else from an age known on some day, plus the time since."""
    years = lambda since: F.datediff(day, since) / F.lit(365.25)
    out = years(birth)
    return out if known_age is None else F.coalesce(out, known_age.cast("double") + years(known_on))


def age_columns(age: Column) -> dict[str, Column]:
    """What models take of an age: its square and three flags (over 35, under 25, 26 to 34); null for an unknown age."""
    flag = lambda c: F.when(age.isNotNull(), c.cast("int"))
    return {"age_squared": age * age, "over_35": flag(age > 35), "under_25": flag(age < 25), "prime_26_34": flag((age >= 26) & (age <= 34))}


def layoff_bucket(days: Column) -> Column:
    """Length of a break; null means no earlier contest."""
    out = F.when(days.isNull(), "debut")
    for most, name in ((90, "0_90"), (180, "91_180"), (365, "181_365"), (730, "366_730")):
        out = out.when(days <= most, name)
    return out.otherwise("731_plus")


def age_bucket(age: Column) -> Column:
    out = F.when(age.isNull(), "unknown").when(age < 25, "under_25")
    for most, name in ((34, "25_34"), (39, "35_39")):
        out = out.when(age <= most, name)
    return out.otherwise("40_plus")


def pair_text(a: Column, b: Column, missing: str = "unknown") -> Column:
    """a_vs_b; blank sides are `missing`."""
    side = lambda x: F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit(missing))
    return F.concat(side(a), F.lit("_vs_"), side(b))


def reverse_pair_text(x: Column) -> Column:
    """b_vs_a of a_vs_b; a text without the joint stays as it is."""
    at = F.instr(x, "_vs_")
    return F.when(at > 0, F.concat(F.substr(x, at + 4), F.lit("_vs_"), F.substr(x, F.lit(1), at - 1))).otherwise(x)


#: Result markers by family.
MARKERS = {"W": ("W", "WIN", "WINNER"), "L": ("L", "LOSS", "LOSER", "LOSE", "LOST"), "D": ("D", "DRAW"), "NC": ("NC", "N/C", "N C", "NO CONTEST", "NOCONTEST")}


def outcome_marker(x: Column) -> Column:
    """W, L, D or NC of a result marker; '' for a blank one; any other text in capitals as it is."""
    t = F.upper(clean_text(F.coalesce(x, F.lit(""))))
    words = F.trim(F.regexp_replace(F.translate(t, "_-", "  "), r"\s+", " "))
    out = F.when(t.isin("", "--", "---", "NAN", "NONE", "NULL"), "")
    for family, names in MARKERS.items():
        out = out.when(words.isin(*names), family)
    return out.otherwise(t)


def outcome_of_pair(a: Column, b: Column) -> Column:
    """Contest result from both sides' markers; '' if they don't fit together."""
    both = F.array_join(F.array_sort(F.array(a, b)), "")
    return F.when(both == "LW", "win_loss").when(both == "DD", "draw").when(both == "NCNC", "no_contest").otherwise("")


def contest_result(method: Column, winner: Column) -> Column:
    """draw or no_contest by the method's text; else win_loss with a winner, else unknown."""
    t = F.lower(clean_text(F.coalesce(method, F.lit(""))))
    void = t.contains("no contest") | t.contains("overturned")
    return F.when(t.contains("draw"), "draw").when(void, "no_contest").when(F.coalesce(winner.cast("string"), F.lit("")) != "", "win_loss").otherwise("unknown")


def method_family(x: Column) -> Column:
    """Coarse class of how a contest ended; the order of the tests matters."""
    t = F.upper(F.coalesce(x, F.lit("")))
    return F.when(t.contains("SUB"), "submission").when(t.contains("KO"), "knockout").when(t.contains("DEC"), "decision").otherwise("other")


# What methods are told by, in texts reduced to lower-case words.
DECISION = r"\b(decision|dec|[usm]\s*dec|unanimous|split|majority)\b"
SUBMISSION = r"\b(submission|sub)\b|armbar|choke|triangle|guillotine|kimura|keylock|kneebar|heel hook|twister|d arce|darce|anaconda|rear naked"
KNOCKOUT = r"\b(ko|tko)\b|knockout|doctor stoppage|corner stoppage"
NO_METHOD = r"overturned|no contest|\b(nc|draw)\b"


def method_flags(*parts: Column) -> Column:
    """struct(known, decision, submission, knockout, finish) from several texts. The flags are null for unknown methods, draws and void contests."""
    joined = F.lower(F.array_join(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), " | "))
    t = F.trim(F.regexp_replace(joined, r"[^a-z0-9]+", " "))
    known = (t != "") & ~t.isin("nan", "none", "null")
    flag = lambda c: F.when(known & ~t.rlike(NO_METHOD), c.cast("int"))
    sub, ko = t.rlike(SUBMISSION), t.rlike(KNOCKOUT)
    return F.struct(known.cast("int").alias("known"), flag(t.rlike(DECISION)).alias("decision"), flag(sub).alias("submission"), flag(ko).alias("knockout"), flag(sub | ko).alias("finish"))


def method_class(*parts: Column) -> Column:
    """submission, knockout or decision, the first that the texts say; null for draws, void contests and unknown methods."""
    m = method_flags(*parts)
    return F.when(m["submission"] == 1, "submission").when(m["knockout"] == 1, "knockout").when(m["decision"] == 1, "decision")


def group_key(x: Column, aliases: dict[str, str] | None = None) -> Column:
    """Normalised group name: an alias of the lower-cased text, else each word capitalised; blank is Unknown."""
    t = F.lower(clean_text(x))
    named = F.element_at(F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv]), t) if aliases else F.lit(None).cast("string")
    return F.coalesce(named, F.initcap(F.nullif(t, F.lit(""))), F.lit("Unknown"))


def group_name(x: Column, suffix: str = "Bout", aliases: dict[str, str] | None = None) -> Column:
    """Group name of a contest's title: cleaned, without the suffix word in any case, stated spellings replaced."""
    t = F.regexp_replace(clean_text(F.coalesce(x, F.lit(""))), rf"(?i)\s+{suffix}$", "")
    for old, new in (aliases or {}).items():
        t = F.replace(t, F.lit(old), F.lit(new))
    return t


def names_group(x: Column, *tokens: str) -> Column:
    """True where a group's name holds one of the tokens, in any case; false for a blank name."""
    t = F.lower(clean_text(F.coalesce(x, F.lit(""))))
    out = F.lit(False)
    for token in tokens:
        out = out | t.contains(token)
    return out


def name_key(x: Column) -> Column:
    """Key for equality of names: lower case, Latin accents off, white space collapsed."""
    plain = F.translate(F.lower(x), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return clean_text(F.regexp_replace(plain, r"\p{M}", ""))


def shrink_to_half(p: Column, factor: float) -> Column:
    return F.lit(0.5) + F.lit(factor) * (p - 0.5)


def confidence_tier(p: Column) -> Column:
    top = F.greatest(p, 1 - p)
    out = F.when(p.isNull(), None)
    for least, name in ((0.80, "very_high"), (0.70, "high"), (0.60, "medium"), (0.55, "low")):
        out = out.when(top >= least, name)
    return out.otherwise("toss_up")


def expected_score(a: Column, b: Column) -> Column:
    """Logistic win expectation, base 10 and scale 400."""
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / 400))


def american_to_decimal(odds: Column) -> Column:
    return F.when(odds >= 100, 1 + odds / 100).when(odds <= -100, 1 + 100 / (-odds))


def decimal_odds(text: Column) -> Column:
    """Decimal odds from either notation: signed, or whole numbers of 100 and more, are American. Null if it is neither."""
    t = F.trim(text)
    v = t.try_cast("double")
    american = t.rlike(r"^[+-]") | (F.abs(v) >= 100)
    return F.when(american, american_to_decimal(v)).when(v > 1, v)


def no_vig(a: Column, b: Column) -> tuple[Column, Column]:
    """Market probabilities of both sides from decimal odds, without the bookmaker's margin; null unless both are there."""
    total = 1 / a + 1 / b
    return (1 / a) / total, (1 / b) / total


def edge_label(edge: Column, reliability: Column) -> Column:
    """Reading of model minus market probability, by size and by how reliable the model is here."""
    size = F.abs(edge)
    step = F.when(size < 0.03, "none").when(size < 0.07, "small").when(size < 0.12, "medium").otherwise("large")
    side = F.when(edge > 0, "a").otherwise("b")
    return F.when(edge.isNull(), "no_market").when(step == "none", "aligned").when(reliability == "Low", F.concat(F.lit("unreliable_"), side)).otherwise(F.concat(step, F.lit("_"), side))


def json_safe(x: Column) -> Column:
    """A double without NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def fingerprint(columns: Iterable[str]) -> Column:
    """SHA-256 of the columns as JSON with sorted keys; nulls are written."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def display(value: Column, unit: str, signed: bool = False) -> Column:
    """Text of a value in its unit; N/A for null, NaN and infinities, and for a blank text."""
    if unit == "text":
        return F.coalesce(F.nullif(clean_text(value.cast("string")), F.lit("")), F.lit("N/A"))
    v = json_safe(value.cast("double"))
    plus = "+" if signed else ""
    text = {
        "flag": F.when(v != 0, "Yes").otherwise("No"),
        "percent": F.format_string("%+.1f pp", v * 100) if signed else F.format_string("%.1f%%", v * 100),
        "points": F.format_string("%.1f pp", v * 100),
        "count": F.format_string(f"%{plus}.0f", v),
        "ratio": F.format_string(f"%{plus}.3f", v),
    }.get(unit, F.format_string(f"%{plus}.2f", v))
    return F.when(v.isNull(), "N/A").otherwise(text)


def token_jaccard(a: Column, b: Column) -> Column:
    """Share of common words of two keys."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def inferred_markers(a: Column, b: Column, day: Column, today: Column, known: Column, named: Column | None = None) -> Column:
    """struct(a, b, reason): markers of both sides, where one W and one blank of a past, new contest of two named sides make the blank an L."""
    lone = ((a == "W") & (b == "")) | ((b == "W") & (a == ""))
    none = lambda c: F.coalesce(c, F.lit(False))
    blocked = F.when(~none(named), "missing_name") if named is not None else F.when(F.lit(False), "")
    blocked = blocked.when(day.isNull(), "unknown_day").when(day > today, "future_day").when(none(known), "known_contest")
    reason = F.when(lone, F.coalesce(blocked, F.lit("blank_beside_win")))
    reason = reason.when(((a == "W") & (b == "L")) | ((a == "L") & (b == "W")), "complete").when((a == "") & (b == ""), "both_blank")
    reason = reason.when(a.isin("D", "NC") | b.isin("D", "NC"), "draw_or_void").otherwise("ambiguous")
    filled = lambda x: F.when((reason == "blank_beside_win") & (x == ""), "L").otherwise(x)
    return F.struct(filled(a).alias("a"), filled(b).alias("b"), reason.alias("reason"))


def periods_in_text(x: Column) -> Column:
    """3 or 5 where a text names so many periods ('5 Rnd', 'rounds 3', '3'), else null."""
    t = F.lower(F.trim(x))
    first = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    return F.coalesce(first(r"\b([35])\s*(?:rnd|rounds|round)\b"), first(r"\b(?:rnd|rounds|round)\s*([35])\b"), F.when(t.isin("3", "5"), t)).cast("int")


def planned_periods(*texts: Column, numbers: Iterable[Column] = (), seconds: Column | None = None) -> Column:
    """Planned number of periods: the first number column that has one, then the first text that names it, then 5 for more than 900 seconds; else null."""
    found = [n.try_cast("double").cast("int") for n in numbers] + [periods_in_text(t) for t in texts]
    found += [F.when(seconds > 900, 5)] if seconds is not None else []
    return F.coalesce(*found, F.lit(None).cast("int"))


def last_period(seconds: Column, *known: Column, period_seconds: int = 300) -> Column:
    """Period in which a contest ended: the first that is known, else from its whole length."""
    return F.coalesce(*[k.try_cast("double").cast("int") for k in known], F.when(seconds > 0, F.ceil(seconds / period_seconds).cast("int")))


def period_flags(planned: Column, last: Column) -> dict[str, Column]:
    """planned_five and reached_late (the fourth period or later) as 1 or 0; null where unknown."""
    return {"planned_five": (planned >= 5).cast("int"), "reached_late": (last >= 4).cast("int")}
