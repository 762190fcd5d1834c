"""Risk scoring as column expressions: wording, signals, composite, level, categories and hint.

`score` expects clause columns text, char_start, char_end, structural_role and the signals label,
confidence, deviation, agrees (nullable), skipped; it adds one struct column `risk`.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import replaced
from ..settings import DEFAULT, HINTS, LABEL_CATEGORY, LABEL_MULTIPLIER, STRUCTURAL_ROLES, TAG_CATEGORY, Settings


#: What `score` gives.
RISK = ("score", "level", "categories", "hint", "signals")
#: Letters that a pattern without regard to case takes for ASCII ones, beside capitals.
FOLDED = "ſKıİ", "skii"


def folded(text: Column) -> Column:
    return F.lower(F.when(is_ascii(text), text).otherwise(replaced(text, *FOLDED)))


def simple(pattern: str) -> bool:
    """Whether a pattern means the same with and without Unicode's classes and cases, as long as the text is ASCII."""
    return pattern.isascii() and not any(x in pattern for x in ("\\p", "\\P", "\\x", "\\u", "\\N", "\\X", "\\c", "\\0", "(?i", "(?u", "(?U", "(?-"))


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def begins(pattern: str) -> str:
    """The characters that every match of a pattern begins with, as far as they are plain; empty if none are."""
    run, at = "", 0
    while at < len(pattern) and "|" not in pattern:
        c, size = pattern[at], 1
        if c == "\\" and at + 1 < len(pattern) and not pattern[at + 1].isalnum():
            c, size = pattern[at + 1], 2
        elif c in "\\.^$|?*+()[]{}":
            break
        after = pattern[at + size : at + size + 1]
        if after and after in "?*{+":
            least = pattern[at + size + 1 : pattern.find(",", at)] if after == "{" else ""
            return run + c * (int(least) if least.isdecimal() else int(after == "+"))
        run, at = run + c, at + size
    return run


def required(pattern: str, small: bool = True) -> str:
    """The longest run of letters that every match of a pattern holds, in small letters unless told otherwise; empty if none is sure.

    Only what stands outside groups and classes counts, and nothing that a quantifier may leave out.
    """
    runs, run, at = [""], "", 0
    while at < len(pattern):
        c, size = pattern[at], 1
        if c == "|":
            return ""
        if c == "\\":
            size = 2
        elif c in "([":
            size, depth = 0, 0
            while not size or depth:
                x = pattern[at + size]
                depth += x == c
                depth -= x == {"(": ")", "[": "]"}[c]
                size += 2 if x == "\\" else 1
        after = pattern[at + size : at + size + 1]
        letter = c.isascii() and c.isalpha() and after not in ("?", "*", "{")
        run = run + (c.lower() if small else c) if letter else ""
        runs.append(run)
        if after in ("+", "?", "*", "{") and after:
            run = ""
            size += 1 if after != "{" else pattern.index("}", at + size) - at - size + 1
        at += size
    return max(runs, key=len)


def lexicon_hits(text: Column, settings: Settings = DEFAULT, small: Column | None = None, ascii: Column | None = None) -> Column:
    """An array of (weight, tag) for every lexicon entry found in the text, in lexicon order.

    Each pattern is a literal, so that it is compiled once; the flags make classes and dots match
    as Unicode text and case never matters. With `small`, the `folded` text, a pattern is tried
    only where the letters stand that all its matches hold; with `ascii`, whether the text is ASCII,
    such texts are spared Unicode's classes, which cost most of the time.
    """

    def met(pattern: str) -> Column:
        whole, least = F.rlike(text, F.lit(f"(?iuUd){pattern}")), required(pattern)
        if ascii is not None and simple(pattern):
            whole = F.when(ascii, F.rlike(text, F.lit(f"(?id){pattern}"))).otherwise(whole)
        return F.contains(small, F.lit(least)) & whole if small is not None and least else whole

    # joined arrays of one or none: functions that take functions, as array_compact, keep all below them from being compiled
    none = F.array().cast("array<struct<weight:double,tag:string>>")
    found = F.concat(none, *(F.when(met(p), F.array(F.struct(F.lit(float(w)).alias("weight"), F.lit(tag).alias("tag")))).otherwise(none) for p, w, tag in settings.lexicon))
    if settings.lexicon_dedupe_tags:
        best = lambda tag: F.array_max(F.transform(F.filter(found, lambda h: h["tag"] == tag), lambda h: h["weight"]))
        found = F.transform(F.array_distinct(F.transform(found, lambda h: h["tag"])), lambda t: F.struct(best(t).alias("weight"), t.alias("tag")))
    return found


def with_hits(clauses: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """`clauses` with a column `hits`, which others may mention often: its patterns run once a clause."""
    rows = clauses.withColumns({"_small": folded(F.col("text")), "_ascii": is_ascii(F.col("text"))})
    return rows.select(*clauses.columns, F.explode(F.array(lexicon_hits(F.col("text"), settings, F.col("_small"), F.col("_ascii")))).alias("hits"))


def language_score(hits: Column) -> Column:
    """The largest weight and two fifths of all others, at most 1."""
    weights = F.sort_array(hits["weight"], asc=False)
    rest = F.aggregate(F.slice(weights, 2, F.greatest(F.size(weights), F.lit(1))), F.lit(0.0), lambda a, w: a + w)
    return F.when(F.size(hits) == 0, 0.0).otherwise(F.least(F.lit(1.0), weights[0] + 0.4 * rest))


def language_tags(hits: Column) -> Column:
    return F.array_distinct(hits["tag"])


def is_placeholder(text: Column, settings: Settings = DEFAULT) -> Column:
    """Whether unfilled parts make up over 15 % of the text, or are two or more."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(f"(?U){p}"), 0) for p in settings.placeholders])
    chars = F.aggregate(found, F.lit(0), lambda a, x: a + F.length(x))
    many = (chars / F.greatest(F.length(text), F.lit(1)) > 0.15) | (F.size(found) >= 2)
    # what a match begins with is looked for first: most texts have none
    tried = [F.contains(text, F.lit(begins(p))) & F.rlike(text, F.lit(f"(?U){p}")) if begins(p) else F.rlike(text, F.lit(f"(?U){p}")) for p in settings.placeholders]
    return F.when(reduce(or_, tried, F.lit(False)), F.coalesce(many, F.lit(False))).otherwise(False)


def short_penalty(length: Column) -> Column:
    return F.when(length < 50, 0.5).when(length < 100, 0.5 * (1 - (length - 50) / 50.0)).otherwise(0.0)


def multiplier(label: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LABEL_MULTIPLIER.items() for x in kv])
    return F.coalesce(known[label], F.lit(1.0))


def level_of(score: Column, settings: Settings = DEFAULT) -> Column:
    return F.when(score >= settings.high, "high").when(score >= settings.medium, "medium").otherwise("low")


def categories_of(label: Column, level: Column, tags: Column, ambiguous: Column, settings: Settings = DEFAULT) -> Column:
    """Categories in order of first mention: the label's from medium on, the tags', ambiguity."""
    none = F.array().cast("array<string>")
    named = [F.when((level != "low") & label.isin(*labels), F.array(F.lit(c))).otherwise(none) for c, labels in LABEL_CATEGORY.items()]
    table = F.create_map(*[F.lit(x) for kv in TAG_CATEGORY.items() for x in kv])
    counts = F.size(tags) > 0 if settings.tag_categories_at_low else (F.size(tags) > 0) & (level != "low")
    tagged = F.when(counts, F.array_compact(F.transform(tags, lambda t: table[t]))).otherwise(none)
    own = F.array_distinct(F.concat(*named, tagged, F.when(ambiguous, F.array(F.lit("Ambiguity"))).otherwise(none)))
    return F.when(label.isNotNull() & (label != ""), own).otherwise(none)


def percent(x: Column) -> Column:
    """A share as whole per cent, halves to even."""
    whole = F.bround(x * 100, 0)
    # a format is read anew for every row; whole numbers that a long holds are written alike without one
    return F.concat(F.when(F.abs(whole) < 1e15, whole.cast("long").cast("string")).otherwise(F.format_string("%.0f", whole)), F.lit("%"))


def hint_of(label: Column, level: Column, s: dict[str, Column]) -> Column:
    """A sentence of the reasons behind a score, joined by dashes."""

    def said(name: str, value: Column | None = None) -> Column:
        before, _, after = HINTS[name].partition("{}")
        return F.lit(before) if value is None else F.concat(F.lit(before), value, F.lit(after))

    form = s["placeholder"]
    raised = ~form & (s["override"] != "")
    floor = ~form & ~raised & s["floor"] & (F.size(s["tags"]) == 0)
    plain = ~form & ~raised & ~floor
    named = label.isNotNull() & (label != "")
    away = percent(s["deviation"])
    parts = [
        F.when(named, said("label", label)).otherwise(said("unlabelled")),
        F.when(level == "high", said("high")).when(level == "medium", said("medium")),
        F.when(F.size(s["tags"]) > 0, said("tags", F.array_join(s["tags"], ", "))),
        F.when(s["override"] != "", said("override", s["override"])),
        F.when(form, said("form")),
        F.when(floor, said("floor", percent(s["confidence"]))),
        F.when((raised | plain) & (s["confidence"] < 0.5), said("unsure", percent(s["confidence"]))),
        F.when(plain & (s["deviation"] > 0.55), said("far", away)).when(plain & (s["deviation"] > 0.35), said("off", away)),
        F.when(plain & (s["mismatch"] > 0), said("mismatch")),
        F.when(plain & (s["short"] > 0), said("short")),
    ]
    return F.array_join(F.array(*parts), HINTS["between"])  # nulls are left out


def score(clauses: DataFrame, settings: Settings = DEFAULT, wanted: tuple[str, ...] = RISK) -> DataFrame:
    """`clauses` with a struct `risk`: score (4 decimals), level, categories, hint, and all signals.

    Of these only those `wanted` are worked out: Spark works out all that a struct holds if two of
    its fields are used.
    """
    w = settings.weights
    total = w["deviation"] + w["uncertainty"] + w["mismatch"] + w["language"]
    c = F.col
    step = clauses.withColumns({"_small": folded(c("text")), "_ascii": is_ascii(c("text"))}).withColumns(
        {
            "_hits": lexicon_hits(c("text"), settings, c("_small"), c("_ascii")),
            "_placeholder": is_placeholder(c("text"), settings),
            "_short": short_penalty(c("char_end") - c("char_start")).cast("double"),
            "_confidence": F.coalesce(c("confidence").cast("double"), F.lit(0.0)),
            "_deviation": F.coalesce(c("deviation").cast("double"), F.lit(0.0)),
            "_mismatch": F.when(c("agrees").eqNullSafe(False), 1.0).otherwise(0.0),
            "_multiplier": multiplier(c("label")),
        }
    )
    step = step.withColumns({"_language": language_score(c("_hits")), "_tags": language_tags(c("_hits")), "_floor": c("_confidence") < settings.min_confidence})
    composite = (
        F.lit(w["deviation"] / total) * c("_deviation")
        + F.lit(w["uncertainty"] / total) * (1.0 - c("_confidence"))
        + F.lit(w["mismatch"] / total) * c("_mismatch")
        + F.lit(w["language"] / total) * c("_language")
    )
    composite = F.when(c("_short") > 0, composite * (1.0 - c("_short"))).otherwise(composite)
    composite = F.when(c("_placeholder"), composite * 0.5).otherwise(composite)
    step = step.withColumn("_composite", composite)
    capped = F.when(c("_floor") & (c("_language") < 0.5), F.least(c("_composite"), F.lit(settings.low - 0.01))).otherwise(c("_composite"))
    step = step.withColumn("_scaled", capped * c("_multiplier"))
    floor = F.when(c("_language") >= settings.override_high, settings.high).when(c("_language") >= settings.override_medium, settings.medium)
    raised = F.coalesce(c("_scaled") < floor, F.lit(False))
    named = F.when(raised & (c("_language") >= settings.override_high), "high").when(raised, "medium").otherwise("")
    step = step.withColumns({"_override": named, "_score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(raised, floor).otherwise(c("_scaled"))))})
    step = step.withColumn("_level", level_of(c("_score"), settings))
    ambiguous = (c("_mismatch") > 0) & ((c("_confidence") < 0.35) | (c("_deviation") > 0.55)) & ~c("_placeholder")
    # a generator of one row: filters on what is worked out stay above it, where pushing them down would
    # write the whole chain of expressions out once for every mention
    names = ["confidence", "deviation", "mismatch", "short", "placeholder", "floor", "multiplier", "language", "tags", "override", "score", "level"]
    ambiguity = ambiguous.alias("ambiguous")
    step = step.select(*clauses.columns, F.explode(F.array(F.struct(*(c(f"_{n}").alias(n) for n in names), ambiguity))).alias("_s"))
    signals = {n: c("_s")[n] for n in names}
    none = F.array().cast("array<string>")
    skipped = F.coalesce(c("skipped"), F.lit(False))

    def either(structural: Column, scored: Column) -> Column:
        return F.when(skipped, structural).otherwise(scored)

    structural = F.concat(*[c("structural_role") if x is None else F.lit(x) for x in (HINTS["structural"].split("{}")[0], None, HINTS["structural"].split("{}")[1])])
    fields = {
        "score": either(F.lit(0.0), F.round(signals["score"], 4)),
        "level": either(F.lit("low"), signals["level"]),
        "categories": either(none, categories_of(c("label"), signals["level"], signals["tags"], c("_s.ambiguous"), settings)),
        "hint": either(structural, hint_of(c("label"), signals["level"], signals)),
        "signals": F.struct(
            either(F.lit(1.0), signals["confidence"]).alias("classifier_confidence"),
            either(F.lit(0.0), signals["deviation"]).alias("deviation_from_reference"),
            either(F.lit(0.0), signals["mismatch"]).alias("classifier_exemplar_mismatch"),
            either(F.lit(0.0), signals["short"]).alias("short_clause_penalty"),
            skipped.alias("structural_skip"),
            either(F.lit(False), signals["placeholder"]).alias("placeholder_clause"),
            either(F.lit(False), signals["floor"]).alias("confidence_floor_hit"),
            either(F.lit(1.0), signals["multiplier"]).alias("label_multiplier"),
            either(F.lit(0.0), signals["language"]).alias("risky_language_score"),
            either(none, signals["tags"]).alias("risky_language_tags"),
            either(F.lit(""), signals["override"]).alias("override_applied"),
        ),
    }
    return step.select(*clauses.columns, F.struct(*(fields[n].alias(n) for n in RISK if n in wanted)).alias("risk"))


def is_structural(role: Column) -> Column:
    return role.isin(*STRUCTURAL_ROLES)
