"""Rule dictionaries as Column expressions: row kinds, header roles, families, providers, postcodes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .amounts import stripped


def any_of(c: Column, patterns: Sequence[str]) -> Column:
    """Whether one of the patterns is in the text: one alternation, so that a text is walked once."""
    return F.coalesce(c.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def is_balance_marker(text: Column) -> Column:
    return any_of(stripped(F.lower(text)), fixed.BALANCE_MARKERS)


def is_summary_row(text: Column) -> Column:
    return any_of(stripped(F.lower(text)), (*fixed.BALANCE_MARKERS, *fixed.SUMMARY_ROWS))


def is_marker_word(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, [low.contains(w) for w in ("brought forward", "carried forward", "b/f", "c/f")])


def bare_header(text: Column) -> Column:
    """Lower-cased header without currency codes in parentheses and currency signs."""
    h = stripped(F.lower(F.coalesce(text, F.lit(""))))
    h = stripped(F.regexp_replace(h, r"\([a-z]{3}\)\s*", ""))
    return stripped(F.regexp_replace(h, r"[£$€]\s*", ""))


def holds(h: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [h.contains(w) for w in words])


def header_role(text: Column) -> Column:
    """A header's role, null for none; the first rule that fits decides."""
    h = bare_header(text)
    role = F.when(h == "", F.lit(None).cast("string"))
    role = role.when(h.contains("value") & h.contains("date"), "VALUE_DATE")
    role = role.when(holds(h, ("paid out", "money out")), "DEBIT").when(holds(h, ("paid in", "money in")), "CREDIT")
    for name, words in fixed.HEADER_ROLES:
        role = role.when(holds(h, words), name)
    return role


def table_roles(headers: Column) -> Column:
    """Roles of a table's headers (array of strings): only the first date and description count as such.

    A later header of theirs falls through to the amounts. Blank headers and unknown ones are null.
    """

    def step(acc: Column, h: Column) -> Column:
        role = F.when(h == "", F.lit(None).cast("string"))
        for name, words in fixed.TABLE_ROLES:
            free = ~F.array_contains(acc, name) if name in ("date", "description") else F.lit(True)
            role = role.when(holds(h, words) & free, name)
        return F.concat(acc, F.array(F.coalesce(role, F.lit(""))))

    # Bare headers come first, as a lambda's body is computed anew for each of its uses.
    roles = F.aggregate(F.transform(headers, bare_header), F.array().cast("array<string>"), step)
    return F.transform(roles, lambda r: F.nullif(r, F.lit("")))


def header_word_count(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in fixed.HEADER_WORDS])


def pattern_count(text: Column, patterns: Sequence[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a + b, [low.rlike(p).cast("int") for p in patterns])


def pattern_signals(text: Column, patterns: Sequence[str], label: str) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(f"{label}:{p[:30]}")) for p in patterns]))


def document_family(text: Column) -> Column:
    """Struct (doc_family, confidence): the family with the higher score if that is 0.3 at least."""
    score = lambda patterns, w: F.least((pattern_count(text, patterns) * F.lit(w)), F.lit(1.0))
    motor, bank = score(fixed.MOTOR_WORDS, 0.15), score(fixed.BANK_WORDS, 0.12)
    family = F.when((bank > motor) & (bank >= 0.3), "BANK_STATEMENT").when((motor > bank) & (motor >= 0.3), "MOTOR_FINANCE").otherwise("UNKNOWN")
    return F.struct(family.alias("doc_family"), F.round(F.greatest(motor, bank), 6).alias("confidence"))


def provider(text: Column) -> Column:
    """Struct (provider, confidence): the provider with most patterns, the first of equals; null without any."""
    scored = [
        F.struct(F.least(pattern_count(text, p) * F.lit(0.4), F.lit(1.0)).alias("score"), F.lit(-i).alias("rank"), F.lit(n).alias("name"))
        for i, (n, p) in enumerate(fixed.PROVIDERS)
    ]
    best = F.greatest(*scored)
    return F.struct(F.when(best["score"] > 0, best["name"]).alias("provider"), F.round(best["score"], 6).alias("confidence"))


def page_signals(text: Column) -> Column:
    """Struct (score, confidence, is_start) of a page's top text as the first page of a statement."""
    low = F.lower(F.coalesce(text, F.lit("")))
    strong = sum((any_of(low, p).cast("int") for p in (fixed.PERIOD_SIGNS, fixed.OPENING_SIGNS, fixed.ACCOUNT_SIGNS)), F.lit(0))
    score = strong + F.when(any_of(low, fixed.PAGE_ONE_SIGNS), 0.4).otherwise(0.0)
    return F.struct(score.alias("score"), F.least(score / 2, F.lit(1.0)).alias("confidence"), (score >= 0.8).alias("is_start"))


def postcode(text: Column) -> Column:
    """The first UK postcode in a text, upper-cased, with one space before its last three characters; or null."""
    code = F.upper(F.regexp_extract(F.coalesce(text, F.lit("")), f"(?i){fixed.POSTCODE}", 1))
    bare = F.regexp_replace(code, " ", "")
    spaced = F.when(F.length(bare) >= 5, F.concat(F.substring(bare, F.lit(1), F.length(bare) - 3), F.lit(" "), F.substring(bare, F.length(bare) - 2, F.lit(3)))).otherwise(code)
    return F.when(code != "", spaced)
