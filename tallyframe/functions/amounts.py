"""UK amounts: a typed value, its sign convention and a confidence, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(20,6)"
#: Plain numerals only: casts of engines differ on exponents, underscores and words.
NUMERAL = r"^[+-]?(\d+\.?\d*|\.\d+)$"


#: A debit or credit mark after the number.
SUFFIX = r"(?i)\s*(DR|CR|D|C)$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def stripped(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def numeral(c: Column, kind: str = MONEY) -> Column:
    return F.when(c.rlike(NUMERAL), c.try_cast(kind))


def parse_amount(raw: Column) -> Column:
    """Struct (amount, is_negative, sign_convention, confidence) of a raw amount.

    A sign is taken from the parentheses, then from a DR or CR suffix, which overrides them, then from a minus at
    the end or start. Two negative signs cancel in the value, not in the flag. Blank and dash cells and texts that
    aren't numerals have no amount.
    """
    return let(stripped(F.coalesce(raw, F.lit(""))), lambda text: let(stripped(F.regexp_replace(text, "GBP|gbp|EUR|eur|[£₤$€]", "")), lambda bare: from_bare(text, bare)))


def from_bare(text: Column, bare: Column) -> Column:
    wrapped = bare.rlike(r"^\(.*\)$")
    inner = F.when(wrapped, stripped(F.regexp_extract(bare, r"^\((.*)\)$", 1))).otherwise(bare)

    def signed(body: Column) -> Column:
        suffix = F.upper(F.regexp_extract(body, SUFFIX, 1))
        negative = F.when(suffix.isin("DR", "D"), True).when(suffix.isin("CR", "C"), False).otherwise(wrapped)
        parts = F.struct(suffix.alias("suffix"), negative.alias("negative"), stripped(F.regexp_replace(body, SUFFIX, "")).alias("rest"))
        return let(parts, lambda x: unsigned(x["rest"], x["suffix"], x["negative"]))

    def unsigned(rest: Column, suffix: Column, negative: Column) -> Column:
        minus = ~negative & rest.rlike("-$|^[-−]")
        digits = F.when(minus & rest.endswith("-"), F.regexp_replace(rest, "-$", "")).when(minus, F.regexp_replace(rest, "^[-−]", "")).otherwise(rest)
        value = F.when(~text.isin("", "-", "--", "---"), numeral(F.regexp_replace(digits, "[, ]", "")))
        convention = F.when(minus, "MINUS").when(suffix != "", "DR_CR").when(wrapped, "PARENTHESES")
        return let(F.struct(value.alias("v"), (negative | minus).alias("n"), convention.alias("c")), lambda x: judged(x["v"], x["n"], x["c"]))

    return let(inner, signed)


def judged(value: Column, negative: Column, convention: Column) -> Column:
    confidence = (
        F.when(value.isNull(), 0.0)
        .when(value == 0, 0.80)
        .when(F.abs(value) > 10_000_000, 0.5)
        .when(convention.isin("DR_CR", "MINUS"), 0.90)
        .otherwise(0.95)
    )
    known = value.isNotNull()
    return F.struct(
        F.when(negative, -value).otherwise(value).cast(MONEY).alias("amount"),
        F.coalesce(known & negative, F.lit(False)).alias("is_negative"),
        F.when(known, convention).alias("sign_convention"),
        confidence.alias("confidence"),
    )


def is_amount_like(raw: Column) -> Column:
    """Whether a cell reads as an amount, with fewer currency signs allowed than ``parse_amount`` takes."""
    c = stripped(F.coalesce(raw, F.lit("")))
    c = stripped(F.regexp_replace(c, "£|GBP|,", ""))
    c = stripped(F.regexp_replace(c, SUFFIX, ""))
    c = stripped(F.regexp_replace(c, r"^\(|\)$", ""))
    c = F.regexp_replace(F.regexp_replace(c, "^[-−]", ""), "-$", "")
    return F.coalesce(numeral(stripped(c)).isNotNull(), F.lit(False))


def signed_amount(raw: Column) -> Column:
    """Struct (value, strong): the amount of a signed cell, and whether parentheses or DR/CR gave the sign."""
    c = F.regexp_replace(F.coalesce(raw, F.lit("")), "[£, ]", "")
    n = r"(\d+\.?\d*)"
    wrapped, marked = F.regexp_extract(c, rf"^\({n}\)$", 1), F.regexp_extract(c, rf"(?i)^{n}(DR|CR)$", 1)
    mark = F.upper(F.regexp_extract(c, rf"(?i)^{n}(DR|CR)$", 2))
    after, before, plain = F.regexp_extract(c, rf"^{n}-$", 1), F.regexp_extract(c, rf"^[-−]{n}$", 1), F.regexp_extract(c, rf"^{n}$", 1)
    money = lambda x: x.try_cast(MONEY)
    value = (
        F.when(wrapped != "", -money(wrapped))
        .when(marked != "", F.when(mark == "DR", -money(marked)).otherwise(money(marked)))
        .when(after != "", -money(after))
        .when(before != "", -money(before))
        .when(plain != "", money(plain))
    )
    return F.struct(value.cast(MONEY).alias("value"), ((wrapped != "") | (marked != "")).alias("strong"))


#: Signs in a raw cell that speak for signed amounts.
SIGNS = r"[()]|DR|CR|-$|^-"
