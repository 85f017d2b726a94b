"""UK dates: the first format that matches at the start of the text with a valid date wins."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from .amounts import let, stripped
from .fixed import DATE_LIKE, LONG_MONTHS, MONTHS, SHORT_MONTHS

# Formats in the order of trial: name, pattern, may be ambiguous.
FORMATS = (
    ("DD_MONTH_YYYY", rf"(\d{{1,2}})\s+({LONG_MONTHS})\s+(\d{{4}})", False),
    ("DD_MON_YYYY", rf"(\d{{1,2}})\s+({SHORT_MONTHS})\w*\s+(\d{{4}})", False),
    ("DD_MON_YY", rf"(\d{{1,2}})\s+({SHORT_MONTHS})\w*\s+(\d{{2}})", False),
    ("DD_ORD_MON_YYYY", rf"(\d{{1,2}})(?:st|nd|rd|th)?\s+({SHORT_MONTHS})\w*\s+(\d{{2,4}})", False),
    ("DDMONYY", rf"(\d{{1,2}})({SHORT_MONTHS})(\d{{2}})", False),
    ("DDMON", rf"(\d{{1,2}})({SHORT_MONTHS})(?!\w)", True),
    ("YYYY-MM-DD", r"(\d{4})-(\d{2})-(\d{2})", False),
    ("DD/MM/YYYY", r"(\d{2})/(\d{2})/(\d{4})", True),
    ("DD-MM-YYYY", r"(\d{2})-(\d{2})-(\d{4})", True),
    ("DD.MM.YYYY", r"(\d{2})\.(\d{2})\.(\d{4})", True),
    ("D/M/YYYY", r"(\d{1,2})/(\d{1,2})/(\d{4})", True),
    ("DD/MM/YY", r"(\d{2})/(\d{2})/(\d{2})", True),
    ("DD_MON", rf"(\d{{1,2}})\s+({SHORT_MONTHS})\w*", True),
    ("DD/MM", r"(\d{1,2})/(\d{1,2})", True),
)
#: Days after a period's end that still count as in it.
GRACE_DAYS = 5


def month_number(name: Column) -> Column:
    low = F.lower(F.substring(name, 1, 3))
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), low).cast("int")


def short_year(y: Column, named: bool, as_of: int) -> Column:
    """The year of two digits: above 50 is 19yy for numeric formats; within 50 years of ``as_of`` for named months."""
    if not named:
        return F.when(y > 50, 1900 + y).otherwise(2000 + y)
    near = y + as_of // 100 * 100
    return F.when(near >= as_of + 50, near - 100).when(near < as_of - 50, near + 100).otherwise(near)


def calendar(y: Column, m: Column, d: Column) -> Column:
    """A date or null; invalid days don't raise."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")


def parse_date(raw: Column, as_of: date, start: Column | None = None, end: Column | None = None) -> Column:
    """Struct (parsed_date, format_detected, confidence, is_ambiguous) of a raw date.

    ``start`` and ``end`` bound the statement's period: they give years that the text lacks and settle which of
    day and month comes first. ``as_of`` stands for today. Text after the date is ignored.
    """
    none = F.lit(None).cast("date")
    start, end = (none if x is None else x for x in (start, end))
    return let(stripped(F.coalesce(raw, F.lit(""))), lambda text: let(first_match(text, as_of, start, end), lambda found: described(found, as_of)))


def first_match(text: Column, as_of: date, start: Column, end: Column) -> Column:
    """The first format's struct (parsed_date, format_detected, is_ambiguous), or null."""
    return F.coalesce(*[candidate(text, name, pattern, maybe, as_of, start, end) for name, pattern, maybe in FORMATS])


def candidate(text: Column, name: str, pattern: str, maybe: bool, as_of: date, start: Column, end: Column) -> Column:
    pattern, named = f"(?i)^{pattern}", "MON" in name
    groups = 2 if name in ("DDMON", "DD_MON", "DD/MM") else 3
    g = [F.regexp_extract(text, pattern, i).try_cast("int") for i in range(1, groups + 1)]
    month = month_number(F.regexp_extract(text, pattern, 2)) if named else g[1]
    if name == "YYYY-MM-DD":
        value = calendar(g[0], g[1], g[2])
    elif name in ("DDMON", "DD_MON"):
        year = F.coalesce(F.year(start), F.year(end), F.lit(as_of.year)) + F.when((F.month(start) >= 11) & (month <= 2), 1).otherwise(0)
        value = calendar(year, month, g[0])
    elif name == "DD/MM":
        year = F.coalesce(F.year(start), F.lit(as_of.year)) + F.when((F.month(start) == 12) & (month == 1), 1).otherwise(0)
        value = calendar(year, month, g[0])
    else:
        digits = F.length(F.regexp_extract(text, pattern, 3))
        year = F.when(digits >= 3, g[2]).otherwise(short_year(g[2], named and name != "DDMONYY", as_of.year))
        value = calendar(year, month, g[0])

    def judged(v: Column) -> Column:
        unclear = F.lit(False)
        if maybe and name.startswith("DD") and not named:
            inside = F.coalesce((v >= start) & (v <= F.date_add(end, GRACE_DAYS)), F.lit(False))
            unclear = F.coalesce((g[0] <= 12) & (g[1] <= 12) & (g[0] != g[1]) & ~inside, F.lit(False))
        return F.when(v.isNotNull(), F.struct(v.alias("parsed_date"), F.lit(name).alias("format_detected"), unclear.alias("is_ambiguous")))

    return F.when(text.rlike(pattern), let(value, judged))


def described(found: Column, as_of: date) -> Column:
    year = F.year(found["parsed_date"])
    confidence = (
        F.when(found.isNull(), 0.0)
        .when(year > as_of.year + 1, 0.3)
        .when(year < 2000, 0.5)
        .when(found["is_ambiguous"], 0.70)
        .otherwise(0.95)
    )
    return F.struct(
        found["parsed_date"].alias("parsed_date"),
        F.coalesce(found["format_detected"], F.lit("UNKNOWN")).alias("format_detected"),
        confidence.alias("confidence"),
        F.coalesce(found["is_ambiguous"], F.lit(False)).alias("is_ambiguous"),
    )


def is_date_like(raw: Column) -> Column:
    """Whether a date stands anywhere in the text."""
    return F.coalesce(stripped(raw).rlike("(?i)" + "|".join(f"(?:{p})" for p in DATE_LIKE)), F.lit(False))
