"""Known answers of the parsers and rules."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import amounts, dates, rules

AMOUNTS = [
    ("1234.56", "1234.56", False, None),
    ("1,234.56", "1234.56", False, None),
    ("£500.00", "500.00", False, None),
    ("(500.00)", "-500.00", True, "PARENTHESES"),
    ("100.00 DR", "-100.00", True, "DR_CR"),
    ("250.00 CR", "250.00", False, "DR_CR"),
    ("-75.50", "-75.50", True, "MINUS"),
    ("75.50-", "-75.50", True, "MINUS"),
    ("0.00", "0.00", False, None),
    ("500", "500", False, None),
    ("", None, False, None),
    ("-", None, False, None),
    (None, None, False, None),
    ("1,234,567.89", "1234567.89", False, None),
    ("0.01", "0.01", False, None),
    ("(-5.00)", "5.00", True, "PARENTHESES"),
    ("-5.00 DR", "5.00", True, "DR_CR"),
    ("(100.00) DR", None, False, None),
    ("1e3", None, False, None),
    ("nan", None, False, None),
    ("1_000", None, False, None),
]


def one(spark, values, column, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["out"] for r in rows.select("i", column(F.col("v")).alias("out")).orderBy("i").collect()]


def test_parse_amount(spark):
    got = one(spark, [a[0] for a in AMOUNTS], amounts.parse_amount)
    for (raw, value, negative, convention), r in zip(AMOUNTS, got, strict=True):
        assert r["amount"] == (None if value is None else Decimal(value)), raw
        assert (r["is_negative"], r["sign_convention"]) == (negative, convention), raw
        assert (r["confidence"] == 0) == (value is None)


def test_amount_confidence(spark):
    got = one(spark, ["5.00", "-5.00", "0.00", "12,000,000.00"], amounts.parse_amount)
    assert [r["confidence"] for r in got] == [0.95, 0.90, 0.80, 0.5]


def test_amount_like(spark):
    got = one(spark, ["1234.56", "£500", "100.00 DR", "(500.00)", "hello world", "", None, "nan"], amounts.is_amount_like)
    assert got == [True, True, True, True, False, False, False, False]


DATES = [
    ("01/02/2024", date(2024, 2, 1), "DD/MM/YYYY", True),
    ("15 Jan 2024", date(2024, 1, 15), "DD_MON_YYYY", False),
    ("5 February 2024", date(2024, 2, 5), "DD_MONTH_YYYY", False),
    ("2024-03-15", date(2024, 3, 15), "YYYY-MM-DD", False),
    ("01/02/24", date(2024, 2, 1), "DD/MM/YY", True),
    ("1st Jan 2024", date(2024, 1, 1), "DD_ORD_MON_YYYY", False),
    ("05/06/2024", date(2024, 6, 5), "DD/MM/YYYY", True),
    ("25/06/2024", date(2024, 6, 25), "DD/MM/YYYY", False),
    ("5/6/2024", date(2024, 6, 5), "D/M/YYYY", False),
    ("not a date", None, "UNKNOWN", False),
    ("", None, "UNKNOWN", False),
    (None, None, "UNKNOWN", False),
    ("32/01/2024", None, "UNKNOWN", False),
    ("25JUN20", date(2020, 6, 25), "DDMONYY", False),
    ("25JUN", date(2024, 6, 25), "DDMON", False),
    ("07 May", date(2024, 5, 7), "DD_MON", False),
    ("12 May 14:30", date(2014, 5, 12), "DD_MON_YY", False),
    ("01/02/51", date(1951, 2, 1), "DD/MM/YY", True),
    ("01 Feb 51", date(2051, 2, 1), "DD_MON_YY", False),
]


def test_parse_date(spark):
    got = one(spark, [d[0] for d in DATES], lambda c: dates.parse_date(c, date(2024, 6, 1)))
    for (raw, day, name, unclear), r in zip(DATES, got, strict=True):
        assert (r["parsed_date"], r["format_detected"], r["is_ambiguous"]) == (day, name, unclear), raw


def test_date_in_period(spark):
    start, end = F.lit(date(2023, 12, 1)), F.lit(date(2023, 12, 31))
    got = one(spark, ["05/12/2023", "07 Jan", "07 Dec", "02/01"], lambda c: dates.parse_date(c, date(2024, 6, 1), start, end))
    assert [r["parsed_date"] for r in got] == [date(2023, 12, 5), date(2024, 1, 7), date(2023, 12, 7), date(2024, 1, 2)]
    assert not got[0]["is_ambiguous"]


def test_date_like(spark):
    got = one(spark, ["01/02/2024", "15 Jan 2024", "2024-01-15", "on 3/4/24", "hello world", ""], dates.is_date_like)
    assert got == [True, True, True, True, False, False]


@pytest.mark.parametrize(
    ("header", "role"),
    [("Date", "DATE"), ("Value date", "VALUE_DATE"), ("Money out (£)", "DEBIT"), ("Paid in", "CREDIT"), ("(GBP) Amount", "SINGLE_AMOUNT"), ("Withdrawn", "DEBIT"), ("", None), (None, None), ("Nothing", None)],
)
def test_header_role(spark, header, role):
    assert one(spark, [header], rules.header_role) == [role]


def test_rules(spark):
    assert one(spark, ["Balance brought forward", "B/F", "Statement continued", "Tesco", None], rules.is_balance_marker) == [True, True, True, False, False]
    assert one(spark, ["Sort code 1", "Page 1 of 3", "Tesco", ""], rules.is_summary_row) == [True, True, False, False]
    assert one(spark, ["Live at sw1a1aa.", "none", None], rules.postcode) == ["SW1A 1AA", None, None]
    assert [r["doc_family"] for r in one(spark, ["hire purchase balloon payment", "current account sort code overdraft", "hp sauce", None], rules.document_family)] == ["MOTOR_FINANCE", "BANK_STATEMENT", "UNKNOWN", "UNKNOWN"]
    assert [r["provider"] for r in one(spark, ["HSBC UK and Barclays", "nobody"], rules.provider)] == ["HSBC", None]
