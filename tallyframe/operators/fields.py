"""Typed fields of a row from its cells and their columns' roles."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import parse_amount
from ..functions.dates import parse_date
from ..functions.rules import header_word_count

# Confidences where a role gives none of its own.
AMOUNT_DEFAULT, DATE_DEFAULT, DIRECTION_DEFAULT = 0.8, 0.8, 0.5
AMOUNT_ROLES = ("DEBIT", "CREDIT", "SINGLE_AMOUNT")
HEADER_SEARCH, HEADER_WORDS = 10, 2
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def row_fields(cells: DataFrame, keys: Sequence[str], as_of: date, index: str = "column_index", role: str = "role", text: str = "text") -> DataFrame:
    """One row per ``keys``: raw and parsed date, amount and balance, direction with its source, and confidences.

    ``cells`` has the first cell of each column. Descriptions are joined in column order; of several readable
    cells of one kind the last counts.
    """
    t, r = F.trim(F.coalesce(F.col(text), F.lit(""))), F.col(role)
    cells = cells.withColumns({"t__": t, "amount__": F.when(r.isin(*AMOUNT_ROLES, "BALANCE"), parse_amount(t)), "date__": F.when(r == "DATE", parse_date(t, as_of))})
    value = F.col("amount__.amount")
    paid = r.isin(*AMOUNT_ROLES) & value.isNotNull()
    direction = F.when(r == "DEBIT", "DEBIT").when(r == "CREDIT", "CREDIT").when(value < 0, "DEBIT").when(value > 0, "CREDIT").otherwise("UNKNOWN")
    source = F.when(r == "DEBIT", "column_debit").when(r == "CREDIT", "column_credit").when(value < 0, "sign_negative").when(value > 0, "sign_positive").otherwise("single_amount_zero")
    sure = F.when(r.isin("DEBIT", "CREDIT") | (value < 0), 0.95).when(value > 0, 0.90).otherwise(0.50)
    chosen = F.struct(F.abs(value).alias("amount"), direction.alias("direction"), source.alias("source"), sure.alias("sure"), F.col("amount__.confidence").alias("confidence"))
    last = lambda value, when: F.max_by(F.when(when, value), F.when(when, F.col(index)))
    text_parts = F.array_sort(F.collect_list(F.when((r == "DESCRIPTION") & (F.col("t__") != ""), F.struct(F.col(index).alias("i"), F.col("t__").alias("t")))))
    rows = cells.groupBy(*keys).agg(
        last(F.col("t__"), r == "DATE").alias("raw_date"),
        last(F.col("date__"), (r == "DATE") & F.col("date__.parsed_date").isNotNull()).alias("d"),
        F.array_join(F.transform(text_parts, lambda x: x["t"]), " ").alias("description"),
        last(chosen, paid).alias("c"),
        last(value, (r == "BALANCE") & value.isNotNull()).alias("parsed_balance"),
    )
    return rows.select(
        *keys,
        F.coalesce("raw_date", F.lit("")).alias("raw_date"),
        F.col("d.parsed_date").alias("parsed_date"),
        F.coalesce("d.confidence", F.lit(DATE_DEFAULT)).alias("date_confidence"),
        "description",
        F.col("c.amount").alias("parsed_amount"),
        F.coalesce("c.confidence", F.lit(AMOUNT_DEFAULT)).alias("amount_confidence"),
        F.coalesce("c.direction", F.lit("UNKNOWN")).alias("direction"),
        F.coalesce("c.source", F.lit("")).alias("direction_source"),
        F.coalesce("c.sure", F.lit(DIRECTION_DEFAULT)).alias("direction_confidence"),
        "parsed_balance",
    )


def with_content(rows: DataFrame, amount: str = "parsed_amount", description: str = "description") -> DataFrame:
    """Rows that have an amount or a description."""
    return rows.where(F.col(amount).isNotNull() | (F.trim(F.coalesce(F.col(description), F.lit(""))) != ""))


def header_lines(lines: DataFrame, doc: str = "doc_id", line: str = "line", text: str = "text") -> DataFrame:
    """The first of each document's first lines with words of a header enough."""
    found = lines.where((F.col(line) < HEADER_SEARCH) & (header_word_count(F.col(text)) >= HEADER_WORDS))
    return found.groupBy(doc).agg(F.min(line).alias("header_line"), F.min_by(text, line).alias("header_text"))


def is_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike(UUID), F.lit(False))


def persisted(amount: Column, confidence: Column) -> Column:
    """Struct (amount, confidence) as stored: pennies and four places, halves to even."""
    return F.struct(F.bround(amount, 2).cast("decimal(15,2)").alias("amount"), F.bround(confidence.cast("decimal(12,8)"), 4).cast("decimal(5,4)").alias("confidence"))
