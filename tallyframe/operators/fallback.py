"""Ready-made tables as a fallback: headers, rows and the order of engines.

Engines are tried in the order 0 to 4 (plain tables, then two readers with two methods each), and a document keeps the
rows of the first that finds any. The three readers differ in where a header may stand, in how dates carry over, and in
which rows they skip.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from ..functions.amounts import parse_amount
from ..functions.dates import parse_date

# Reader of each engine; confidence of amounts and dates, and of directions, by reader.
READERS = (0, 1, 1, 2, 2)
AMOUNT_SURE, DIRECTION_SURE = (0.80, 0.82, 0.75), (0.90, 0.90, 0.85)
# Words of which a header of reader 2 holds one, beside "date".
HEADER_MARKS = ("description", "paid in", "withdrawn", "balance", "money in", "money out", "debit", "credit", "amount")
NO_DATE, NO_DIRECTION = 0.30, 0.40
DESCRIPTION_LENGTH = 500
MONEY = "decimal(15,2)"


def by_reader(values: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("reader__") + 1)


def is_header(roles: Column) -> Column:
    """Whether roles hold a date and an amount that isn't the balance."""
    return F.array_contains(roles, "date") & F.exists(roles, lambda r: r.isin("paid_in", "withdrawn", "amount"))


def cell_of(role: str) -> Column:
    """The row's cell below the header's first column of a role, empty if there is none."""
    at = F.array_position(F.transform("roles", lambda r: F.coalesce(r, F.lit(""))), role)
    return F.coalesce(F.when(at > 0, F.try_element_at("texts__", at.cast("int"))), F.lit(""))


def amounts() -> Column:
    """(role, amount) of the row's amount columns that hold a numeral, in the order of the columns."""
    parsed = F.zip_with("roles", "texts__", lambda r, c: F.when(r.isin("paid_in", "withdrawn", "amount", "balance") & (c != ""), F.struct(r.alias("role"), parse_amount(c)["amount"].alias("amount"))))
    return F.filter(parsed, lambda x: x["amount"].isNotNull())


def extract(tables: DataFrame, as_of: date, doc: str = "doc_id", table: str = "table", row: str = "row") -> DataFrame:
    """Transactions of each document from the first engine that finds any.

    ``tables`` has doc, engine (0 to 4), table, row and cells (array of strings). Readers 0 and 1 take a table's first
    row as its header, or its second one in a table of more than two rows; reader 2 takes the first row of the document
    that holds "date" and another header word and makes a header, which holds for all later tables. Without a header
    there are no rows. A date carries over empty cells within a table (reader 0), over unreadable ones too (reader 1) or
    not at all (reader 2). Readers 1 and 2 skip rows with a marker word before they read a date.

    The last "in" or "out" column that holds an amount decides; a plain amount counts if there is none, and its sign
    gives the direction. Rows without an amount and summaries, by description or by the whole row, are dropped.
    Null cells are empty. Windows share one partitioning by document, engine and table (reader 2: all tables).
    """
    reader = F.element_at(F.array(*[F.lit(r) for r in READERS]), F.col("engine") + 1)
    rows = tables.withColumn("reader__", reader)
    rows = rows.withColumns({"scope__": F.when(F.col("reader__") < 2, F.col(table)).otherwise(-1), "texts__": F.transform("cells", lambda c: F.coalesce(F.trim(c), F.lit("")))})
    rows = rows.withColumn("whole__", F.array_join("texts__", " "))
    scope = Window.partitionBy(doc, "engine", "scope__")
    w = scope.orderBy(table, row)
    low = F.lower("whole__")
    marks = low.contains("date") & reduce(lambda a, b: a | b, [low.contains(m) for m in HEADER_MARKS])
    rows = rows.withColumns({"at__": F.row_number().over(w), "n__": F.count("*").over(scope)})
    early = ((F.col("at__") == 1) & (F.col("n__") > 1)) | ((F.col("at__") == 2) & (F.col("n__") > 2))
    wide = (F.col("reader__") == 0) | (F.size("texts__") > 1)
    # Only rows that may be headers are mapped.
    rows = rows.withColumn("own__", F.when(F.when(F.col("reader__") == 2, marks).otherwise(early & wide), rules.table_roles(F.col("texts__"))))
    rows = rows.withColumn("ok__", F.coalesce(is_header(F.col("own__")), F.lit(False)))
    rows = rows.withColumns({"header__": F.min(F.when(F.col("ok__"), F.col("at__"))).over(scope), "roles": F.first(F.when(F.col("ok__"), F.col("own__")), ignorenulls=True).over(w)})
    rows = rows.where(F.col("at__") > F.col("header__"))
    rows = rows.where((F.col("reader__") == 0) | ~rules.is_marker_word(F.col("whole__")))
    rows = rows.withColumn("raw__", cell_of("date"))
    rows = rows.withColumn("day__", F.when(F.col("raw__") != "", parse_date(F.col("raw__"), as_of)["parsed_date"]))
    carried = F.last("day__", ignorenulls=True).over(w)
    rows = rows.withColumn("tx_date", F.when((F.col("reader__") == 1) | ((F.col("reader__") == 0) & (F.col("raw__") == "")), carried).otherwise(F.col("day__")))
    text = F.substring(cell_of("description"), 1, DESCRIPTION_LENGTH)
    rows = rows.withColumns({"description": F.when(F.col("reader__") == 0, text).otherwise(F.regexp_replace(text, "\n", " ")), "found__": amounts()})
    of = lambda *names: F.filter("found__", lambda x: x["role"].isin(*names))
    side, plain = F.try_element_at(of("paid_in", "withdrawn"), F.lit(-1)), F.try_element_at(of("amount"), F.lit(1))["amount"]
    rows = rows.withColumns({"side__": side, "plain__": plain, "balance": F.try_element_at(of("balance"), F.lit(-1))["amount"].cast(MONEY)})
    direction = F.when(F.col("side__.role") == "paid_in", "CREDIT").when(F.col("side__.role") == "withdrawn", "DEBIT").when(F.col("plain__") < 0, "DEBIT").when(F.col("plain__") > 0, "CREDIT").otherwise("UNKNOWN")
    rows = rows.withColumns({"direction": direction, "amount": F.abs(F.coalesce("side__.amount", "plain__")).cast(MONEY)})
    rows = rows.where(F.col("amount").isNotNull() & ~rules.is_summary_row(F.col("description")) & ~rules.is_summary_row(F.col("whole__")))
    sure = by_reader(AMOUNT_SURE)
    rows = rows.withColumns(
        {
            "confidence_amount": sure,
            "confidence_date": F.when(F.col("tx_date").isNull(), NO_DATE).otherwise(sure),
            "confidence_direction": F.when(F.col("direction") == "UNKNOWN", NO_DIRECTION).otherwise(by_reader(DIRECTION_SURE)),
        }
    )
    rows = rows.withColumn("first__", F.min("engine").over(Window.partitionBy(doc))).where("engine = first__")
    return rows.drop("reader__", "scope__", "texts__", "own__", "whole__", "at__", "n__", "ok__", "header__", "roles", "cells", "raw__", "day__", "found__", "side__", "plain__", "first__")
