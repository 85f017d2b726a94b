"""Ledger queries: filters, pages, counts, exports, latest runs, purges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def filtered(rows: DataFrame, contains: dict[str, str] | None = None, **equal: object) -> DataFrame:
    """Rows that equal every given value and hold every given text whatever its case; None means any.

    A list of values allows any of them.
    """
    for name, value in equal.items():
        if isinstance(value, (list, tuple, set)):
            rows = rows.where(F.col(name).isin(list(value)))
        elif value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    for name, text in (contains or {}).items():
        rows = rows.where(F.col(name).ilike(f"%{text}%"))
    return rows


def page(rows: DataFrame, order: Sequence[Column], offset: int = 0, limit: int = 50, most: int = 200) -> DataFrame:
    """One page of rows in a total order. ``most`` bounds a page's size."""
    if offset < 0 or not 1 <= limit <= most:
        raise ValueError(f"offset must not be negative, limit be 1 to {most}")
    return rows.orderBy(*order).offset(offset).limit(limit)


def blank_if_zero(c: Column) -> Column:
    """A number as text; null and zero are empty."""
    return F.when(c.isNull() | (c == 0), F.lit("")).otherwise(c.cast("string"))


def export_rows(rows: DataFrame) -> DataFrame:
    """The eight columns of a CSV export, all strings."""
    return rows.select(
        F.col("file_name").alias("File"),
        F.coalesce(F.date_format("tx_date", "yyyy-MM-dd"), F.lit("")).alias("Date"),
        F.coalesce(F.nullif(F.col("description"), F.lit("")), F.col("clean_description"), F.lit("")).alias("Description"),
        blank_if_zero(F.col("amount")).alias("Amount"),
        F.coalesce("direction", F.lit("")).alias("Direction"),
        blank_if_zero(F.col("reported")).alias("Balance"),
        F.when(F.col("balance_confirmed"), "Yes").otherwise("No").alias("Confirmed"),
        blank_if_zero(F.round("confidence", 4)).alias("Confidence"),
    )


def signed_rows(rows: DataFrame) -> DataFrame:
    """The columns of a workbook export: typed, with debits negative."""
    return rows.select(
        F.col("file_name").alias("file"),
        "tx_date",
        F.coalesce(F.nullif(F.col("clean_description"), F.lit("")), F.col("description"), F.lit("")).alias("description"),
        F.when(F.col("direction") == "DEBIT", -F.abs("amount")).otherwise(F.col("amount")).alias("signed_amount"),
        "direction",
        F.col("reported").alias("balance"),
    )


def export_name(rows: DataFrame, bank: str, holder: str, postcode: str, stamp: str) -> DataFrame:
    """File name of an export of all rows: bank, first name and postcode of one document, or the banks of up to three."""
    clean = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "_")
    one = F.array_join(F.array_compact(F.array(F.max(bank), F.max(F.split(holder, " ")[0]), F.max(postcode), F.lit(stamp))), "_")
    banks = F.array_sort(F.collect_set(bank))
    many = F.concat(F.when(F.size(banks) <= 3, F.array_join(banks, "_")).otherwise(F.concat(F.count("*").cast("string"), F.lit("docs"))), F.lit("_" + stamp))
    return rows.agg(clean(F.when(F.count("*") == 1, one).otherwise(many)).alias("export_name"))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("n__", F.row_number().over(w)).where("n__ = 1").drop("n__")


def purged(parents: DataFrame, gone: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """What stays of parents and of each table (DataFrame, key column) below them once ``gone`` keys are deleted."""
    kept = {"parents": parents.join(gone.select(key), key, "left_anti")}
    for name, (rows, column) in children.items():
        kept[name] = rows.join(gone.select(F.col(key).alias(column)), column, "left_anti")
    return kept


def nested(documents: DataFrame, segments: DataFrame, rows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Documents with arrays of segments, each with its transactions, in order."""
    tx = [c for c in rows.columns if c not in (doc, "segment_index")]
    inner = rows.groupBy(doc, "segment_index").agg(F.array_sort(F.collect_list(F.struct(*tx))).alias("transactions"))
    whole = segments.join(inner, [doc, "segment_index"], "left")
    parts = ["segment_index", *[c for c in whole.columns if c not in (doc, "segment_index")]]
    packed = whole.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("segments"))
    return documents.join(packed, doc, "left")
