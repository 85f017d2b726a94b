"""Meaning of columns: statistics of their values and the roles that follow."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.amounts import is_amount_like, numeral
from ..functions.dates import is_date_like

STATS = ("date_rate", "amount_rate", "empty_rate", "text_rate", "mean_length", "unique_ratio", "monotonic_score")
AMOUNT_ROLES = ("DEBIT", "CREDIT", "SINGLE_AMOUNT", "BALANCE")


def turned(values: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """``values`` with d__, the difference to the last readable value before, and turn__, whether its sign differs
    from the last difference's. Rows without a readable value have neither."""
    number = numeral(F.regexp_replace(F.col(value), r"[£$€,\s]", ""), "double")
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = values.withColumn("v__", number)
    rows = rows.withColumn("d__", F.col("v__") - F.last("v__", ignorenulls=True).over(before))
    return rows.withColumn("turn__", F.col("d__") * F.last("d__", ignorenulls=True).over(before) < 0)


def turn_score() -> Column:
    diffs = F.count("d__")
    return F.round(F.when(diffs >= 3, 1 - F.count_if("turn__") / diffs).otherwise(0.0), 6)


def sign_change_score(values: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """1 - the share of differences whose sign differs from the one before, from four readable values on; else 0."""
    return turned(values, keys, order, value).groupBy(*keys).agg(turn_score().alias("monotonic_score"))


def column_stats(values: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "value") -> DataFrame:
    """Rates of dates, amounts, texts and blanks, mean length, distinctness and turns of each column's values.

    Rates are over the values that aren't empty, but for empty_rate. Windows and the aggregate share one
    partitioning by ``keys``.
    """
    v = F.col(value)
    full = v != ""
    n = F.greatest(F.count_if(full), F.lit(1))
    rate = lambda c: F.round(F.count_if(full & c) / n, 6)
    return turned(values, keys, order, value).groupBy(*keys).agg(
        rate(is_date_like(v)).alias("date_rate"),
        rate(is_amount_like(v)).alias("amount_rate"),
        F.round(F.count_if(~full) / F.count("*"), 6).alias("empty_rate"),
        rate(v.rlike(r"^[a-zA-Z\s\-\.]+$") & (F.length(v) > 3)).alias("text_rate"),
        F.round(F.coalesce(F.avg(F.when(full, F.length(v))), F.lit(0.0)), 6).alias("mean_length"),
        F.round(F.count_distinct(F.when(full, v)) / n, 6).alias("unique_ratio"),
        turn_score().alias("monotonic_score"),
    )


def decided(columns: list[dict]) -> list[str]:
    """Roles of one document's columns, given in order with header_role (or None), statistics and edges.

    Headers come first; columns without one are judged by their statistics in turn, each seeing the roles given
    before; then a missing date and description are taken from what is left.
    """
    roles: list[str] = []
    for c in columns:
        role = c["header_role"]
        roles.append("VALUE_DATE" if role == "DATE" and "DATE" in roles else role)
    for i, c in enumerate(columns):
        if roles[i] is not None:
            continue
        if c["date_rate"] > 0.5 and "DATE" not in roles:
            role = "DATE"
        elif c["date_rate"] > 0.3:
            role = "VALUE_DATE"
        elif c["amount_rate"] > 0.3:
            if c["empty_rate"] > 0.3:
                role = "DEBIT" if "DEBIT" not in roles else "CREDIT" if "CREDIT" not in roles else "SINGLE_AMOUNT"
            else:
                role = "BALANCE" if c["monotonic_score"] > 0.6 else "SINGLE_AMOUNT"
        elif c["text_rate"] > 0.4 and c["mean_length"] > 8:
            role = "DESCRIPTION"
        elif c["unique_ratio"] > 0.7 and c["mean_length"] < 12:
            role = "REFERENCE"
        else:
            role = "UNKNOWN"
        roles[i] = role
    left = lambda: [i for i, r in enumerate(roles) if r == "UNKNOWN"]
    if "DATE" not in roles and left():
        roles[min(left(), key=lambda i: columns[i]["x_start"])] = "DATE"
    if "DESCRIPTION" not in roles and left():
        roles[max(left(), key=lambda i: (columns[i]["x_end"] - columns[i]["x_start"], -i))] = "DESCRIPTION"
    after = max((c["x_end"] for c, r in zip(columns, roles, strict=True) if r == "DATE"), default=None)
    before = min((c["x_start"] for c, r in zip(columns, roles, strict=True) if r in AMOUNT_ROLES), default=None)
    if after is not None and before is not None:
        for i in left():
            if after <= (columns[i]["x_start"] + columns[i]["x_end"]) / 2 <= before:
                roles[i] = "DESCRIPTION"
    return roles


def assign_roles(stats: DataFrame, doc: str = "doc_id", index: str = "column_index") -> DataFrame:
    """Role of each column; ``stats`` has header_role, the statistics, x_start and x_end.

    A role depends on those given before, so a document's dozen of column rows is folded at once.
    """
    kind = dict(stats.dtypes)[doc]
    fields = ["header_role", *STATS, "x_start", "x_end"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for d, columns in zip(batch[doc], batch["columns"], strict=True):
                columns = sorted(({k: c[k] for k in (index, *fields)} for c in columns), key=lambda c: c[index])
                out += [(d, c[index], r) for c, r in zip(columns, decided(columns), strict=True)]
            yield pd.DataFrame(out, columns=[doc, index, "role"])

    packed = stats.groupBy(doc).agg(F.collect_list(F.struct(index, *fields)).alias("columns"))
    return packed.mapInPandas(run, f"{doc} {kind}, {index} int, role string")
