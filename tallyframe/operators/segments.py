"""Pages to statements, texts to families, providers and customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed, rules
from ..functions.amounts import stripped

#: Lines of a text that may hold the customer's address, and lines of an address before its postcode.
HEAD_LINES, ADDRESS_LINES, LONG_LINE = 50, 6, 80


def segment_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page_index", text: str = "top_text") -> DataFrame:
    """``pages`` with score, confidence, is_start and segment_index; a document's first page always starts one."""
    w = Window.partitionBy(doc).orderBy(page)
    found = rules.page_signals(F.col(text))
    first = F.row_number().over(w) == 1
    pages = pages.withColumn("found__", found).withColumn("first__", first)
    start = F.col("first__") | F.col("found__.is_start")
    pages = pages.withColumns(
        {
            "score": F.col("found__.score"),
            "confidence": F.when(F.col("first__"), 1.0).otherwise(F.col("found__.confidence")),
            "is_start": start,
            "segment_index": (F.sum(start.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"),
        }
    )
    return pages.drop("found__", "first__")


def segment_ranges(pages: DataFrame, doc: str = "doc_id", page: str = "page_index") -> DataFrame:
    """One row per segment with its first and last page; a segment ends where the next begins."""
    return pages.groupBy(doc, "segment_index").agg(F.min(page).alias("start_page"), F.max(page).alias("end_page"), F.count("*").alias("n_pages"))


def classify(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with doc_family, family_confidence, provider and provider_confidence."""
    return docs.withColumns({"f__": rules.document_family(F.col(text)), "p__": rules.provider(F.col(text))}).select(
        *docs.columns,
        F.col("f__.doc_family").alias("doc_family"),
        F.col("f__.confidence").alias("family_confidence"),
        F.col("p__.provider").alias("provider"),
        F.col("p__.confidence").alias("provider_confidence"),
    )


def customer(text: Column) -> Column:
    """Struct (name, address, postcode) of the customer a text addresses; nulls where there is none.

    With a postcode in the first lines, the block of lines above it, up to a blank, long or boilerplate line, is
    name and address. Without one, the first line that begins with a title is the name.
    """
    lines = F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, HEAD_LINES), stripped)
    at = F.array_position(F.transform(lines, lambda x: x.rlike(f"(?i){fixed.POSTCODE}")), True).cast("int")
    plain = lambda x: ~x.rlike(f"(?i){fixed.BOILERPLATE}")
    above = F.when(at > 1, F.slice(lines, F.greatest(at - ADDRESS_LINES, F.lit(1)), F.least(at - 1, F.lit(ADDRESS_LINES)))).otherwise(F.array().cast("array<string>"))
    # From the postcode upwards: once a line stops the block, what stands above is dropped.
    block = F.aggregate(
        F.reverse(above),
        F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("stopped")),
        lambda acc, x: F.struct(
            F.when(acc["stopped"] | (x == "") | ~plain(x) | (F.length(x) > LONG_LINE), acc["kept"]).otherwise(F.concat(F.array(x), acc["kept"])).alias("kept"),
            (acc["stopped"] | (x == "") | ~plain(x) | (F.length(x) > LONG_LINE)).alias("stopped"),
        ),
        lambda acc: acc["kept"],
    )
    whole = F.concat(block, F.array(F.element_at(lines, F.greatest(at, F.lit(1)))))
    titled = F.try_element_at(F.filter(lines, lambda x: x.rlike(f"(?i){fixed.TITLES}") & plain(x)), F.lit(1))
    return F.struct(
        F.when(at > 0, whole[0]).otherwise(titled).alias("name"),
        F.when((at > 0) & (F.size(whole) > 1), F.array_join(F.slice(whole, F.lit(2), F.size(whole)), ", ")).alias("address"),
        F.when(at > 0, rules.postcode(F.element_at(lines, F.greatest(at, F.lit(1))))).alias("postcode"),
    )
