"""Statement inputs as pure functions of the driver's tables; nothing is written.

The tables hold no statements, so each view builds them from orders, customers, documents, parts and events,
with faults placed by remainders of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MONEY = "decimal(15,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cased(key: Column, n: int, *values: Column) -> Column:
    """One of ``values`` by key % n; the last for the rest."""
    out = F.when(key % n == 0, values[0])
    for i, v in enumerate(values[1:-1], 1):
        out = out.when(key % n == i, v)
    return out.otherwise(values[-1])


def account_order() -> Window:
    return Window.partitionBy("account").orderBy("tx_date", "tx_key")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per transaction: account, seq, tx_key, tx_date, amount, true direction, opening and true balance."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_name")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("account"),
        F.col("o_orderkey").alias("tx_key"),
        F.col("o_orderdate").cast("date").alias("tx_date"),
        F.col("o_totalprice").cast(MONEY).alias("amount"),
        F.when(F.col("o_orderkey") % 2 == 0, "DEBIT").otherwise("CREDIT").alias("truth"),
        F.col("c_acctbal").cast(MONEY).alias("opening"),
        F.col("c_name").alias("file_name"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )
    signed = F.when(F.col("truth") == "DEBIT", -F.col("amount")).otherwise(F.col("amount"))
    running = account_order().rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns(
        {
            "seq": (F.row_number().over(account_order()) - 1).cast("int"),
            "balance": (F.col("opening") + F.sum(signed).over(running)).cast(MONEY),
        }
    )


def ledger_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as a statement shows it: raw texts, and balances with gaps, off by a penny or misread."""
    k, amount = F.col("tx_key"), F.col("amount")
    shown, plain = F.format_number(amount, 2), amount.cast("string")
    raw = cased(
        k,
        8,
        shown,
        F.concat(F.lit("£"), shown),
        F.concat(F.lit("("), shown, F.lit(")")),
        F.concat(shown, F.lit(" DR")),
        F.concat(shown, F.lit(" CR")),
        F.concat(F.lit("-"), plain),
        F.concat(plain, F.lit("-")),
        F.when(k % 16 == 7, F.lit("-")).otherwise(F.concat(F.lit("GBP "), plain)),
    )
    d = F.col("tx_date")
    fmt = lambda p: F.date_format(d, p)
    dates = cased(
        k,
        14,
        fmt("d MMMM yyyy"),
        fmt("dd MMM yyyy"),
        fmt("dd MMM yy"),
        F.concat(fmt("d"), F.lit("th "), fmt("MMM yyyy")),
        F.upper(fmt("ddMMMyy")),
        F.upper(fmt("ddMMM")),
        fmt("yyyy-MM-dd"),
        fmt("dd/MM/yyyy"),
        fmt("dd-MM-yyyy"),
        fmt("dd.MM.yyyy"),
        fmt("d/M/yyyy"),
        fmt("dd/MM/yy"),
        fmt("dd MMM"),
        F.when(k % 28 == 13, F.lit("pending")).otherwise(fmt("d/M")),
    )
    misread = F.translate(F.col("balance").cast("string"), "73", "18").cast(MONEY)
    reported = F.when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, F.col("balance") + F.lit("0.01").cast(MONEY)).when(k % 13 == 0, misread).otherwise(F.col("balance"))
    text = F.concat(cased(k, 5, F.lit("CARD PAYMENT "), F.lit("DIRECT DEBIT "), F.lit("BANK CREDIT "), F.lit("FEE DR "), F.lit("TRANSFER ")), k.cast("string"))
    return ledger(spark, sf_dir).withColumns({"amount_raw": raw, "date_raw": dates, "reported": reported.cast(MONEY), "description": text})


#: Phrases put into documents by doc_id, so that rules have something to find.
PHRASES = (
    "Bank statement\nCurrent account\nSort code: 20-11-22\nBarclays Bank",
    "Hire purchase finance agreement\nBalloon payment\nVehicle registration",
    "HSBC UK\nStatement period: 1 January\nOpening balance\nDirect debit",
    "Nationwide Building Society\nSavings account\nClosing balance\nAccount number",
    "HP sauce\nOverdraft",
    "Mr John Smith\n1 High Street\nLondon\nSW1A 1AA",
    "Mrs Ann Jones",
    "",
)


def doc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (doc_id, text) that start with one of ``PHRASES``."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    return rows.select("doc_id", F.concat(cased(F.col("doc_id"), len(PHRASES), *[F.lit(p) for p in PHRASES]), F.lit("\n"), F.col("body")).alias("text"))


#: Tops of pages by the page's key.
PAGE_TOPS = ("Statement period: 1 Jan", "Page 1 of 3", "Account number 12345678", "Balance brought forward", "continued", "", "page 2", "Previous balance 10.00")


def page_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages (doc_id, page_index, top_text): a document's orders are its pages."""
    rows = ledger(spark, sf_dir)
    return rows.select(F.col("account").alias("doc_id"), F.col("seq").alias("page_index"), cased(F.col("tx_key"), len(PAGE_TOPS), *[F.lit(p) for p in PAGE_TOPS]).alias("top_text"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an account's statement (doc_id, line, kind, y0, y1, text): M marker, D date, A amount, T other."""
    rows = ledger(spark, sf_dir).select(F.col("account").alias("doc_id"), F.col("seq").alias("line"), F.col("tx_key").alias("k"), "amount")
    kind = F.when(F.col("k") % 17 == 0, "M").when(F.col("k") % 3 == 0, "D").when(F.col("k") % 3 == 1, "A").otherwise("T")
    y0 = F.col("line") * 0.02 + F.when(F.col("k") % 5 == 0, 0.015).otherwise(0.0)
    text = F.when(F.col("k") % 17 == 0, "Balance brought forward").otherwise(F.concat(F.lit("row "), F.col("k").cast("string")))
    rows = rows.select("doc_id", "line", kind.alias("kind"), F.round(y0, 6).alias("y0"), "k", text.alias("text"), "amount")
    return rows.withColumn("y1", F.round(F.col("y0") + F.when(F.col("k") % 9 == 0, 0.0).otherwise(0.01), 6))


#: Columns of a page: start, end.
COLUMN_EDGES = ((0.0, 0.2), (0.2, 0.55), (0.6, 0.8), (0.8, 1.0))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens (doc_id, token, x0, x1, y0, y1, text, confidence) of line items: an order is a page."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_shipdate")
    rows = rows.withColumn("n", F.row_number().over(order) - 1)
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("c"), F.lit(a + 0.02).alias("at"), t.alias("text"))
            for i, ((a, _), t) in enumerate(
                zip(
                    COLUMN_EDGES,
                    (F.date_format("l_shipdate", "dd/MM/yyyy"), F.concat(F.lit("PART "), F.col("l_partkey").cast("string")), F.col("l_quantity").cast("decimal(15,2)").cast("string"), F.col("l_extendedprice").cast("decimal(15,2)").cast("string")),
                    strict=True,
                )
            )
        ]
    )
    rows = rows.select(F.col("l_orderkey").alias("doc_id"), "n", "l_partkey", F.explode(cells).alias("cell"))
    x0 = F.round(F.col("cell.at") + (F.col("l_partkey") % 7) * 0.01, 6)
    y0 = F.round(F.col("n") * 0.03 + (F.col("cell.c") * 0.001), 6)
    return rows.select("doc_id", (F.col("n") * 4 + F.col("cell.c")).cast("int").alias("token"), x0.alias("x0"), F.round(x0 + 0.05, 6).alias("x1"), y0.alias("y0"), F.round(y0 + 0.01, 6).alias("y1"), F.col("cell.text").alias("text"), (0.9 + (F.col("l_partkey") % 10) * 0.01).alias("confidence"))


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates: provider = a part's brand, active unless the key divides by 9."""
    rows = table(spark, sf_dir, "part")
    return rows.select(F.col("p_partkey").alias("template_id"), F.col("p_brand").alias("provider"), F.col("p_name").alias("name"), (F.col("p_partkey") % 9 != 0).alias("is_active"))


#: Headers of template versions by key.
HEADERS = ("Date|Description|Money out|Money in|Balance", "Date|Details|Amount|Balance", "Posted|Narrative|Debit|Credit", "Date|Type|Description|Paid out|Paid in|Balance", "")


def template_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of three templates in four: version_number, sample_count, headers."""
    rows = table(spark, sf_dir, "part").where("p_partkey % 4 <> 0")
    rows = rows.select(F.col("p_partkey").alias("template_id"), F.explode(F.sequence(F.lit(1), (F.col("p_size") % 3 + 1).cast("int"))).alias("version_number"), "p_size")
    key = F.col("template_id") + F.col("version_number")
    return rows.select("template_id", "version_number", (F.col("p_size") + F.col("version_number")).cast("int").alias("sample_count"), F.split(cased(key, len(HEADERS), *[F.lit(h) for h in HEADERS]), r"\|").alias("headers"))


STATUSES = ("PENDING", "IN_REVIEW", "RESOLVED", "SKIPPED")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("review_id"), F.col("user_id").alias("doc_id"), cased(F.col("event_id"), 4, *[F.lit(s) for s in STATUSES]).alias("status"), (F.col("event_id") % 10 + 1).cast("int").alias("priority"), F.col("ts").alias("created_at"))


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("engine"), F.col("value").cast("decimal(10,6)").alias("cost_usd"), (F.col("event_id") % 5 + 1).alias("pages"), (F.abs("value") * 10).alias("latency_s"), "event_id")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("run_id"), F.col("user_id").alias("doc_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("status"))
