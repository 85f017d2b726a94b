"""Queries on the stored ledger, templates, reviews, costs and ready-made tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fallback, ledger, review, solver, templates
from ..sources import derived
from .inputs_sql import LEDGER_RAW, REVIEWS, TEMPLATES, cased, quoted
from .parser_queries import AS_OF
from .solver_queries import _CASE3 as CASE3


def solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = solver.infer_by_balance(derived.ledger_raw(spark, sf_dir), ["account"], ["seq"])
    return rows.withColumn("clean_description", F.regexp_replace("description", " [0-9]+$", ""))


def ledger_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of completed transactions, newest first."""
    rows = ledger.filtered(derived.ledger(spark, sf_dir), status="F", priority=None)
    return ledger.page(rows, [F.desc("tx_date"), F.asc("tx_key")], 100, 50).select("account", "tx_key", "tx_date", "amount", "status")


def ledger_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.filtered(derived.ledger(spark, sf_dir), {"file_name": "CUSTOMER#00"}, status=["F", "O"])
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(25,2)").alias("total"))


def ledger_export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.export_rows(solved(spark, sf_dir))


def ledger_export_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.signed_rows(solved(spark, sf_dir))


def export_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.table(spark, sf_dir, "nation").select(F.col("n_name").alias("bank"), F.lit("A B").alias("holder"), F.lit("SW1A 1AA").alias("postcode"), "n_nationkey")
    one, many = rows.where("n_nationkey = 3"), rows.where("n_nationkey < 3")
    name = lambda r: ledger.export_name(r, "bank", "holder", "postcode", "20240601")
    return name(one).unionByName(name(many)).unionByName(name(rows))


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest(derived.runs(spark, sf_dir), ["doc_id"], [F.desc("created_at"), F.desc("run_id")]).select("doc_id", "run_id", "status")


def dedupe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each requested document once, in the order of its first request."""
    rows = derived.runs(spark, sf_dir)
    return rows.groupBy("doc_id").agg(F.min("run_id").alias("first_request"), F.count("*").alias("requests"))


def purge_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of customers, orders and line items when every seventh customer goes."""
    customers = derived.table(spark, sf_dir, "customer").select("c_custkey")
    orders = derived.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = derived.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    gone = customers.where("c_custkey % 7 = 0")
    lost = orders.join(gone, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
    kept = ledger.purged(customers, gone, "c_custkey", {"orders": (orders, "o_custkey")}) | {"items": ledger.purged(orders, lost, "o_orderkey", {"items": (items, "l_orderkey")})["items"]}
    counts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, rows in kept.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def interval_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions of each account by spans of ten rows, with the span's bounds and first and last date."""
    rows = derived.ledger(spark, sf_dir).withColumn("segment_index", F.floor(F.col("seq") / 10).cast("int"))
    return rows.groupBy("account", "segment_index").agg(F.min("seq").alias("start_row"), F.max("seq").alias("end_row"), F.min("tx_date").alias("period_start"), F.max("tx_date").alias("period_end"), F.sum("amount").cast("decimal(25,2)").alias("turnover"))


def nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each account's nested document."""
    rows = derived.ledger(spark, sf_dir).withColumn("segment_index", F.floor(F.col("seq") / 10).cast("int"))
    rows = rows.select(F.col("account").alias("doc_id"), "segment_index", "seq", "amount")
    spans = rows.groupBy("doc_id", "segment_index").agg(F.max("seq").alias("end_row"))
    docs = derived.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    out = ledger.nested(docs, spans, rows)
    count = F.aggregate("segments", F.lit(0), lambda a, s: a + F.size(s["transactions"]))
    return out.select("doc_id", F.coalesce(F.size("segments"), F.lit(0)).cast("int").alias("n_segments"), F.coalesce(count, F.lit(0)).cast("int").alias("n_rows"), F.element_at("segments", -1)["end_row"].alias("last_row"))


def template_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.version_summary(derived.templates(spark, sf_dir), derived.template_versions(spark, sf_dir))


def template_next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.next_versions(derived.templates(spark, sf_dir), derived.template_versions(spark, sf_dir))


#: Headers of the documents that look for a template.
ASKED = ("Date|Description|Money out|Money in|Balance", "Date|Details|Amount", "Posted|Debit|Credit", "", "Foo|Bar")


def template_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    one, two = (k % 5 + 1).cast("string"), (F.floor(k / 5) % 5 + 1).cast("string")
    name = derived.cased(k, 4, F.concat(F.lit("BRAND#"), one, two), F.concat(F.lit("brand#"), one), F.concat(F.lit("#"), one, two), F.lit("nowhere"))
    asked = derived.table(spark, sf_dir, "supplier").withColumn("provider", name).select(
        F.col("s_suppkey").alias("request_id"),
        F.col("provider"),
        F.split(derived.cased(F.col("s_suppkey"), 5, *[F.lit(a) for a in ASKED]), r"\|").alias("headers"),
    )
    return templates.match(asked, derived.templates(spark, sf_dir), derived.template_versions(spark, sf_dir))


def review_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.queue_stats(derived.reviews(spark, sf_dir))


def review_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.pending(derived.reviews(spark, sf_dir), 20, 30).select("review_id", "doc_id", "priority")


def cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.cost_summary(derived.costs(spark, sf_dir), ["engine"])


def metric_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.cumulative_buckets(derived.costs(spark, sf_dir), ["engine"], "latency_s", review.DOCUMENT_SECONDS).withColumn("edge", F.when(F.col("edge") < 1e9, F.col("edge")).otherwise(F.lit(-1.0)))


def raw_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready-made tables (doc_id, engine, table, row, cells) of all accounts, read by some of five engines.

    Dates are empty, unreadable or in three formats; both amount columns may hold one; markers and summaries stand in the
    description or in another cell; tables have a title, two, or no header.
    """
    rows = derived.ledger_raw(spark, sf_dir)
    k, doc = F.col("tx_key"), F.col("account")
    plain = F.date_format("tx_date", "dd/MM/yyyy")
    shown = derived.cased(F.floor(k / 2), 6, F.lit(""), F.lit("pending"), F.date_format("tx_date", "dd MMM yyyy"), F.date_format("tx_date", "yyyy-MM-dd"), plain, plain)
    both, none = k % 9 == 0, k % 23 == 0
    money_in = F.when(none | ~(both | (k % 2 == 1)), "").otherwise(F.col("amount").cast("string"))
    money_out = F.when(none, "").when(both, (F.col("amount") + 1).cast("string")).when(k % 2 == 0, F.col("amount").cast("string")).otherwise("")
    swapped = doc % 5 == 0
    text = F.when(k % 31 == 0, F.lit("Opening balance")).otherwise(F.col("description"))
    note = F.when(k % 37 == 0, "Closing balance").when(k % 41 == 0, "ab/fx").when(k % 43 == 0, "b/f")
    cells = F.array(shown, text, F.when(swapped, money_out).otherwise(money_in), F.when(swapped, money_in).otherwise(money_out), F.col("balance").cast("string"), note)
    header = F.split(F.when(swapped, "Date|Description|Money out|Money in|Balance|Remarks").otherwise("Date|Description|Money in|Money out|Balance|Remarks"), r"\|")
    title = F.split(F.lit("Your|account|at|a|glance|now"), r"\|")
    line = lambda table, row, cells: F.struct(table.cast("int").alias("table"), row.cast("int").alias("row"), cells.alias("cells"))
    # An account's first row brings the titles and headers of its tables.
    top = lambda table, row, cells, there: F.when((F.col("seq") == 0) & there, line(F.lit(table), F.lit(row), cells))
    lines = F.array(
        line(F.col("seq") >= 5, F.col("seq") + 10, cells),
        top(0, 0, title, (doc % 3 == 0) | (doc % 7 == 0)),
        top(0, 1, title, doc % 7 == 0),
        top(0, 2, header, F.lit(True)),
        top(1, 14, header, F.floor(doc / 4) % 2 == 0),
    )
    d = F.col("doc_id")
    rows = rows.select(doc.alias("doc_id"), F.explode(F.array_compact(lines)).alias("line")).select("doc_id", "line.*")
    engines = F.filter(F.array(F.when(d % 4 == 0, F.lit(0)), F.when(d % 6 == 0, F.lit(1)), F.when(d % 10 == 0, F.lit(2)), F.when(d % 5 == 1, F.lit(3)), F.lit(4)), lambda e: e.isNotNull())
    return rows.withColumn("engine", F.explode(engines))


def fallback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions of the first engine that found any."""
    return fallback.extract(raw_tables(spark, sf_dir), AS_OF).select("doc_id", "engine", "row", "tx_date", "description", "amount", "direction", "balance", "confidence_amount", "confidence_date", "confidence_direction")


def fallback_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fallback.extract(raw_tables(spark, sf_dir), AS_OF).groupBy("doc_id").agg(F.min("engine").alias("engine"), F.count("*").alias("n_rows"))


_REQUESTS = f"""asked AS (SELECT s_suppkey AS request_id, CASE s_suppkey % 4 WHEN 3 THEN 'nowhere' WHEN 2 THEN '#' ELSE 'brand#' END || CASE WHEN s_suppkey % 4 < 3 THEN (s_suppkey % 5 + 1)::VARCHAR ELSE '' END
    || CASE WHEN s_suppkey % 4 IN (0, 2) THEN ((s_suppkey // 5) % 5 + 1)::VARCHAR ELSE '' END AS p,
  list_filter(list_transform(string_split({cased("s_suppkey", tuple(quoted(a) for a in ASKED))}, '|'), lambda h: trim(lower(h))), lambda h: h <> '') AS want FROM supplier)"""

_TABLES = f"""{LEDGER_RAW}, body AS (
  SELECT account AS doc_id, seq + 10 AS row, seq >= 5 AS later, (tx_key // 2) % 6 AS kind, CASE WHEN (tx_key // 2) % 6 > 1 THEN tx_date END AS shown,
    description, amount, balance, tx_key, tx_key % 31 = 0 OR tx_key % 37 = 0 OR (tx_key % 43 = 0 AND tx_key % 41 <> 0) AS summary, (tx_key % 41 = 0 OR tx_key % 43 = 0) AND tx_key % 37 <> 0 AS marker
  FROM ledger_raw
), engines AS (
  SELECT doc_id, unnest([e for e in [CASE WHEN doc_id % 4 = 0 THEN 0 END, CASE WHEN doc_id % 6 = 0 THEN 1 END, CASE WHEN doc_id % 10 = 0 THEN 2 END, CASE WHEN doc_id % 5 = 1 THEN 3 END, 4] if e IS NOT NULL]) AS engine
  FROM (SELECT DISTINCT doc_id FROM body)
), dated AS (
  SELECT *, last_value(shown IGNORE NULLS) OVER (PARTITION BY doc_id, later ORDER BY row) AS carried,
    last_value(CASE WHEN NOT marker THEN shown END IGNORE NULLS) OVER (PARTITION BY doc_id, later ORDER BY row) AS carried_on
  FROM body
), kept AS (
  SELECT b.doc_id, e.engine::INTEGER AS engine, b.row::INTEGER AS row, CASE WHEN engine = 0 AND kind = 0 THEN carried WHEN engine IN (1, 2) THEN carried_on ELSE shown END AS tx_date, b.description,
    (CASE WHEN tx_key % 9 = 0 AND b.doc_id % 5 <> 0 THEN amount + 1 ELSE amount END)::DECIMAL(15,2) AS amount,
    CASE WHEN tx_key % 9 = 0 THEN CASE WHEN b.doc_id % 5 = 0 THEN 'CREDIT' ELSE 'DEBIT' END WHEN tx_key % 2 = 1 THEN 'CREDIT' ELSE 'DEBIT' END AS direction, b.balance
  FROM dated b JOIN engines e USING (doc_id)
  WHERE NOT summary AND tx_key % 23 <> 0 AND (engine = 0 OR NOT marker) AND (engine > 2 OR CASE WHEN later THEN (doc_id // 4) % 2 = 0 ELSE doc_id % 7 <> 0 END)
), taken AS (SELECT * FROM kept QUALIFY engine = min(engine) OVER (PARTITION BY doc_id))"""

SQL = {
    "ledger_page": f"WITH {LEDGER_RAW} SELECT account, tx_key, tx_date, amount, status FROM ledger WHERE status = 'F' ORDER BY tx_date DESC, tx_key LIMIT 50 OFFSET 100",
    "ledger_count": f"WITH {LEDGER_RAW} SELECT status, count(*) AS n, sum(amount)::DECIMAL(25,2) AS total FROM ledger WHERE status IN ('F', 'O') AND file_name ILIKE '%customer#00%' GROUP BY 1",
    "ledger_export_csv": f"""WITH {CASE3} SELECT file_name AS "File", tx_date::VARCHAR AS "Date", description AS "Description", CASE WHEN c.amount = 0 THEN '' ELSE c.amount::VARCHAR END AS "Amount", direction AS "Direction",
      CASE WHEN c.reported IS NULL OR c.reported = 0 THEN '' ELSE c.reported::VARCHAR END AS "Balance", CASE WHEN balance_confirmed THEN 'Yes' ELSE 'No' END AS "Confirmed", CASE WHEN confidence = 0 THEN '' ELSE confidence::VARCHAR END AS "Confidence"
      FROM case3 c JOIN ledger_raw USING (tx_key)""",
    "ledger_export_signed": f"""WITH {CASE3} SELECT file_name AS file, tx_date, regexp_replace(description, ' [0-9]+$', '') AS description, (CASE WHEN direction = 'DEBIT' THEN -c.amount ELSE c.amount END)::DECIMAL(15,2) AS signed_amount, direction, c.reported AS balance
      FROM case3 c JOIN ledger_raw USING (tx_key)""",
    "export_name": """SELECT regexp_replace(n_name || '_A_SW1A 1AA_20240601', '[^A-Za-z0-9]', '_', 'g') AS export_name FROM nation WHERE n_nationkey = 3
      UNION ALL SELECT regexp_replace(string_agg(DISTINCT n_name, '_' ORDER BY n_name) || '_20240601', '[^A-Za-z0-9]', '_', 'g') FROM nation WHERE n_nationkey < 3
      UNION ALL SELECT count(*)::VARCHAR || 'docs_20240601' FROM nation""",
    "latest_run": "SELECT user_id AS doc_id, event_id AS run_id, event_type AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "dedupe_ids": "SELECT user_id AS doc_id, min(event_id) AS first_request, count(*) AS requests FROM events GROUP BY 1",
    "purge_semi_anti": """SELECT 'parents' AS "table", count(*) AS n FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0)
      UNION ALL SELECT 'items', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0))""",
    "interval_segments": f"WITH {LEDGER_RAW} SELECT account, (seq // 10)::INTEGER AS segment_index, min(seq) AS start_row, max(seq) AS end_row, min(tx_date) AS period_start, max(tx_date) AS period_end, sum(amount)::DECIMAL(25,2) AS turnover FROM ledger GROUP BY 1, 2",
    "nested_documents": f"WITH {LEDGER_RAW} SELECT c_custkey AS doc_id, count(DISTINCT seq // 10)::INTEGER AS n_segments, count(tx_key)::INTEGER AS n_rows, max(seq) AS last_row FROM customer LEFT JOIN ledger ON c_custkey = account GROUP BY 1",
    "template_summary": f"""WITH {TEMPLATES} SELECT template_id, provider, name, is_active, count(version_number) AS n_versions, max(version_number) AS latest_version, coalesce(sum(sample_count), 0)::BIGINT AS samples
      FROM templates LEFT JOIN versions USING (template_id) GROUP BY ALL""",
    "template_next_version": f"WITH {TEMPLATES} SELECT template_id, (coalesce(max(version_number), 0) + 1)::INTEGER AS next_version FROM templates LEFT JOIN versions USING (template_id) GROUP BY 1",
    "template_match": f"""WITH {TEMPLATES}, {_REQUESTS}, last AS (
        SELECT template_id, list_filter(list_transform(arg_max(headers, version_number), lambda h: trim(lower(h))), lambda h: h <> '') AS have FROM versions GROUP BY 1
      ), pairs AS (
        SELECT request_id, template_id, round((CASE WHEN len(want) = 0 OR len(have) = 0 THEN 0.5 ELSE 0.3 + 0.7 * len(list_intersect(want, have)) / len(list_distinct(list_concat(want, have)))::DOUBLE END)::DOUBLE, 4) AS score
        FROM asked JOIN templates ON contains(lower(provider), p) JOIN last USING (template_id) WHERE is_active)
      SELECT request_id, template_id, score FROM pairs QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, template_id) = 1 AND score >= 0.5""",
    "review_stats": f"WITH {REVIEWS} SELECT count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'IN_REVIEW') AS in_review, count(*) FILTER (WHERE status = 'RESOLVED') AS resolved, count(*) FILTER (WHERE status = 'SKIPPED') AS skipped, count(*) AS total FROM reviews",
    "review_pending": f"WITH {REVIEWS} SELECT review_id, doc_id, priority FROM reviews WHERE status = 'PENDING' ORDER BY priority, created_at, review_id LIMIT 30 OFFSET 20",
    "cost_summary": "SELECT event_type AS engine, sum(value::DECIMAL(10,6))::DECIMAL(20,6) AS cost_usd, sum(event_id % 5 + 1)::BIGINT AS pages, count(*) AS calls FROM events GROUP BY 1",
    "metric_buckets": "WITH e AS (SELECT unnest([" + ", ".join(f"{x}::DOUBLE" for x in review.DOCUMENT_SECONDS) + "]) AS edge UNION ALL SELECT -1.0::DOUBLE) SELECT event_type AS engine, edge, count(*) FILTER (WHERE edge < 0 OR abs(value) * 10 <= edge) AS n FROM events, e GROUP BY 1, 2",
    "fallback_rows": f"""WITH {_TABLES} SELECT doc_id, engine, row, tx_date, description, amount, direction, balance,
      (CASE WHEN engine = 0 THEN 0.80 WHEN engine < 3 THEN 0.82 ELSE 0.75 END)::DOUBLE AS confidence_amount, (CASE WHEN tx_date IS NULL THEN 0.30 WHEN engine = 0 THEN 0.80 WHEN engine < 3 THEN 0.82 ELSE 0.75 END)::DOUBLE AS confidence_date,
      (CASE WHEN engine > 2 THEN 0.85 ELSE 0.90 END)::DOUBLE AS confidence_direction FROM taken""",
    "fallback_priority": f"WITH {_TABLES} SELECT doc_id, min(engine) AS engine, count(*) AS n_rows FROM taken GROUP BY 1",
}

QUERIES = {name: globals()[name] for name in SQL}
