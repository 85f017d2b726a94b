from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import layout, ledger, templates
from tallyframe.sources import files
from tallyframe.sources.scratch import scratch_root
from tallyframe.streaming import ingest


def test_uploads(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 one")
    (tmp_path / "copy.pdf").write_bytes(b"%PDF-1.7 one")
    (tmp_path / "big.pdf").write_bytes(b"%PDF" + b"x" * 100)
    (tmp_path / "empty.pdf").write_bytes(b"")
    (tmp_path / "text.txt").write_bytes(b"hello")
    good, bad = files.uploads(spark, str(tmp_path), max_bytes=50)
    assert good.count() == 1
    assert {r["path"].rpartition("/")[2]: r["reason"] for r in bad.collect()} == {"big.pdf": "TOO_LARGE", "text.txt": "UNSUPPORTED_MEDIA_TYPE"}


def test_token_source_to_lines(spark, tmp_path):
    page = tmp_path / "doc7.txt"
    page.write_text("Date      Details      Amount\n\n01/02/24  Tesco shop   12.50\n")
    spark.dataSource.register(files.TokenSource)
    tokens = spark.read.format("page_tokens").option("width", "40").option("path", str(page)).load()
    boxes = layout.build_boxes(layout.cluster_lines(tokens), ["doc_id", "line_index"]).orderBy("line_index").collect()
    assert [b["text"] for b in boxes] == ["Date Details Amount", "01/02/24 Tesco shop 12.50"]
    assert boxes[0]["doc_id"] == "doc7" and all(0 <= b["x0"] <= b["x1"] <= 1 for b in boxes)


def test_partitions_are_replaced(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1", 1), ("b", "1", 2)], "doc_id string, run_id string, v int")
    files.write_partitioned(rows, str(tmp_path / "t"))
    files.write_partitioned(rows.where("doc_id = 'b'").withColumn("v", F.lit(9)), str(tmp_path / "t"))
    assert {r["doc_id"]: r["v"] for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {"a": 1, "b": 9}


def test_csv_export(spark, tmp_path):
    rows = spark.createDataFrame([("f", None, "", "shop", Decimal("0.00"), "DEBIT", None, True, 0.0)], "file_name string, tx_date date, description string, clean_description string, amount decimal(15,2), direction string, reported decimal(15,2), balance_confirmed boolean, confidence double")
    out = ledger.export_rows(rows)
    assert out.first().asDict() == {"File": "f", "Date": "", "Description": "shop", "Amount": "", "Direction": "DEBIT", "Balance": "", "Confirmed": "Yes", "Confidence": ""}
    files.write_csv(out, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1


def test_paths_and_boxes(spark):
    row = spark.range(1).select(files.artifact_path("rendered", F.lit("d"), page=F.lit(3)).alias("p"), files.artifact_path("extractions", F.lit("d"), run=F.lit("r")).alias("q")).first()
    assert tuple(row) == ("d/rendered/page_0003", "d/extractions/r")
    with pytest.raises(ValueError):
        files.artifact_path("other", F.lit("d"))
    words = spark.createDataFrame([("a", 95.0), (" ", 95.0), ("b", 5.0)], "text string, conf double")
    assert [tuple(r) for r in files.ocr_tokens(words).collect()] == [("a", 0.95)]


def test_pages_have_bounds(spark):
    rows = spark.range(300).withColumnRenamed("id", "k")
    assert [r["k"] for r in ledger.page(rows, [F.asc("k")], 10, 5).collect()] == [10, 11, 12, 13, 14]
    for offset, limit in ((-1, 5), (0, 0), (0, 201)):
        with pytest.raises(ValueError):
            ledger.page(rows, [F.asc("k")], offset, limit)


def test_match_scores(spark):
    kind = "template_id int, provider string, name string, is_active boolean"
    known = spark.createDataFrame([(1, "HSBC", "a", True), (2, "HSBC", "b", True), (3, "HSBC", "c", False), (4, "TSB", "d", True)], kind)
    versions = spark.createDataFrame([(1, 1, 1, ["Date", "Amount"]), (2, 1, 1, ["Date", "Details", "Amount", "Balance"]), (3, 1, 1, ["Date", "Details"])], "template_id int, version_number int, sample_count int, headers array<string>")
    asked = spark.createDataFrame([(1, "hsbc", ["date", "details"]), (2, "hsbc", []), (3, "tsb", ["date"]), (4, "hsbc", ["x"])], "request_id int, provider string, headers array<string>")
    got = {r["request_id"]: (r["template_id"], r["score"]) for r in templates.match(asked, known, versions).collect()}
    assert got == {1: (2, 0.65), 2: (1, 0.5)}


def most_rows(plan):
    """The most rows that any join of an executed plan made."""
    name = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else []
    inner += [plan.children().apply(i) for i in range(plan.children().size())]
    made = plan.metrics().apply("numOutputRows").value() if name.endswith("JoinExec") else 0
    return max([made, *map(most_rows, inner)])


def test_match_compares_equal_rows_once(spark):
    headers = F.when(F.col("id") % 2 == 0, F.array(F.lit("Date"), F.lit("Amount"))).otherwise(F.array(F.lit("Posted")))
    ids = spark.range(400)
    known = ids.select(F.col("id").alias("template_id"), F.lit("HSBC").alias("provider"), F.lit(True).alias("is_active"))
    versions = ids.select(F.col("id").alias("template_id"), F.lit(1).alias("version_number"), headers.alias("headers"))
    asked = ids.select(F.col("id").alias("request_id"), F.lit("hsbc").alias("provider"), headers.alias("headers"))
    found = templates.match(asked, known, versions)
    assert {tuple(r) for r in found.collect()} == {(i, i % 2, 1.0) for i in range(400)}
    assert 400 <= most_rows(found._jdf.queryExecution().executedPlan()) <= 800


@pytest.mark.parametrize("least", [0.5, 0.0, 0.31])
def test_match_equals_all_pairs(spark, least):
    names = ["HSBC", "hsbc UK", "HS", "", None, "TSB"]
    lists = [["Date", " date ", "Amount"], ["amount", "DATE"], ["Date"], ["", None], [], None, ["x", "Date", "Posted"]]
    known = [(i, names[i % 6], i % 11 != 0) for i in range(90)]
    versions = [(i, v, lists[(i // 6 + v) % 7]) for i in range(90) if i % 13 for v in range(1, i % 3 + 2)]
    asked = [(i % 70, ["hsbc", "HSB", "s", "", None, "none"][i % 6], lists[i // 6 % 7]) for i in range(84)]  # ids from 0 to 13 ask twice
    words = lambda h: None if h is None else {w.strip().lower() for w in h if w} - {""}
    last = {i: words(h) for i, _, h in sorted(versions, key=lambda r: r[:2])}
    want = {}
    for r, part, headers in asked:
        for k, name, active in known:
            if active and k in last and None not in (part, name) and part.lower() in name.lower():
                x, y = words(headers), last[k]
                if x == set() or y == set():
                    score = 0.5
                elif x is None or y is None:
                    continue
                else:
                    score = round(0.3 + 0.7 * len(x & y) / len(x | y), 4)
                if score >= least:
                    want[r] = min(want.get(r, (-score, k)), (-score, k))
    got = templates.match(
        spark.createDataFrame(asked, "request_id int, provider string, headers array<string>"),
        spark.createDataFrame(known, "template_id int, provider string, is_active boolean"),
        spark.createDataFrame(versions, "template_id int, version_number int, headers array<string>"),
        least,
    ).collect()
    assert len(got) == len(want) > 40
    assert {r["request_id"]: (-r["score"], r["template_id"]) for r in got} == want


LEDGER = "account long, seq int, tx_key long, amount decimal(15,2), direction string, opening decimal(15,2), reported decimal(15,2)"


def test_balances_go_on_in_later_batches(spark, tmp_path):
    source = tmp_path / "in"
    parts = [
        [(1, 0, 10, Decimal("5.00"), "DEBIT", Decimal("100.00"), Decimal("95.00")), (2, 0, 20, Decimal("1.00"), "CREDIT", Decimal("0.00"), None)],
        [(1, 1, 11, Decimal("10.00"), "CREDIT", Decimal("100.00"), None), (2, 1, 21, Decimal("2.00"), "CREDIT", Decimal("0.00"), Decimal("3.00"))],
    ]
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    for part in parts:  # each run stops; the next goes on from its checkpoint
        spark.createDataFrame(part, LEDGER).coalesce(1).write.mode("append").parquet(str(source))
        stream = ingest.running_balances(ingest.read_files(spark, str(source), spark.createDataFrame([], LEDGER).schema))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    got = {r["tx_key"]: (r["expected"], r["matches"]) for r in spark.read.parquet(out).collect()}
    assert got == {10: (Decimal("95.00"), True), 20: (Decimal("1.00"), False), 11: (Decimal("105.00"), False), 21: (Decimal("3.00"), True)}


def test_batches_share_partitions(spark, tmp_path):
    schema = "doc int, v int"
    source, out, log = str(tmp_path / "s"), str(tmp_path / "o"), str(tmp_path / "c")
    for sent in ([(1, 1), (2, 2)], [(3, 3), (11, 4)], [(2, 5), (2, 6)]):  # the last sends a document again
        spark.createDataFrame(sent, schema).coalesce(1).write.mode("append").parquet(source)
        stream = ingest.read_files(spark, source, spark.createDataFrame([], schema).schema, max_files=1)
        ingest.ingest(stream, lambda b: b.withColumn("shard", F.floor(F.col("doc") / 10)), out, log, "shard", "doc")
    assert sorted((r["doc"], r["v"], r["shard"]) for r in spark.read.parquet(out).collect()) == [(1, 1, 0), (2, 5, 0), (2, 6, 0), (3, 3, 0), (11, 4, 1)]


def test_windowed_counts(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, m), "a", 1.0) for m in (1, 2, 11)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "e"))
    stream = ingest.windowed_counts(ingest.read_files(spark, str(tmp_path / "e"), spark.read.parquet(str(tmp_path / "e")).schema))
    query = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["n"] for r in spark.table("counts").collect()) == [1, 2]


def test_scratch_is_shared_or_refused(spark):
    assert scratch_root(spark)
    assert scratch_root(spark) == scratch_root(spark)
