"""Cases that once crashed or lost rows."""

import datetime as dt
import json

from pyspark.sql import functions as F

from waybridge.functions.text import header_type
from waybridge.operators import split
from waybridge.plans import reports
from waybridge.sources import pages, store
from waybridge.streaming import jobs as streams


def test_documents_with_one_start_page(spark):
    jobs = spark.createDataFrame([("j", "s", "complete")], "job_id string, shipment_id string, status string")
    docs = spark.createDataFrame(
        [("j", f"d{i:03}", i % 3 + 1, "bol", 0.5) for i in range(400)],
        "job_id string, document_id string, page_start int, doc_type string, class_confidence double",
    )
    fields = spark.createDataFrame(
        [], "document_id string, field_name string, field_value string, confidence double, source_page int, source_bbox string"
    )
    matches = spark.createDataFrame(
        [],
        "shipment_id string, line_ord int, line_item string, rate_con_value string, bol_pod_value string,"
        "invoice_value string, discrepancy_flag string, discrepancy_amount double",
    )
    reviews = spark.createDataFrame([], "job_id string, reason string, state string, review_id string, created_at timestamp")
    row = reports.result_documents(jobs, docs, fields, matches, reviews).first()
    got = [(d["page_start"], d["document_id"]) for d in row["documents"]]
    assert len(got) == 400 and got == sorted(got)


def test_null_account_stays(spark):
    t = dt.datetime(2024, 1, 1)
    subs = spark.createDataFrame(
        [("a", None, "k", t), ("b", None, "k", t + dt.timedelta(1)), ("c", "x", None, t)],
        "job_id string, account_id string, idempotency_key string, created_at timestamp",
    )
    got = {r["job_id"]: r["answer_job_id"] for r in store.first_submissions(subs).collect()}
    assert got == {"a": "a", "b": "a", "c": "c"}


def test_streams_take_text_ids(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("u1", "s1", t), ("u1", "s2", t)], "account_id string, submission_id string, ts timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = streams.file_stream(spark, str(tmp_path / "in"), rows.schema)
    got = streams.run_to_end(streams.limited_submissions(stream, limit=1), "text-ids").collect()
    assert sorted((r["submission_id"], r["accepted"]) for r in got) == [("s1", True), ("s2", False)]


def test_header_in_any_case(spark):
    df = spark.createDataFrame([("Proof of Delivery",), ("PROOF OF DELIVERY",)], "h string")
    assert df.select(header_type(F.col("h")).alias("t")).distinct().count() == 1


def test_json_pages_keep_all_columns(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"job_id": "u-1", "page_no": 1, "text": "x", "header_text": "BOL"}))
    row = pages.read_pages(spark, str(tmp_path), "json").first()
    assert (row["job_id"], row["header_text"], row["page_no"]) == ("u-1", "BOL", 1)


def test_proposed_ranges_stay_inside_the_job(spark):
    reply = json.dumps([
        {"page_start": 1, "page_end": 900000000, "doc_type": "bol"}, {"page_start": 3, "page_end": 2, "doc_type": "pod"},
    ])
    replies = spark.createDataFrame([(1, reply)], "job_id int, reply string")
    known = spark.createDataFrame([(1, p) for p in (1, 2, 3)], "job_id int, page_no int")
    got = split.proposed_segments(replies, known).collect()
    assert [(r["page_start"], r["page_end"]) for r in got] == [(1, 3)]


def test_whole_pages_in_digests(spark):
    df = spark.createDataFrame([(1, 1, "x" * 2000)], "job_id int, page_no int, text string")
    got = split.page_digests(df, page_chars=None, digest_chars=700).collect()
    assert sum(r["digest"].count("x") for r in got) == 2000


def test_tables_are_read_as_they_are(spark):
    plan = store.read_table(spark, "/root/testdata/sf0.001/orders.parquet")._jdf.queryExecution().toString()
    assert "RoundRobin" not in plan
