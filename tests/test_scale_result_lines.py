"""Match lines are gathered for the shipments of finished jobs only."""

from waybridge.operators import match
from waybridge.plans import reports


def test_lines_of_other_shipments_are_not_gathered(spark):
    jobs = spark.createDataFrame(
        [(1, 10, "complete"), (2, 10, "complete"), (3, None, "complete"), (4, 11, "queued")],
        "job_id long, shipment_id long, status string",
    )
    documents = spark.createDataFrame(
        [(1, 5, "bol", 1, 2, 0.9)],
        "job_id long, document_id long, doc_type string, page_start int, page_end int, class_confidence double",
    )
    fields = spark.createDataFrame(
        [], "document_id long, field_name string, field_value string, confidence double, source_page int, source_bbox string"
    )
    charges = spark.createDataFrame(
        [(s, "invoice", "linehaul", 1, 5.0) for s in (10, 11, 12)], "shipment_id long, doc_type string, category string, pos long, amount double"
    )
    none = spark.createDataFrame([], "shipment_id long, doc_type string, weight double, pieces double")
    reviews = spark.createDataFrame([], "job_id long, reason string")
    out = reports.result_documents(jobs, documents, fields, match.match_shipments(charges, none), reviews)
    assert "Join Inner" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["job_id"]: len(r["match_results"] or []) for r in out.collect()} == {1: 4, 2: 4, 3: 0}
