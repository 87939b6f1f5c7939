"""Stored bytes travel once for all documents of a job, unless it has very many."""

from pyspark.sql import functions as F

from waybridge.operators import hotkeys
from waybridge.sources import uploads


def test_only_heavy_keys_are_copied(spark):
    left = spark.range(40).select(
        F.when(F.col("id") < 20, 1).when(F.col("id") < 38, F.col("id")).alias("job_id"), F.col("id").alias("document_id")
    )
    right = spark.range(1, 30).select(F.col("id").alias("job_id"), F.concat(F.lit("b"), "id").alias("content"))
    for heavy in (1, 10, 100, None):
        out = hotkeys.lookup(left, right, ["job_id"], ["document_id"], heavy=heavy)
        got = {r["document_id"]: r["content"] for r in out.collect()}
        assert out.columns == ["job_id", "document_id", "content"] and len(got) == 40
        assert got[3] == "b1" and got[25] == "b25" and got[35] is None and got[39] is None
    plan = uploads.document_blobs(left, right)._jdf.queryExecution().analyzed().toString()
    assert f">= cast({uploads.HEAVY_JOB} as bigint)" in plan
