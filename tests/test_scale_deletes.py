"""Doomed keys are as many as rows, so they are merged and not copied to all tasks."""

from waybridge.sources import store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_doomed_keys_are_not_copied_to_all_tasks(spark):
    jobs = spark.sql("SELECT * FROM VALUES (1), (2) AS t(job_id)")
    documents = spark.sql("SELECT * FROM VALUES (10, 1), (20, 2), (30, NULL) AS t(document_id, job_id)")
    left = store.delete_jobs({"jobs": jobs, "documents": documents}, jobs.filter("job_id = 1"))
    assert "BroadcastHashJoin" not in plan(left["documents"])
    assert {r["document_id"] for r in left["documents"].collect()} == {20, 30}
