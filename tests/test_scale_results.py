"""Fields of documents that no result needs are left out before they are grouped."""

from waybridge.plans import catalog


def test_fields_are_kept_for_finished_jobs_only(spark, tmp_path):
    spark.sql(
        "SELECT id AS o_orderkey, id AS o_custkey, timestamp'2024-01-05' AS o_orderdate FROM range(40)"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql(
        "SELECT id AS event_id, id AS user_id, timestamp'2024-01-05' AS ts, 1.0D AS value, concat('{\"k\": ', id, '}') AS props FROM range(40)"
    ).write.parquet(f"{tmp_path}/events.parquet")
    spark.sql(
        "SELECT id AS l_orderkey, id AS l_partkey, id AS l_suppkey, 1L AS l_linenumber, 5.0D AS l_extendedprice FROM range(40)"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = catalog.result_document(spark, str(tmp_path))
    tree = out._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count("Join LeftSemi") == 3
    rows = out.collect()
    assert rows and sum(r["fields"] for r in rows) > 0
