"""Reasons need every input once."""

from waybridge.plans import catalog


def test_charges_are_read_alike_by_all_checks(spark, tmp_path):
    spark.sql(
        "SELECT id AS o_orderkey, id AS o_custkey, timestamp'2024-01-05' AS o_orderdate FROM range(40)"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql(
        "SELECT id AS l_orderkey, id AS l_partkey, id AS l_suppkey, 1L AS l_linenumber, 5.0D AS l_extendedprice FROM range(40)"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = catalog.review_reason(spark, str(tmp_path))
    assert "isnotnull(l_orderkey" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 40
