"""Texts of fields are spelled per order, not per field."""

from waybridge.plans import fixtures as fx


def test_texts_are_spelled_before_fields_multiply(spark, tmp_path):
    spark.sql(
        "SELECT id AS o_orderkey, id AS o_custkey, timestamp'2024-01-05' AS o_orderdate FROM range(40)"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    out = fx.fields(spark, str(tmp_path))
    tree = out._jdf.queryExecution().optimizedPlan().toString()
    assert "date_format" not in tree.split("Generate")[0] and "date_format" in tree
    got = {(r["job_id"], r["doc_type"], r["field_name"]): r["field_value"] for r in out.collect()}
    assert got[7, "invoice", "load_number"] == "RC-7"
    assert got[4, "rate_con", "pickup"] == '{"location":"Dock 5","date":"Jan 06 2024"}'
    assert got[8, "bol", "weight"] == "9 lbs"
    assert got[7, "rate_con", "broker_name"] == "broker_name 7"
