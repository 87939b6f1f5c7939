"""Fields and corrections travel as plain rows."""

from waybridge.operators import review


def test_corrections_are_grouped_behind_one_plain_shuffle(spark):
    fields = spark.sql("SELECT 1 AS document_id, 'weight' AS field_name, '5' AS field_value, 0.9BD AS confidence")
    changes = spark.sql("SELECT * FROM VALUES (1, 'weight', null), (null, 'pieces', '7') AS t(document_id, field_name, field_value)")
    out = review.corrected_fields(fields, changes)
    tree = out._jdf.queryExecution().executedPlan().toString()
    assert tree.count("Exchange") == 1 and "REPARTITION_BY_COL" in tree
    assert {(r[0], r[1], r[2], float(r[3])) for r in out.collect()} == {(1, "weight", None, 1.0), (None, "pieces", "7", 1.0)}
