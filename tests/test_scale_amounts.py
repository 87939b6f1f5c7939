"""Line amounts travel short and keep the order of their papers."""

from waybridge.operators import match


def tables(spark, amounts):
    rows = [(1, "rate_con", label, pos, amount) for label, pos, amount in amounts]
    charges = spark.createDataFrame(rows, "shipment_id long, doc_type string, category string, pos long, amount string")
    charges = charges.withColumn("amount", charges.amount.cast("decimal(18,4)"))
    none = spark.createDataFrame([], "shipment_id long, doc_type string, weight decimal(18,4), pieces decimal(18,4)")
    return charges, none, charges.select("shipment_id").distinct()


def test_the_first_charge_counts_whatever_its_amount(spark):
    big = "90000000000000.0000"
    out = match.line_amounts(*tables(spark, [("linehaul", 1, big), ("linehaul", 2, f"-{big}"), ("fuel", -3, "-0.0001")]))
    got = {r["line_item"]: r["rate_con"] for r in out.collect()}
    assert str(got["linehaul"]) == big and str(got["fuel_surcharge"]) == "-0.0001" and got["weight"] is None


def test_totals_hold_all_duplicates(spark):
    papers = tables(spark, [("detention", 1, "5"), ("detention", 2, "7"), ("Detention Charge", 1, "1"), ("detention", None, "2")])
    row = match.line_amounts(*papers).filter("line_item = 'detention'").first()
    assert (row["rate_con"], row["rate_con_sum"], row["bol_sum"]) == (8, 15, None)


def test_written_categories_are_dealt_out_as_they_are(spark):
    out = match.line_amounts(*tables(spark, [("linehaul", 1, "5")]))
    tree = out._jdf.queryExecution().executedPlan().toString()
    # one shuffle of partial results, one of plain rows; neither carries a value beside its place
    assert tree.count("REPARTITION_BY_COL") == 1 and tree.count("ENSURE_REQUIREMENTS") <= 2 and "min_by" not in tree
