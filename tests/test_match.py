from waybridge.operators import match

CHARGES = "shipment_id string, doc_type string, category string, pos bigint, amount decimal(12,2)"
QUANTITIES = "shipment_id string, doc_type string, weight decimal(18,4), pieces decimal(18,4)"


def _run(spark, charges, quantities=(), **kw):
    from decimal import Decimal

    c = spark.createDataFrame([(s, t, k, p, Decimal(a) if a is not None else None) for s, t, k, p, a in charges], CHARGES)
    q = spark.createDataFrame(
        [(s, t, *(None if x is None else Decimal(x) for x in xs)) for s, t, *xs in quantities], QUANTITIES
    )
    rows = match.match_shipments(c, q, **kw).collect()
    return {(r["shipment_id"], r["line_item"]): r for r in rows}


def test_money_tolerance(spark):
    got = _run(
        spark,
        [
            ("a", "rate_con", "linehaul", 0, "1.00"), ("a", "invoice", "Linehaul", 0, "1.02"),
            ("b", "rate_con", "linehaul", 0, "1.00"), ("b", "invoice", "linehaul", 0, "1.03"),
            ("c", "invoice", "linehaul", 0, "5.00"),
        ],
    )
    assert got["a", "linehaul"]["discrepancy_flag"] == "none"
    assert got["b", "linehaul"]["discrepancy_flag"] == "rate_delta"
    assert float(got["b", "linehaul"]["discrepancy_amount"]) == 0.03
    assert got["c", "linehaul"]["discrepancy_flag"] == "none"
    assert got["c", "linehaul"]["invoice_value"] == "5.00"
    # every shipment has its four fixed lines
    assert len(got) == 12


def test_accessorials(spark):
    got = _run(
        spark,
        [
            ("a", "rate_con", "detention", 1, "50"), ("a", "invoice", "Detention Charge", 1, "50"),
            ("a", "rate_con", "layover", 2, "70"),
            ("a", "invoice", "tarp fee", 3, "30"),
            ("a", "invoice", "lumper", 4, "10"), ("a", "invoice", "lumper fee", 5, "20"),
        ],
    )
    assert got["a", "detention"]["discrepancy_flag"] == "none"
    assert got["a", "layover"]["discrepancy_flag"] == "missing_accessorial"
    assert got["a", "layover"]["discrepancy_amount"] is None
    assert (got["a", "tarp"]["discrepancy_flag"], float(got["a", "tarp"]["discrepancy_amount"])) == ("extra_accessorial", 30)
    # differently written charges of one line add up
    assert got["a", "lumper"]["invoice_value"] == "30.00"


def test_no_billed_charge_is_lost(spark):
    rows = [("a", "invoice", k, i, a) for i, (k, a) in enumerate(
        [("chassis fee", "50"), ("toll", "20"), ("overnight stay", "80"), ("layover", "10"), ("", "5")])]
    got = _run(spark, rows)
    assert {k[1]: float(r["discrepancy_amount"]) for k, r in got.items() if r["discrepancy_amount"] is not None} == {
        "chassis_fee": 50, "toll": 20, "layover": 90, "other": 5}
    # of one written category the last one counts, or all are added up
    again = [("a", "invoice", "toll", 0, "20"), ("a", "invoice", "Toll", 1, "7")]
    assert _run(spark, again)["a", "toll"]["invoice_value"] == "7.00"
    assert _run(spark, again, duplicates="sum")["a", "toll"]["invoice_value"] == "27.00"


def test_first_linehaul_wins_and_fuel_falls_back(spark):
    got = _run(
        spark,
        [
            ("a", "invoice", "linehaul", 1, "10"), ("a", "invoice", "linehaul", 2, "20"),
            ("a", "invoice", "fuel", 0, "5"), ("a", "invoice", "fuel-surcharge", 3, "6"),
            ("b", "invoice", "fuel", 0, "5"),
        ],
    )
    assert got["a", "linehaul"]["invoice_value"] == "10.00"
    assert got["a", "fuel_surcharge"]["invoice_value"] == "6.00"
    assert got["b", "fuel_surcharge"]["invoice_value"] == "5.00"


def test_quantities(spark):
    got = _run(
        spark,
        [],
        [
            ("a", "bol", "1000", "5"), ("a", "pod", "1010", "4"),
            ("b", "bol", "1000", "5"), ("b", "pod", "1010.1", "5"),
            ("c", "bol", "0", "0"), ("c", "pod", "1", "0"),
            ("d", "bol", "12.5", None),
        ],
    )
    flags = {k: r["discrepancy_flag"] for k, r in got.items()}
    assert flags["a", "weight"] == "none" and flags["a", "pieces"] == "pieces_variance"
    assert flags["b", "weight"] == "weight_variance" and flags["b", "pieces"] == "none"
    assert flags["c", "weight"] == "weight_variance" and flags["c", "pieces"] == "none"
    assert got["d", "weight"]["bol_pod_value"] == "12.5" and flags["d", "weight"] == "none"


def test_reasons_in_line_order(spark):
    from decimal import Decimal

    c = spark.createDataFrame(
        [("a", "rate_con", "tarp", 1, Decimal(5)), ("a", "invoice", "detention", 2, Decimal(5)), ("a", "rate_con", "linehaul", 0, Decimal(5)), ("a", "invoice", "linehaul", 0, Decimal(9))],
        CHARGES,
    )
    rolled = match.shipment_reasons(match.match_shipments(c, spark.createDataFrame([], QUANTITIES))).collect()
    assert rolled[0]["reasons"] == [
        "discrepancy: rate_delta on linehaul", "discrepancy: extra_accessorial on detention", "discrepancy: missing_accessorial on tarp",
    ]


def test_one_shipment_with_most_rows(spark):
    """A shipment that owns nearly all charges gives the same lines as any other."""
    many = [("hot", "invoice", "detention", i, str(i % 7)) for i in range(5000)] + [("cold", "invoice", "detention", 1, "3")]
    got = _run(spark, many)
    assert got["hot", "detention"]["invoice_value"] == str(4999 % 7) + ".00"
    assert got["cold", "detention"]["invoice_value"] == "3.00"


def test_one_table_of_amounts_serves_both_treatments_of_duplicates(spark):
    from decimal import Decimal

    charges = spark.createDataFrame(
        [
            ("a", side, name, pos, Decimal(x))
            for side, name, pos, x in [
                ("invoice", "Lumper", 2, "5.00"), ("invoice", " lumper ", 3, "7.00"), ("invoice", "LUMPER FEE", 1, "1.00"),
                ("rate_con", "lumper", 0, "8.00"), ("invoice", "fuel", 0, "3.00"), ("invoice", "Fuel Surcharge", 4, "9.00"),
            ]
        ],
        CHARGES,
    )
    papers = (charges, spark.createDataFrame([("a", "bol", Decimal(10), None), ("b", "pod", None, Decimal(2))], QUANTITIES))
    amounts = match.line_amounts(*papers)
    for duplicates in ("last", "sum"):
        own = match.match_shipments(*papers, duplicates=duplicates)
        shared = match.match_shipments(*papers, duplicates=duplicates, amounts=amounts)
        assert sorted(map(str, own.collect())) == sorted(map(str, shared.collect()))
        # 7 (last of "lumper") + 1, or all of them; of the fuel charges the explicit one
        got = {(r.shipment_id, r.line_item): r for r in own.collect()}
        assert got["a", "lumper"].invoice_value == {"last": "8.00", "sum": "13.00"}[duplicates]
        assert got["a", "fuel_surcharge"].invoice_value == "9.00" and got["b", "pieces"].pod_value == "2"


def test_accuracy_groups_lines_without_sorting_texts(spark):
    import pytest

    from waybridge import vocab
    from waybridge.operators.evaluate import match_accuracy

    kind = "shipment_id string, line_item string, discrepancy_flag string"
    results = spark.createDataFrame([("a", "x", "none"), ("a", "y", "rate_delta"), ("b", None, "none"), (None, "z", None)], kind)
    truth = spark.createDataFrame([("a", "x", "none"), ("a", "y", "none"), ("b", None, "none"), ("c", "z", "none")], kind)
    plain, numbered = match_accuracy(results, truth), match_accuracy(results, truth, list(vocab.FLAG_LABELS))
    assert plain.collect() == numbered.collect() and numbered.first()["correct"] == 2
    assert "SortAggregate" not in numbered._sc._jvm.PythonSQLUtils.explainString(numbered._jdf.queryExecution(), "simple")
    odd = results.unionByName(spark.createDataFrame([("d", "x", "odd")], kind))
    with pytest.raises(Exception, match="unknown flag odd"):
        match_accuracy(odd, truth, list(vocab.FLAG_LABELS)).collect()
