"""The SQL functions give what the column functions give."""

from pyspark.sql import functions as F

from waybridge.functions import sqlfunctions as q

SAMPLES = {
    "string": [
        None, "", " $1,250.00 ", "(12.5)", "03/04/2024", "March 5, 2024", "12 kg", "Detention charge", "it's 'quoted'",
        '{"amount": "7.10", "currency": "CAD"}', "RATE CONFIRMATION\nLOAD # 123 TOTAL RATE: $ 1,400.00 call (555) 123-4567",
        '```json\n{"agreed": true, "certainty": 0.7}\n```', "in_review", "pending", "bol", "rule", "none", "BILL OF LADING",
        "normalize", "pickup_date", "a.b@c.org", "complete", "weight",
    ],
    "bigint": [0, 5, 30_000_000],
    "binary": [None, b"%PDF-1.7", b"text"],
    "boolean": [True, False, None],
    "decimal(12,2)": ["12.50", "-3.00", None],
    "decimal(4,3)": ["0.700", "0.999", None, "0.300"],
    "array<string>": [[], None, ["none", "rate_delta"], ["low_confidence: x", "discrepancy"], ["delivery_date", None]],
    "array<decimal(12,2)>": [[], ["10.00", None, "2.50"], None],
    "map<string,string>": [{}, None, {"pickup_date": "1/2/24", "weight": "10 lbs", "note": None, "total_rate": "$5"}],
    "map<string,decimal(4,3)>": [{}, None, {"weight": "0.400", "x": "0.900"}, {"x": "0.900", "a": "0.900"}],
}


def _literal(value, kind):
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(value, dict):
        pairs = [F.lit(x) for pair in value.items() for x in pair]
        return (F.create_map(*pairs) if pairs else F.create_map()).cast(kind)
    if isinstance(value, list):
        return F.array(*map(F.lit, value)).cast(kind)
    return F.lit(bytearray(value) if isinstance(value, bytes) else value).cast(kind)


def _rows(spark, fn):
    """A table with one row per combination of sample places, longest list first."""
    kinds = [k for _, k, _ in fn.parameters]
    samples = [SAMPLES.get(k) for k in kinds]
    if any(s is None for s in samples):
        return None
    n = max(map(len, samples), default=1)
    df = spark.range(n * 3)
    for j, ((name, kind, _), values) in enumerate(zip(fn.parameters, samples, strict=True)):
        chosen = F.lit(None).cast(kind)
        place = F.pmod(F.col("id") + F.floor(F.col("id") / n) * j, F.lit(len(values)))
        for i, v in enumerate(values):
            chosen = F.when(place == i, _literal(v, kind)).otherwise(chosen)
        df = df.withColumn(name, chosen)
    return df


def type_of(df, name):
    return df.schema[name].dataType.simpleString()


def test_every_function_equals_its_column(spark):
    assert len(q.register(spark)) == len(q.FUNCTIONS) >= 45
    for name, fn in q.FUNCTIONS.items():
        df = _rows(spark, fn)
        if df is None:
            assert name == "should_route_to_hitl"
            continue
        call = f"{name}({', '.join(p for p, _, _ in fn.parameters)})"
        both = df.select(F.expr(call).alias("sql"), fn.column().alias("col"))
        assert type_of(both, "sql") == type_of(both, "col"), name
        for r in both.select(F.col("sql").cast("string"), F.col("col").cast("string")).collect():
            assert r[0] == r[1], (name, r)


def test_routing_and_defaults(spark):
    q.register(spark)
    row = spark.sql("""
        select should_route_to_hitl(array(
                 named_struct('doc_type', 'bol', 'document_confidence', 0.7bd, 'fields', map('weight', 0.5bd, 'note', 0.1bd)),
                 named_struct('doc_type', 'pod', 'document_confidence', 0.9bd, 'fields', map())), array('rate_delta on fuel')) as routed,
               should_route_to_hitl(array()) as calm, score_field_confidence('rule') as rule,
               score_field_confidence('llm_text', verification_agreed => false) as unsupported,
               resolve_corrected('in_review', map('weight', '12')).state as corrected,
               resolve_corrected('in_review', map()).error as refused,
               transition_to_in_review('resolved') as late, normalize_weight('3', unit => 'tons') as pounds""").first()
    assert row["routed"]["reasons"] == [
        "low_confidence: bol document confidence 0.700 < 0.8",
        "low_confidence: bol.weight confidence 0.500 < 0.7",
        "rate_delta on fuel",
    ]
    assert not row["calm"]["needs_review"]
    assert (float(row["rule"]), float(row["unsupported"])) == (0.99, 0.5)
    assert row["corrected"] == "resolved" and row["refused"].startswith("corrected_fields is required")
    assert row["late"]["state"] == "resolved" and row["late"]["error"]
    assert float(row["pounds"]) == 6000


def test_functions_need_no_python_worker(spark):
    q.register(spark)
    plan = spark.sql("select normalize_date(string(id)), classify_document(string(id)) from range(3)")
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
