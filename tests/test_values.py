from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F

from waybridge.functions import values as v


def test_dates(each):
    cases = {
        "2026-08-20": date(2026, 8, 20),
        "2026-13-20": None,
        " 08/20/2026 ": date(2026, 8, 20),
        "8/2/26": date(2026, 8, 2),
        "20/08/2026": date(2026, 8, 20),
        "05/06/2026": date(2026, 5, 6),
        "08-20-26": date(2026, 8, 20),
        "August 20, 2026": date(2026, 8, 20),
        "aug 20 2026": date(2026, 8, 20),
        "August 20,2026": None,
        "2026/8/2": date(2026, 8, 2),
        "20.08.2026 at noon": date(2026, 8, 20),
        "1/2/345": None,
        "2/30/2026": None,
        "1/1/70": date(2070, 1, 1),
        "Sept 3 2026": None,
        "soon": None,
        "": None,
    }
    assert each(v.normalize_date, list(cases)) == list(cases.values())


def test_amounts(each):
    cases = {
        "$1,234,567.89": D("1234567.89"),
        "($150.00)": D("-150.00"),
        "-$150.00": D("-150.00"),
        "1850.00 USD": D("1850.00"),
        "cad 7": D("7.00"),
        "100USD": None,
        "(5) USD": None,
        "(-5)": D("5.00"),
        "--5": D("5.00"),
        "(5": None,
        "5)": None,
        "1e5": D("100000.00"),
        "nan": None,
        "12d": None,
        ".5": D("0.50"),
        "": None,
    }
    assert each(v.normalize_amount, list(cases)) == list(cases.values())


def test_money_objects_keep_their_currency(each):
    got = each(v.normalize_money, ['{"amount": 12.345, "currency": "CAD"}', '{"amount": "x"}', "9 CAD"])
    assert got[0].asDict() == {"amount": D("12.35"), "currency": "CAD"}
    assert got[1] is None
    assert got[2].asDict() == {"amount": D("9.00"), "currency": "USD"}


def test_weights(each):
    cases = {
        "1000 kg": D("2204.62"), "1 ton": D("2000.00"), "15000 widgets": D("15000.00"),
        "15,000 lbs": D("15000.00"), "16oz": D("1.00"), "12": D("12.00"), ",": None, "heavy": None,
    }
    assert each(v.normalize_weight, list(cases)) == list(cases.values())
    assert each(lambda c: v.normalize_weight(c, F.lit("kg")), ["10"]) == [D("22.05")]


def test_charge_names(each):
    cases = {
        "Detention Charge": "detention", "fee": "detention", " ": "other", None: "other",
        "STOP-OFF": "stop_off", "unloading": "lumper", "driver wait time 2h": "detention",
        "tarpaulin rental": "tarp", "misc": "other", "Overnight": "layover",
    }
    assert each(v.charge_type, list(cases)) == list(cases.values())


def test_every_synonym_is_exact(each):
    from waybridge import vocab

    assert each(v.charge_type, list(vocab.CHARGE_SYNONYMS)) == list(vocab.CHARGE_SYNONYMS.values())


def test_readings(each):
    assert each(v.amount_of, ["$1,000.5", '{"amount": 3}', "x", "12d"]) == [D("1000.50"), D("3.00"), None, None]
    text = each(lambda c: v.quantity_text(v.quantity_of(c)), ["12", "12.50", "1,200", "-1"])
    assert text == ["12", "12.5", "1200", "-1"]
    assert each(v.iso_date, ["2026-01-02", "2026-1-2", "2026-02-30"]) == [date(2026, 1, 2), None, None]


def test_texts_without_an_amount_are_not_cast(each):
    """A cast of an empty text throws inside Spark, which costs more than reading an amount."""
    shown = str(v.normalize_amount(F.col("x")))
    assert "regexp_replace" not in shown and "CASE WHEN !(=(" in shown
    texts = ["n/a", "", "($ 5.00)", "- 7", "$ 3 ", "(-5)", "€1,2", "5)", "é", None]
    got = each(v.normalize_amount, texts)
    assert [None if g is None else float(g) for g in got] == [None, None, -5.0, -7.0, 3.0, 5.0, 12.0, None, None, None]


def test_days_weights_and_names_in_any_case_and_between_odd_spaces(each):
    days = [" March 5, 2024\n", "mAr 5 2024", "Mars 5, 2024", "13/02/2024", "2024-13-45", "may 1, 2023", "é 1, 2023", ""]
    got = each(v.normalize_date, days)
    assert [None if g is None else str(g) for g in got] == [
        "2024-03-05", "2024-03-05", None, "2024-02-13", None, "2023-05-01", None, None,
    ]
    weights = each(v.normalize_weight, ["10 LBS", "10 lbs", "1,000", ",5", ".5", "x", "-3", None])
    assert [None if w is None else float(w) for w in weights] == [10.0, 10.0, 1000.0, 5.0, None, None, None, None]
    assert each(v.charge_type, [" LUMPER ", "", None, "zzz"]) == ["lumper", "other", "other", "other"]
