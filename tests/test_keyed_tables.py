"""Bucketed tables, deletes by declared keys, and vocabulary tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from waybridge.functions.values import charge_type
from waybridge.operators import vocabulary
from waybridge.sources import store
from waybridge.sources.keyed import KeyedTable
from waybridge.vocab import CHARGE_SYNONYMS


def _files(path):
    return {os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.startswith("part-")}


def _rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def test_changes_touch_only_their_buckets(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"v{i}", 0) for i in range(300)] + [(None, "none", 0)], "k int, v string, at int")
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=16)
    table.create(rows)
    want = rows
    assert _rows(table.read()) == _rows(want)

    new = spark.createDataFrame([(5, "newer", 2), (7, "older", -1), (1000, "fresh", 1)], rows.schema)
    before = _files(table.path)
    touched = table.upsert(new, ["at"])
    want = store.upsert_latest(want, new, ["k"], ["at"])
    assert _rows(table.read()) == _rows(want)
    kept = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert len(touched) <= 3 and kept and kept <= _files(table.path)

    fix = spark.createDataFrame([(9, "fixed", None)], rows.schema)
    table.update(fix, ["v", "at"])
    doomed = spark.createDataFrame([(i,) for i in range(150)], "k int")
    table.delete(doomed)
    want = store.delete_rows(store.update_rows(want, fix, "k", ["v", "at"]), doomed, ["k"])
    assert _rows(table.read()) == _rows(want)
    assert [r["v"] for r in table.by_key(k=1000).collect()] == ["fresh"]
    assert [r["v"] for r in table.by_key(k=None).collect()] == ["none"]
    assert table.delete(doomed.limit(0)) == []


def test_a_bucket_can_lose_its_last_row_and_get_new_ones(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=2)
    counts = spark.createDataFrame([(1, 5), (2, 7)], "k int, n long")
    table.create(counts)
    table.delete(counts)
    assert table.read().count() == 0
    table.add(counts, ["n"])
    table.add(counts, ["n"])
    assert sorted(map(tuple, table.read().select("k", "n").collect())) == [(1, 10), (2, 14)]


def test_cascade_follows_declared_keys(spark):
    def make(text, *rows):
        return spark.createDataFrame(list(rows), text)

    tables = {
        "extracted_fields": make("document_id int, field_name string", (10, "a"), (11, "b"), (12, "c"), (None, "d")),
        "documents": make("document_id int, job_id int", (10, 1), (11, 2), (12, None)),
        "jobs": make("job_id int", (1,), (2,)),
        "review_queue": make("item_id int, job_id int", (1, 1), (2, 2)),
        "shipments": make("shipment_id int", (7,), (8,)),
        "match_results": make("id int, shipment_id int", (1, 7), (2, 8)),
    }
    left = store.delete_jobs(tables, make("job_id int", (1,), (1,)))
    assert {n: sorted(map(tuple, t.collect()), key=repr) for n, t in left.items()} == {
        "extracted_fields": [(11, "b"), (12, "c"), (None, "d")], "documents": [(11, 2), (12, None)], "jobs": [(2,)],
        "review_queue": [(2, 2)], "shipments": [(7,), (8,)], "match_results": [(1, 7), (2, 8)],
    }
    left = store.delete_shipments(tables, make("shipment_id int", (8,)))
    assert [tuple(r) for r in left["match_results"].collect()] == [(1, 7)] and left["jobs"].count() == 2


def _first(key, entries, other="other"):
    key = (key or "").strip().lower()
    if not key:
        return other
    for synonym, name, _ in entries:
        if synonym == key:
            return name
    return next((n for s, n, _ in entries if s in key or key in s), other)


def test_labels_are_named_from_a_table_like_one_by_one(spark):
    rnd = random.Random(4)
    syllables = ["de", "ten", "tion", "lay", "o", "ver", "lum", "per", " ", "fee", "x"]
    made = {"".join(rnd.choices(syllables, k=rnd.randrange(1, 5))).strip() for _ in range(300)} - {""}
    entries = [(s, f"n{i % 9}", i) for i, s in enumerate(sorted(made, key=lambda _: rnd.random()))]
    labels = ["".join(rnd.choices(syllables, k=rnd.randrange(6))) for _ in range(400)] + [None, "", " ", "LAYOVER fee", "zzz", "é"]
    table = spark.createDataFrame(entries, "synonym string, name string, ord int")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(labels)], "i int, label string")
    got = {r["i"]: r["charge"] for r in vocabulary.with_names(rows, "label", table, ["i"]).collect()}
    assert got == {i: _first(t, entries) for i, t in enumerate(labels)}


def test_the_built_in_synonyms_as_a_table(spark):
    entries = [(s, n, i) for i, (s, n) in enumerate(CHARGE_SYNONYMS.items())]
    labels = ["Detention charge", "LUMPER", "waiting", "stop", "tarp fee please", "fuel", None, "hours of detention"]
    rows = spark.createDataFrame([(t,) for t in labels], "label string")
    table = spark.createDataFrame(entries, "synonym string, name string, ord int")
    both = vocabulary.with_names(rows, "label", table, ["label"]).withColumn("built_in", charge_type(F.col("label")))
    assert all(r["charge"] == r["built_in"] for r in both.collect())


@pytest.mark.parametrize("text", ["detention"])
def test_many_synonyms_need_no_nested_loop(spark, text):
    table = spark.range(100_000).select(
        F.concat(F.lit(text), F.col("id").cast("string")).alias("synonym"), F.lit("n").alias("name"), F.col("id").alias("ord")
    )
    labels = spark.createDataFrame([("pay detention77 now",), ("etention9999",), ("nothing",)], "label string")
    found = vocabulary.named_labels(labels, table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r["key"]: r["name"] for r in found.collect()} == {"pay detention77 now": "n", "etention9999": "n", "nothing": "other"}
