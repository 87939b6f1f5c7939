"""Tables of a vocabulary are sorted and merged, none is copied whole."""

import random

from waybridge.operators import vocabulary


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_table_of_the_vocabulary_is_copied_whole(spark):
    labels = spark.createDataFrame([("Fuel surcharge",), ("tolls",), (None,)], "label string")
    entries = spark.createDataFrame([("fuel", "fuel", 1), ("toll", "toll", 2)], "synonym string, name string, ord int")
    out = vocabulary.named_labels(labels, entries)
    assert "BroadcastHashJoin" not in plan(out)
    got = {r["key"]: r["name"] for r in out.collect()}
    assert got == {"fuel surcharge": "fuel", "tolls": "toll", "": "other"}


def test_few_pairs_are_checked_beyond_those_that_fit(spark):
    # the last digits of a number do not tell one entry from another, and pairs would grow with the square
    names = [(f"charge {n:07d}", n) for n in range(2000)]
    entries = spark.createDataFrame(names, "synonym string, ord int")
    keys = spark.createDataFrame([(n, f"late {name} again") for name, n in names], "k long, key string")
    pairs = vocabulary.candidates(keys, entries)
    assert pairs.filter("k = ord").count() == 2000 and pairs.count() < 4000


def test_names_are_those_of_all_pairs(spark):
    rng = random.Random(3)

    def text(longest):
        return "".join(rng.choice("abéß ") for _ in range(rng.randrange(longest)))

    labels = [text(16) for _ in range(300)] + ["", None, "  "]
    table = [(text(6), f"n{i}", i) for i in range(60)] + [(text(14), f"n{i}", i) for i in range(60, 200)]
    table += [(None, "none", 200), (labels[0], "copy", 201)]
    out = vocabulary.named_labels(
        spark.createDataFrame([(x,) for x in labels], "label string"),
        spark.createDataFrame(table, "synonym string, name string, ord int"),
    )
    got = {r["key"]: r["name"] for r in out.collect()}
    cut = [(s.strip(" ").lower(), n, o) for s, n, o in table if s and s.strip(" ")]
    want = {}
    for key in {(x or "").strip(" ").lower() for x in labels}:
        fits = [(s != key, o, n) for s, n, o in cut if key and (s in key or key in s)]
        want[key] = min(fits)[2] if fits else "other"
    assert got == want
