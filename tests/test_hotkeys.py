import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waybridge.operators import hotkeys as hk


def _skewed(spark, n=3000):
    rnd = random.Random(3)
    rows = []
    counters = {}
    for i in range(n):
        key = 0 if rnd.random() < 0.5 else rnd.randrange(1, 200)
        counters[key] = counters.get(key, 0) + 1
        rows.append((key, counters[key], i, rnd.choice([None, None, "a", "b"]), rnd.randrange(9)))
    return spark.createDataFrame(rows, "k int, pos int, id int, v string, n int")


def _rows(df):
    return sorted(tuple(r) for r in df.fillna("-").collect())


def test_attach_per_key_equals_a_window(spark):
    df = _skewed(spark)
    w = W.partitionBy("k")
    want = df.withColumn("total", F.sum("n").over(w)).withColumn("first", F.min("id").over(w))
    got = hk.attach_per_key(
        df, ["k"], ["id"], {"total": (F.sum("n"), F.sum), "first": (F.min("id"), F.min)}, salts=7
    )
    assert _rows(got.select(want.columns)) == _rows(want)


def test_block_helpers_equal_plain_windows(spark):
    df = _skewed(spark).withColumn("_b", F.floor((F.col("pos") - 1) / 16))
    w = W.partitionBy("k").orderBy("pos")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    want = (
        df.withColumn("prev", F.lag("id").over(w))
        .withColumn("seen", F.last("v", True).over(w.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("seen_before", F.last("v", True).over(before))
        .withColumn("sum_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    )
    got = hk.previous_row(df, ["k"], "pos", "_b", ["id"], "p").withColumn("prev", F.col("p.id")).drop("p")
    got = hk.last_seen(got, ["k"], "pos", "_b", F.col("v"), "seen")
    got = hk.last_seen(got, ["k"], "pos", "_b", F.col("v"), "seen_before", inclusive=False)
    got = hk.running_total(got, ["k"], "pos", "_b", F.col("n"), "sum_before")
    assert _rows(got.select(want.columns).fillna(-1)) == _rows(want.fillna(-1))


def test_lookup_keeps_every_row(spark):
    df = _skewed(spark)
    right = df.select("k").distinct().filter("k % 3 = 0").withColumn("name", F.concat(F.lit("n"), "k"))
    want = df.join(right, "k", "left")
    got = hk.lookup(df, right, ["k"], ["id"], salts=5)
    assert _rows(got.select(want.columns)) == _rows(want)


def test_hot_key_is_spread(spark):
    """Half of all rows share a key, and no task of the salted grouping sees them all."""
    df = hk.salted(_skewed(spark), ["id"], 16)
    sizes = [r["count"] for r in df.groupBy("k", "_salt").count().collect()]
    assert max(sizes) < 3000 * 0.5 / 4
