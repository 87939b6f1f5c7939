"""Cases that a cut of the work would lose."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from waybridge.llm import simhash


def _shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_no_pair_at_the_threshold_is_missed(spark):
    rnd = random.Random(11)
    words = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(300)]
    texts, pairs = {}, 0
    for i in range(120):
        base = rnd.choices(words, k=rnd.choice([14, 34, 60, 200, 700]))
        near = [*base]
        for _ in range(max(1, len(base) // 60)):
            near[rnd.choice([0, len(near) - 1, rnd.randrange(len(near))])] = "changed"
        texts[i], texts[500 + i] = " ".join(base), " ".join(near)
    own = {k: _shingles(t) for k, t in texts.items()}
    root = {k: k for k in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b]):
                pairs += 1
                x, y = sorted((root[a], root[b]))
                root = {k: x if r == y else r for k, r in root.items()}
    assert pairs > 60
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = dict(map(tuple, simhash.near_duplicates(df).select("id", "group").collect()))
    assert got == root


def test_a_group_of_copies_keeps_the_text_of_its_survivor(spark):
    """Two groups of copies above the ratio in one source, whose footer is boilerplate all the same."""

    def text(i):
        return "\n".join([*(f"line {j} of {i} says number {i * j}" for j in range(6)), "the footer"])

    rows = [(i, text(0)) for i in range(30)] + [(i, text(1)) for i in range(30, 60)]
    rows += [(i, text(i)) for i in range(60, 200)]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.near_dedup):
        df = stage(spark, df, "")
    kept = {r["doc_id"]: r["text"] for r in df.collect()}
    assert kept[0] == text(0).removesuffix("\nthe footer")
    assert kept[30] == text(1).removesuffix("\nthe footer")
    assert all("footer" not in t for t in kept.values())


def test_an_id_on_two_texts_loses_only_the_copy(spark):
    rnd = random.Random(2)
    a, b = (" ".join(rnd.choices("abcdefgh", k=40)) for _ in range(2))
    rows = [(3, b), (5, a), (5, b), (7, a), (8, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t1", F.lit(1))
    kept = sorted((r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(df).collect())
    assert kept == sorted([(3, b), (5, a)])
