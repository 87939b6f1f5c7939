"""The near-duplicate stage links texts by SimHash fingerprints as well as by shingles."""

import random

import corpus_pipeline
from waybridge.llm import simhash


def test_stage_drops_what_fingerprints_link(spark):
    # every eighth word differs: the sets of shingles are far apart, the fingerprints need not be
    rng = random.Random(5)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(50)}" for _ in range(120)]
        rows.append((2 * i, " ".join(words)))
        words[rng.randrange(120)] = "other"
        words[rng.randrange(120)] = "thing"
        words[rng.randrange(120)] = "third"
        rows.append((2 * i + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    linked = {r["id"]: r["component"] for r in simhash.simhash_components(docs).collect()}
    exact = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    by_print = {i for i, c in linked.items() if i != c}
    assert by_print & exact and not by_print & kept
    assert kept == exact - by_print
