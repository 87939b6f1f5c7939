"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and odd columns."""

import glob
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from waybridge.llm import (
    classlm,
    decontaminate,
    htmltext,
    language,
    license,
    lines,
    packing,
    quality,
    search,
    simhash,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, h string, n int"
PROSE = "Several plain words make a line of text that says little but goes on for a while and ends here."
ROWS = [
    (1, PROSE, "en", "a"),
    (1, PROSE, "en", "a"),
    (2, None, "en", None),
    (3, "", None, "a"),
    (4, " \n\t ", "de", "a"),
    (None, "no id here", "de", "b"),
    (5, "lang " * 60_000, "de", "b"),
    (6, "一二三 \U0001f600 naïve ÉTÉ\x00x\x1f", "fr", "b"),
    (7, "Released under the MIT License. CC BY\nApache License", None, None),
    (8, PROSE + " more", None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, "w", "h", 1) for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (4, 0), (5, 0), (6, 1), (None, 1), (7, None)], "doc_id long, quality int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(0, PROSE), (1, None), (2, "too short")], "item_id long, text string")


def _operators(docs, labels, bench):
    return {
        "license": (license.license_scan(docs), 10),
        "lm": (classlm.class_model_scores(docs, F.lit(True), steps=2), 9),
        "simhash": (simhash.simhash_components(docs), 10),
        "near": (simhash.near_duplicates(docs), 10),
        "kept": (simhash.drop_near_duplicates(docs), None),
        "lines": (lines.drop_boilerplate(docs), 10),
        "quality": (quality.quality_scores(docs, labels), 10),
        "language": (language.identify(docs, language.profiles(docs)), 10),
        "identified": (language.keep_identified(docs), None),
        "leaks": (decontaminate.contaminated(docs, bench), 2),
        "clean": (decontaminate.drop_contaminated(docs, bench), 7),
        "packed": (packing.pack_documents(docs), None),
    }


def test_odd_rows(docs, labels, bench):
    for name, (df, rows) in _operators(docs, labels, bench).items():
        got = df.count()
        assert rows is None or got == rows, (name, got)


def test_empty_tables(docs, labels, bench):
    none = docs.limit(0)
    for name, (df, _) in _operators(none, labels.limit(0), bench.limit(0)).items():
        assert df.count() == 0, name
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_pipeline_functions_keep_columns(spark, docs, bench, tmp_path):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


def test_html_edges(spark):
    pages = spark.createDataFrame(
        [(1, None), (2, ""), (3, "<p>"), (4, "<div><p>only <b>some</b> words&nbsp;here<br>now"), (5, "<!-- open"), (6, "a < b")],
        "page_id long, html string",
    )
    weights = htmltext.learn_weights(pages)
    got = {r["id"]: r["text"] for r in htmltext.extract_main(pages, weights).collect()}
    assert got[1] == got[2] == got[3] == got[5] == ""
    assert got[4] == "only some words here now"


def test_vector_edges(spark):
    inf = float("inf")
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (1, [1.0, None]), (2, None), (3, [inf, 0.0]), (4, [0.5, 0.5]), (5, [0.5, 0.5]),
            (6, []), (None, [1.0, 1.0]), (20, [2e30, 1.0])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, score int")
    got = search.top_k(df, F.col("id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()
    first = [(r["vec_id"], r["rank"]) for r in got if r["query_id"] == 0]
    assert first == [(20, 1), (4, 2), (5, 3)]
    assert search.top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_copies_are_of_fixed_or_counted_size():
    """Broadcast hints stand only where the size has a bound: a counted table, program text, a sample."""
    root = os.path.dirname(license.__file__)
    found = {os.path.basename(p): open(p).read().count("broadcast(") for p in glob.glob(f"{root}/*.py")}
    assert {k: v for k, v in found.items() if v} == {"common.py": 1, "license.py": 1, "quality.py": 1, "trie.py": 1}
    for p in [*glob.glob(f"{root}/*.py"), corpus_pipeline.__file__]:
        body = open(p).read()
        assert "localCheckpoint" not in body and "crossJoin" not in body, p
