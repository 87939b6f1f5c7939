"""Joins of exploded rows do not depend on a size estimate, which counts them as the rows they come from."""

import pytest

from waybridge.llm import simhash


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, tmp_path):
    def put(name, query):
        spark.sql(query).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    return put


def test_masked_fingerprints_are_not_copied_to_the_driver(stored):
    links = simhash.covering_links(stored("fps", "SELECT * FROM VALUES (0L), (7L), (-1L) AS t(fp)"))
    assert "BroadcastHashJoin" not in plan(links) and "SortMergeJoin" in plan(links)
    assert [sorted(r) for r in links.collect()] == [[0, 7]]


def test_shingles_of_texts_are_not_copied_to_the_driver(stored, monkeypatch):
    tables = []
    monkeypatch.setattr(simhash, "materialized", lambda df, purpose: tables.append(df) or df)
    holders = stored(
        "holders", "SELECT * FROM VALUES (1L, 2L, array(5L, 6L)), (2L, 2L, array(5L, 6L)), (3L, 1L, array(9L)) AS t(c, all, sh)"
    )
    links = simhash._prefix_links(holders, 0.8)
    for table in (*tables, links):
        assert "BroadcastHashJoin" not in plan(table)
    assert [tuple(r) for r in links.collect()] == [(2, 1)]
