from types import SimpleNamespace

import pytest

from waybridge.session import durable_dir, materialized


def _session(setting, master):
    conf = SimpleNamespace(get=lambda key, default=None: setting)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_written_tables_go_to_the_named_folder():
    assert durable_dir(_session("/shared/x", "spark://a"), "t").startswith("/shared/x/t-")
    first, second = (durable_dir(_session(None, "local[2]"), "t") for _ in range(2))
    assert first != second
    with pytest.raises(ValueError):
        durable_dir(_session(None, "spark://a"), "t")


def test_materialized_rows_are_unchanged(spark):
    df = spark.range(10).selectExpr("id", "cast(id as decimal(4,3)) / 10 as d", "array(id) as a")
    assert sorted(map(str, materialized(df, "t").collect())) == sorted(map(str, df.collect()))
