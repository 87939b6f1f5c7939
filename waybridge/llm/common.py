"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``bytes.translate`` table that lower-cases A-Z and leaves every other byte alone
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def in_fold(key: Column, folds: int, fold: int) -> Column:
    """crc32 of the key's text falls on ``fold``; false for a null key."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(folds)) == fold, F.lit(False))


def type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


#: rows of an Arrow batch where the session leaves the number open
BATCH_ROWS = 500


def texts(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(id, ``more``, text) for Python workers, null texts as empty ones.

    Whole documents travel in Arrow batches; with the default of 10,000 rows one batch of
    long texts would fill a worker, so a session that has not chosen another size gets
    a smaller one.
    """
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(BATCH_ROWS))
    return docs.select(
        F.col(id_col).alias("id"), *more, or_empty(F.col(text_col)).alias("text")
    )


def byte_texts(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow text column; null becomes empty."""
    import pyarrow as pa

    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def copied_if_small(df: DataFrame, rows: int) -> DataFrame:
    """A written table as the copied side of a join if it has at most ``rows`` rows.

    The count is taken first; a larger table is left to the optimizer, which shuffles
    and splits both sides.  Results are the same either way.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with new columns, each computed once per row.

    The generator step keeps the optimizer from copying the expression to every place that
    uses the column, such as the body of a lambda.
    """
    for name, column in columns.items():
        df = df.select("*", F.explode(F.array(column)).alias(name))
    return df
