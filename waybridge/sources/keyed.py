"""Stored tables in buckets of their key, of which a change rewrites only those it touches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybridge.sources.store import delete_rows, latest_by, update_rows

BUCKET, REAL = "bucket", "_row"


class KeyedTable:
    """A Parquet table under ``path``, one folder per bucket of the hashed ``keys``.

    Changes read and replace the touched buckets by dynamic partition overwrite, which swaps
    finished folders in; files of other buckets keep their names.  A bucket that loses its last row
    keeps a marker, so that it is replaced like any other.  One change at a time: tables
    have no lock.  ``buckets`` is fixed when the table is made; choose it so that a bucket
    fits in a task.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets

    def bucket(self) -> Column:
        """The bucket of a row; null keys have one, too."""
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().filter(REAL).drop(REAL, BUCKET)

    def by_key(self, **key) -> DataFrame:
        """Rows with these key values, read from their bucket alone."""
        at = self.spark.range(1).select(*(F.lit(key[k]).cast(self._kind(k)).alias(k) for k in self.keys))
        number = at.select(self.bucket()).first()[0]
        rows = self._stored().filter((F.col(BUCKET) == number) & F.col(REAL))
        for name, value in key.items():
            rows = rows.filter(F.col(name).eqNullSafe(F.lit(value)))
        return rows.drop(REAL, BUCKET)

    def _kind(self, name: str) -> str:
        return self._stored().schema[name].dataType.simpleString()

    def _write(self, rows: DataFrame, touched: list[int] | None) -> None:
        placed = rows.withColumn(REAL, F.lit(True)).withColumn(BUCKET, self.bucket())
        if touched is not None:
            marks = self.spark.createDataFrame([(b,) for b in touched], f"{BUCKET} int").withColumn(REAL, F.lit(False))
            placed = placed.unionByName(marks, allowMissingColumns=True)
        number = self.buckets if touched is None else max(1, len(touched))
        placed.repartition(number, BUCKET).write.mode("overwrite").option(
            "partitionOverwriteMode", "static" if touched is None else "dynamic"
        ).partitionBy(BUCKET).parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        """Make the table, or replace it as a whole."""
        self._write(rows, None)

    def _change(self, by: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Replace the buckets of ``by`` by what ``change`` makes of their rows; their numbers."""
        touched = sorted(r[0] for r in by.select(self.bucket().alias(BUCKET)).distinct().collect())
        if touched:
            old = self._stored().filter(F.col(BUCKET).isin(touched) & F.col(REAL)).drop(REAL, BUCKET)
            self._write(change(old), touched)
        return touched

    def upsert(self, rows: DataFrame, order: Sequence[str]) -> list[int]:
        """Add rows; of one key the newest by ``order`` stays.  The touched buckets."""
        return self._change(rows, lambda old: latest_by(old.unionByName(rows.select(*old.columns)), self.keys, order))

    def update(self, changes: DataFrame, columns: Sequence[str]) -> list[int]:
        """Overwrite ``columns`` where a change has a value; the table has one key column."""
        (key,) = self.keys
        return self._change(changes, lambda old: update_rows(old, changes, key, columns))

    def delete(self, doomed: DataFrame) -> list[int]:
        """Remove the rows with the keys of ``doomed``."""
        return self._change(doomed, lambda old: delete_rows(old, doomed, self.keys))

    def add(self, counts: DataFrame, columns: Sequence[str]) -> list[int]:
        """Add the numbers of ``counts`` to the counters of their keys; new keys start at them."""
        def summed(old: DataFrame) -> DataFrame:
            both = old.unionByName(counts.select(*old.columns))
            return both.groupBy(*self.keys).agg(*(F.sum(c).alias(c) for c in columns)).select(*old.columns)

        return self._change(counts, summed)
