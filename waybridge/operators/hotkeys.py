"""Group-wise building blocks that stay balanced when one key owns much of the data.

A plain window sends a whole key to one task.  Here a key is cut into parts
first (by a hash, or by ranges of the ordering column), each part is worked on
by itself, and only one summary row per part is looked at together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEFAULT_SALTS = 64


def _same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """The right side with its keys set aside, and the condition that keys agree, null with null."""
    aside = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same &= left[k].eqNullSafe(aside[f"_r_{k}"])
    return aside, same


def _meet(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that keeps rows whose keys are null."""
    aside, same = _same_keys(left, right, keys)
    return left.join(aside, same).drop(*[f"_r_{k}" for k in keys])


def salted(df: DataFrame, spread: Sequence[str], salts: int = DEFAULT_SALTS) -> DataFrame:
    return df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))


def attach_per_key(
    df: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    aggs: dict[str, tuple[Column, Callable[[Column], Column]]],
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """Add key-wide aggregates to every row.

    ``aggs`` maps a new column to (aggregate over rows, function merging the
    partial results).  Rows meet their totals on (key, salt), so the largest
    task sees 1/salts of the largest key.  Null keys are keys like any other.
    """
    rows = salted(df, spread, salts)
    partial = rows.groupBy(*keys, "_salt").agg(*[a.alias(n) for n, (a, _) in aggs.items()])
    per_key = W.partitionBy(*keys)
    totals = partial.select(
        *keys, "_salt", *[merge(F.col(n)).over(per_key).alias(n) for n, (_, merge) in aggs.items()]
    )
    return _meet(rows, totals, [*keys, "_salt"]).drop("_salt")


def lookup(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    salts: int = DEFAULT_SALTS,
    heavy: int | None = None,
) -> DataFrame:
    """Join each left row to its single right row, however often a key repeats on the left.

    The right side (unique per key) is copied only to the (key, salt) pairs that
    occur on the left, so a rare key is copied once and a frequent one ``salts``
    times at most.  Where right rows are large, ``heavy`` saves copies: only keys of so many
    left rows are spread then, the others stay together.
    """
    rows = salted(left, spread, salts)
    if heavy is not None:
        counted = attach_per_key(left, keys, spread, {"_n": (F.count("*"), F.sum)}, salts)
        # null keys meet nothing, so they may stand anywhere
        alone = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
        kept = F.when((F.col("_n") >= heavy) | alone, F.col("_salt")).otherwise(0)
        rows = salted(counted, spread, salts).withColumn("_salt", kept).drop("_n")
    needed = rows.select(*keys, "_salt").distinct()
    placed = needed.join(right, list(keys))
    return rows.join(placed, [*keys, "_salt"], how).drop("_salt")


def _summaries(df: DataFrame, keys: Sequence[str], block: str, agg: Column) -> DataFrame:
    return df.groupBy(*keys, block).agg(agg.alias("_part"))


def previous_row(
    df: DataFrame, keys: Sequence[str], order: str, block: str, cols: Sequence[str], name: str
) -> DataFrame:
    """Add ``name``: a struct of ``cols`` from the row just before, null on the first row."""
    packed = F.struct(*cols)
    inside = W.partitionBy(*keys, block).orderBy(order)
    across = W.partitionBy(*keys).orderBy(block)
    carry = _summaries(df, keys, block, F.max_by(packed, F.col(order))).select(
        *keys, block, F.lag("_part").over(across).alias("_carry")
    )
    return (
        _meet(df.withColumn("_near", F.lag(packed).over(inside)), carry, [*keys, block])
        .withColumn(name, F.coalesce("_near", "_carry"))
        .drop("_near", "_carry")
    )


def last_seen(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    block: str,
    value: Column,
    name: str,
    inclusive: bool = True,
) -> DataFrame:
    """Add ``name``: the latest non-null ``value`` up to (or strictly before) each row."""
    inside = (
        W.partitionBy(*keys, block)
        .orderBy(order)
        .rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    )
    across = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    marked = df.withColumn("_value", value)
    latest = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order)))
    carry = _summaries(marked, keys, block, latest).select(
        *keys, block, F.last("_part", ignorenulls=True).over(across).alias("_carry")
    )
    near = marked.withColumn("_near", F.last("_value", ignorenulls=True).over(inside))
    return (
        _meet(near, carry, [*keys, block])
        .withColumn(name, F.coalesce("_near", "_carry"))
        .drop("_near", "_carry", "_value")
    )


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, block: str, value: Column, name: str
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows strictly before each row."""
    inside = W.partitionBy(*keys, block).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    marked = df.withColumn("_value", value)
    carry = _summaries(marked, keys, block, F.sum("_value")).select(
        *keys, block, F.coalesce(F.sum("_part").over(across), F.lit(0)).alias("_carry")
    )
    near = marked.withColumn("_near", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return (
        _meet(near, carry, [*keys, block])
        .withColumn(name, F.col("_near") + F.col("_carry"))
        .drop("_near", "_carry", "_value")
    )
