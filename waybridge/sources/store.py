"""Row-level changes to stored tables, written as whole-table transforms.

Every function returns the new content of a table; the caller writes it.  Keys
of change sets are unique unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybridge import vocab
from waybridge.operators.hotkeys import attach_per_key


@dataclass(frozen=True)
class ForeignKey:
    """Rows of ``child`` go with the row of ``parent`` whose key they name."""

    child: str
    column: str
    parent: str
    parent_column: str


FOREIGN_KEYS = (
    ForeignKey("documents", "job_id", "jobs", "job_id"),
    ForeignKey("extracted_fields", "document_id", "documents", "document_id"),
    ForeignKey("review_queue", "job_id", "jobs", "job_id"),
    ForeignKey("match_results", "shipment_id", "shipments", "shipment_id"),
)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as it is; the session's file settings decide on its splits."""
    return spark.read.parquet(path)


def all_of(*conditions: Column | None) -> Column:
    """The given conditions combined with AND; no condition at all keeps every row."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def equal_if(name: str, value) -> Column | None:
    return None if value is None else F.col(name) == value


def by_key(df: DataFrame, **key) -> DataFrame:
    """Rows with the given key values; the filters reach the file scan."""
    return df.filter(all_of(*[F.col(k) == v for k, v in key.items()]))


def row_id(*parts: str | Column) -> Column:
    """A repeatable identifier, so that a re-run task writes the same rows."""
    texts = [F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]
    return F.sha2(F.concat_ws("|", *[F.coalesce(t, F.lit("")) for t in texts]), 256)


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def delete_rows(table: DataFrame, doomed: DataFrame, on: Sequence[str]) -> DataFrame:
    return table.join(doomed.select(*on).distinct().hint("merge"), list(on), "left_anti")


def delete_cascade(
    tables: dict[str, DataFrame],
    doomed: dict[str, tuple[str, DataFrame]],
    foreign_keys: Sequence[ForeignKey] = FOREIGN_KEYS,
) -> dict[str, DataFrame]:
    """Remove rows and, by the declared keys, everything that hangs on them.

    ``doomed`` names for a table a column and a table with its doomed values.  Tables are
    walked from parents to children, each is read once per reason; a null key
    hangs on nothing.  Keys of tables that are not given are passed over.
    """
    known = [k for k in foreign_keys if k.child in tables and k.parent in tables]
    order = TopologicalSorter({name: {k.parent for k in known if k.child == name} for name in tables})
    out, gone = dict(tables), {}
    for name in order.static_order():
        reasons = []
        if name in doomed:
            column, values = doomed[name]
            reasons.append((column, values.select(F.col(column).alias("_gone"))))
        reasons += [
            (k.column, gone[k.parent].select(F.col(k.parent_column).alias("_gone"))) for k in known if k.child == name and k.parent in gone
        ]
        if not reasons:
            continue
        table, lost = tables[name], []
        for column, values in reasons:
            values = values.distinct().hint("merge")  # as many as rows: never copied to all tasks
            lost.append(table.join(values, F.col(column) == F.col("_gone"), "left_semi"))
            out[name] = out[name].join(values, F.col(column) == F.col("_gone"), "left_anti")
        gone[name] = reduce(DataFrame.unionByName, lost)
    return out


def delete_jobs(tables: dict[str, DataFrame], doomed_jobs: DataFrame) -> dict[str, DataFrame]:
    """Remove jobs and everything that belongs to them."""
    return delete_cascade(tables, {"jobs": ("job_id", doomed_jobs)})


def delete_shipments(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """Remove shipments and their match results."""
    return delete_cascade(tables, {"shipments": ("shipment_id", doomed)})


def update_rows(
    table: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]
) -> DataFrame:
    """Overwrite ``columns`` where the change set has a value, keep the old value elsewhere."""
    fresh = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = table.join(fresh, key, "left")
    return joined.select(
        *[
            F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c)
            for c in table.columns
        ]
    )


def update_job_status(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Set status and error; the completion time is set by final statuses only."""
    fresh = changes.select(
        "job_id",
        F.col("status").alias("_status"),
        F.col("error").alias("_error"),
        F.col("changed_at").alias("_changed_at"),
    )
    final = F.col("_status").isin(vocab.TERMINAL_STATUSES)
    return (
        jobs.join(fresh, "job_id", "left")
        .withColumn("status", F.coalesce("_status", "status"))
        .withColumn("error", F.coalesce("_error", "error"))
        .withColumn(
            "completed_at", F.when(final, F.col("_changed_at")).otherwise(F.col("completed_at"))
        )
        .drop("_status", "_error", "_changed_at")
    )


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per key; partial results are kept per task before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
    )


def upsert_latest(
    table: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Old and new rows merged, the newest row of a key winning."""
    return latest_by(table.unionByName(incoming), keys, order)


def live_entries(cache: DataFrame, as_of: Column) -> DataFrame:
    return cache.filter(F.col("ttl_expires_at") > as_of)


def expired_entries(cache: DataFrame, as_of: Column) -> DataFrame:
    return cache.filter(F.col("ttl_expires_at") <= as_of)


def count_usage(calls: DataFrame) -> DataFrame:
    """Requests and cache hits per provider, model and day."""
    return calls.groupBy("provider", "model", F.to_date("ts").alias("log_date")).agg(
        F.count("*").alias("request_count"),
        F.sum(F.col("is_cache_hit").cast("bigint")).alias("cache_hit_count"),
    )


def first_submissions(submissions: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Mark repeated submissions and name the job that answers each one.

    The first job of an (account, key) pair answers all later ones; submissions
    without a key never repeat.  ``existing`` holds jobs accepted before.
    """
    moment = F.struct("created_at", "job_id")
    keyed = submissions.filter(F.col("idempotency_key").isNotNull())
    free = submissions.filter(F.col("idempotency_key").isNull())
    if existing is not None:
        known = existing.filter(F.col("idempotency_key").isNotNull())
        keyed = keyed.withColumn("_old", F.lit(False)).unionByName(
            known.select(*submissions.columns).withColumn("_old", F.lit(True))
        )
    marked = attach_per_key(
        keyed,
        ["account_id", "idempotency_key"],
        ["job_id"],
        {"_first": (F.min(moment), F.min)},
    )
    if existing is not None:
        marked = marked.filter(~F.col("_old")).drop("_old")
    return (
        marked.withColumn("answer_job_id", F.col("_first.job_id"))
        .withColumn("idempotent_replay", F.col("answer_job_id") != F.col("job_id"))
        .drop("_first")
        .unionByName(
            free.withColumn("answer_job_id", F.col("job_id")).withColumn(
                "idempotent_replay", F.lit(False)
            )
        )
    )


def new_jobs(submissions: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Submissions that become jobs: one per (account, key), all those without a key."""
    keyed = submissions.filter(F.col("idempotency_key").isNotNull())
    free = submissions.filter(F.col("idempotency_key").isNull())
    pair = ["account_id", "idempotency_key"]
    rest = [c for c in submissions.columns if c not in pair]
    first = (
        keyed.groupBy(*pair)
        .agg(F.min_by(F.struct(*rest), F.struct("created_at", "job_id")).alias("_row"))
        .select(*pair, "_row.*")
    )
    if existing is not None:
        first = first.join(existing.select(*pair).distinct(), pair, "left_anti")
    return first.unionByName(free)
