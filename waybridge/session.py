"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import contextlib
import functools
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "waybridge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    ``master`` stays unset on a cluster; skew handling of joins is left to
    adaptive execution, which splits oversized partitions at run time.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="waybridge-")


def durable_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for one run inside the folder named by ``spark.checkpoint.dir``.

    The setting is read from the session, so that every executor sees the same
    storage.  Only a session in local mode may run without it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_root()
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")


@contextlib.contextmanager
def releasing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go when their write has ended.

    What they wrote stands in the shared folder, so nobody reads them again; without this they lie on the
    disks until the driver happens to collect its garbage, those of all stages of a job together.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialized(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """Write an intermediate table to the shared folder and go on from the copy.

    Used where a later step reads the same rows several times, so that they are
    computed once and a lost executor does not bring the whole history back.
    ``options`` go to the writer.
    """
    path = durable_dir(df.sparkSession, purpose)
    with releasing_shuffles(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
