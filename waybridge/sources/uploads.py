"""Uploaded files: admission checks and stored bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybridge import vocab
from waybridge.operators.hotkeys import lookup

#: documents of a job from which its bytes are copied to several tasks
HEAVY_JOB = 10_000


def read_uploads(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Files under a folder as (path, modificationTime, length, content)."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )


def reject_code(length: Column, content: Column, limit: int = vocab.MAX_UPLOAD_BYTES) -> Column:
    """Why an upload is refused, null when it is accepted."""
    magic = F.substring(content, 1, 4) != F.unhex(F.lit(b"%PDF".hex()))
    return (
        F.when(length == 0, "invalid_pdf")
        .when(length > limit, "file_too_large")
        .when(magic, "invalid_pdf")
    )


def gate_uploads(
    uploads: DataFrame, limit: int = vocab.MAX_UPLOAD_BYTES, announced: DataFrame | None = None
) -> DataFrame:
    """Add ``reject_code`` to uploads.

    Spark's file readers pass over files without content.  ``announced``, a
    table with the path of every upload, brings those back as refused rows.
    """
    gated = uploads.withColumn("reject_code", reject_code(F.col("length"), F.col("content"), limit))
    if announced is None:
        return gated
    empty = announced.select("path").join(uploads.select("path"), "path", "left_anti")
    return gated.unionByName(
        empty.withColumn("length", F.lit(0).cast("bigint")).withColumn(
            "reject_code", F.lit("invalid_pdf")
        ),
        allowMissingColumns=True,
    )


def job_blob(job_blobs: DataFrame, job_id) -> DataFrame:
    """Stored bytes of one job; no other column is read."""
    return job_blobs.filter(F.col("job_id") == job_id).select("content")


def document_blobs(documents: DataFrame, job_blobs: DataFrame) -> DataFrame:
    """Stored bytes of the job each document was cut from."""
    return lookup(
        documents.select("document_id", "job_id"),
        job_blobs.select("job_id", "content"),
        ["job_id"],
        ["document_id"],
        how="inner",
        heavy=HEAVY_JOB,
    )
