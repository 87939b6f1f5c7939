"""Quality scores from two compression dictionaries.

Good and bad labelled texts each fill a zstandard dictionary.  A text is compressed with both;
the difference of the two sizes, divided by the text's own size, says which kind it resembles.
A logistic curve fitted on labelled texts outside the dictionaries turns it into a probability;
since two small sizes cannot differ much, the curve also sees the smaller size itself.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waybridge.llm.common import byte_texts, in_fold, read, texts, type_of
from waybridge.session import materialized

#: bytes of text in each dictionary
DICTIONARY = 1 << 20
LEVEL = 3
#: labelled rows of each class looked at to fill a dictionary
SAMPLE = 2000
#: values of the normalised difference at which labelled texts are counted
BINS = 400
THRESHOLD = 0.3


def dictionary(docs: DataFrame, chosen: DataFrame, size: int = DICTIONARY) -> bytes:
    """Raw dictionary content: whole texts of the chosen rows in hash order, ``size`` bytes
    at most; texts that do not fit any more are passed over.

    ``chosen`` (id) holds a bounded sample, so it is copied to the tasks that look for it.
    """
    found = docs.join(F.broadcast(chosen), "id").select("id", "text", F.octet_length("text").alias("n"))
    turn = W.orderBy(F.xxhash64("id", F.lit(7)), "id", "n").rowsBetween(W.unboundedPreceding, 0)
    rows = (
        found.filter(F.col("n").between(1, size // 8))
        .withColumn("total", F.sum("n").over(turn))
        .filter(F.col("total") <= size)
        .orderBy("total")
        .select("text")
        .collect()
    )
    return b"\n".join(r["text"].encode() for r in rows) or b"\n"


def differences(docs: DataFrame, good: bytes, bad: bytes, level: int = LEVEL) -> DataFrame:
    """(id, x, y): per byte of text, what the bad dictionary costs more than the good one, and
    the smaller of both sizes (1 at most; 0.5 for an empty text)."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        coders = []
        for content in (good, bad):
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=level)
            coders.append(
                zstandard.ZstdCompressor(
                    dict_data=known, level=level, write_content_size=False, write_dict_id=False
                )
            )
        for batch in batches:
            out, least = [], []
            for text in byte_texts(batch.column("text")):
                kind, other = (len(c.compress(text)) for c in coders)
                out.append((other - kind) / len(text) if text else 0.0)
                least.append(min(1.0, min(kind, other) / len(text)) if text else 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(out, pa.float64()), pa.array(least, pa.float64())],
                ["id", "x", "y"],
            )

    return docs.select("id", "text").mapInArrow(
        work, f"id {type_of(docs, 'id')}, x double, y double"
    )


def logistic(counted: list[tuple[float, float, int, int]]) -> tuple[float, float, float]:
    """(a, b, c) of 1/(1+exp(-(a+b*x+c*y))) for rows of (x, y, label, number), lightly held back.

    Without any row the score is one half; with one class it leans to that class.
    """
    import numpy as np

    if not counted:
        return 0.0, 0.0, 0.0
    x, z, y, n = (np.array(c, float) for c in zip(*counted, strict=True))
    design = np.stack([np.ones_like(x), x, z], axis=1)
    w = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        held = np.array([1e-2, 1e-4, 1e-4])
        grad = design.T @ (n * (y - p)) - held * w
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag(held)
        step = np.linalg.solve(hess, grad)
        w += step * min(1.0, 20.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1]), float(w[2])


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    size: int = DICTIONARY,
    sample: int = SAMPLE,
    level: int = LEVEL,
    bins: int = BINS,
) -> DataFrame:
    """(id, score): the probability of label 1 for every row of ``docs``.

    ``labels`` (id, label 0 or 1) are all that is learned from: half of them, by a hash, may
    fill the dictionaries (``sample`` rows and ``size`` bytes a class at most), the other
    half is counted by classes of the difference (``bins`` to one) and of the size (100) to
    fit the curve.  Rows with null
    or other labels are passed over; of contradicting labels the smaller one holds.  Null
    and empty texts have difference 0.  Every row gives one row.
    """
    known = (
        labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label_col).alias("label"))
        .withColumn("half", F.pmod(F.xxhash64("id"), F.lit(2)))
    )
    source = texts(docs, id_col, text_col)

    def chosen(label: int) -> DataFrame:
        rows = known.filter((F.col("half") == 0) & (F.col("label") == label))
        return rows.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(sample).select("id")

    good, bad = (dictionary(source, chosen(label), size) for label in (1, 0))
    found = materialized(differences(source, good, bad, level), "differences")
    spread = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "x")) * bins) / bins
    counted = (
        found.join(known.filter("half = 1"), "id")
        .groupBy(spread.alias("x"), F.round("y", 2).alias("y"), "label")
        .agg(F.count("*").alias("n"))
        .collect()
    )
    a, b, c = logistic([(r["x"], r["y"], r["label"], r["n"]) for r in counted])
    line = F.lit(a) + F.lit(b) * F.col("x") + F.lit(c) * F.col("y")
    return found.select("id", (1 / (1 + F.exp(-line))).alias("score"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    learn = labels.filter(~in_fold(F.col("doc_id"), 5, 0))
    return quality_scores(docs, learn).select(
        F.col("id").alias("doc_id"),
        in_fold(F.col("id"), 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES = {"op6_quality": op6_quality}
SQL: dict[str, str] = {}
