"""Language identification by rank-order profiles of character n-grams.

The most frequent n-grams of a language, in order, are its profile; a text is compared to
each profile by the out-of-place distance: how far every frequent n-gram of the text stands
from its place in the profile, and a fixed maximum where the profile does not have it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waybridge.llm.common import in_fold, read, texts, type_of

UNKNOWN = "und"
#: longest n-gram; three code points of 21 bits fill one 64-bit number
MAX_N = 3
#: n-grams of a profile, and of a text
PROFILE = 400


@functools.cache
def letter_table():
    """For every code point: its lower-case form if it is a letter, else 0.

    Built once on the driver; it travels with the functions that use it.
    """
    import numpy as np

    def low(i: int) -> int:
        c = chr(i)
        if not c.isalpha():
            return 0
        small = c.lower()
        return ord(small) if len(small) == 1 else i

    return np.fromiter(map(low, range(0x110000)), np.uint32, 0x110000)


def gram_codes(text: str, table):
    """Codes of all n-grams inside the words of a text, repeats included.

    A word is a run of letters, with one blank (0) before and after it.
    """
    import numpy as np

    points = table[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")].astype(np.int64)
    points = np.concatenate([[0], points, [0]])
    points = points[1:][(points[1:] != 0) | (points[:-1] != 0)]
    points = np.concatenate([[0], points])
    a, b = points[:-1], points[1:]
    two = (a << 21) | b
    inner = (b[:-1] != 0) & (points[2:] + a[:-1] != 0)
    three = ((two[:-1] << 21) | points[2:])[inner]
    return np.concatenate([b[b != 0], two[(a != 0) | (b != 0)], three])


def counted(codes):
    import numpy as np

    codes = np.sort(codes)
    if not len(codes):
        return codes, codes
    edge = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[edge], np.diff(np.append(edge, len(codes)))


def top_grams(codes, size: int):
    """The most frequent codes in order, ties by smaller code."""
    import numpy as np

    grams, n = counted(codes)
    if len(grams) > size:
        least = np.partition(n, len(n) - size)[len(n) - size]
        keep = n >= least
        grams, n = grams[keep], n[keep]
    return grams[np.lexsort((grams, -n))[:size]]


def profiles(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE
) -> DataFrame:
    """(lang, gram, rank): the profile of each language, rank from 0.

    N-grams are counted over all texts of the language; rows without language or text
    are passed over.  Counts are summed inside each task before they are shuffled.
    """

    table = letter_table()

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def emit(held: dict):
            for lang, parts in held.items():
                if parts:
                    grams, n = counted(np.concatenate(parts))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(grams), pa.string()),
                            pa.array(grams),
                            pa.array(n, pa.int64()),
                        ],
                        ["lang", "gram", "n"],
                    )

        held: dict = {}
        chars = 0
        for batch in batches:
            for lang, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.setdefault(lang, []).append(gram_codes(text, table))
                chars += len(text)
                if chars > 1_500_000:
                    yield from emit(held)
                    held, chars = {}, 0
        yield from emit(held)

    source = texts(docs, lang_col, text_col).filter(F.col("id").isNotNull())
    counts = (
        source.mapInArrow(work, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    order = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return (
        counts.withColumn("rank", F.row_number().over(order) - 1)
        .filter(F.col("rank") < size)
        .select("lang", "gram", "rank")
    )


def identify(
    docs: DataFrame,
    model: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = PROFILE,
    keep: tuple[str, ...] = (),
    with_text: bool = False,
) -> DataFrame:
    """(id, ``keep`` columns[, text], lang_pred, score): the nearest profile of each whole text.

    The score is 1 minus the distance relative to the greatest possible one; ties go to
    the language first in alphabetical order.  A null text, or one without a letter, is
    ``und`` with score 0; so is every text if the model is empty.  Each row gives one row.
    The model reaches the driver: ``size`` rows per language, whatever the corpus.
    """
    import numpy as np

    rows = model.orderBy("lang", "rank").collect()
    langs = sorted({r["lang"] for r in rows})
    grams = np.unique(np.array([r["gram"] for r in rows], np.int64))
    place = np.full((len(grams), len(langs)), -1, np.int64)
    for r in rows:
        place[np.searchsorted(grams, r["gram"]), langs.index(r["lang"])] = r["rank"]

    def nearest(text: str | None, table) -> tuple[str, float]:
        codes = gram_codes(text, table) if text and langs else ()
        if not len(codes):
            return UNKNOWN, 0.0
        top = top_grams(codes, size)
        at = np.minimum(np.searchsorted(grams, top), len(grams) - 1)
        known = grams[at] == top
        ranks = place[at]
        away = np.where(
            (ranks >= 0) & known[:, None], np.abs(ranks - np.arange(len(top))[:, None]), size
        )
        total = np.minimum(away, size).sum(axis=0)
        best = int(total.argmin())
        return langs[best], 1.0 - float(total[best]) / (size * len(top))

    table = letter_table()

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [nearest(t, table) for t in batch.column("text").to_pylist()]
            rest = batch.select(out)
            yield pa.RecordBatch.from_arrays(
                [
                    *rest.columns,
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                [*rest.schema.names, "lang_pred", "score"],
            )

    source = texts(docs, id_col, text_col, *keep)
    out = ["id", *keep, *(["text"] if with_text else [])]
    kinds = ", ".join(f"`{c}` {type_of(source, c)}" for c in out)
    return source.mapInArrow(work, f"{kinds}, lang_pred string, score double")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents in a language the model knows; ``documents`` columns stay as they are.

    Rejected are texts without a letter (or null) and texts that share no frequent n-gram
    with any profile.  Profiles are learned from the rows outside the held-out fold.
    """
    model = profiles(docs.filter(~in_fold(F.col("doc_id"), 4, 2)))
    columns = [c for c in docs.columns if c not in ("doc_id", "text")]
    aside = {c: f"_{i}" for i, c in enumerate(columns)}
    wide = docs.select("doc_id", "text", *[F.col(c).alias(a) for c, a in aside.items()])
    found = identify(wide, model, keep=tuple(aside.values()), with_text=True)
    back = {"doc_id": "id", "text": "text", **aside}
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") > 0)).select(
        *[F.col(back[c]).alias(c) for c in docs.columns]
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = in_fold(F.col("doc_id"), 4, 2)
    model = profiles(docs.filter(~held))
    found = identify(docs.withColumn("held_out", held), model, keep=("held_out",))
    return found.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score")


QUERIES = {"op9_language": op9_language}
SQL: dict[str, str] = {}
