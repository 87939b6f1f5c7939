"""License texts in documents by diagonal voting over word k-grams.

Every run of k words of a document is joined by hash to its places in the license
templates.  A hit votes for the diagonal (document position minus template position); hits of
neighbouring diagonals belong to one span with a few words put in or left out.  Votes come from
equal words, not only equal hashes, so the words under a span's hits are a lower bound of
what document and template share, and a span counts by the share of the template covered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waybridge.llm.common import lower_ascii, once, or_empty, read
from waybridge.session import materialized

K = 2
#: diagonals this far apart may belong to one span
SLACK = 3
#: share of a template's words that a span must cover ...
COVER = 0.75
#: ... where the template has so many words; shorter ones differ by a word and must be whole
WHOLE_BELOW = 8
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: phrases that must be found in full, wherever they stand
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: further templates; a span covers enough of one of them to earn the label
TEMPLATES = (
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("boost software license", "bsl"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("creative commons attribution share alike", "cc-by-sa"),
    ("creative commons attribution", "cc-by"),
    ("creative commons zero", "cc0"),
    ("bsd 2 clause license", "bsd"),
    ("bsd 3 clause license", "bsd"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this program is free software you can redistribute it and or modify it under the terms of", "gpl"),
)


def words(text: Column) -> Column:
    """A-Z in lower case, cut at everything that is neither letter nor digit."""
    return F.filter(F.split(lower_ascii(or_empty(text)), GAP), lambda w: w != "")


def _grams(tokens: Column, k: int) -> Column:
    last = F.size(tokens) - k
    at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0))))
    return F.transform(
        at,
        lambda i: F.struct(
            i.alias("pos"), F.xxhash64(*[F.get(tokens, i + j) for j in range(k)]).alias("h")
        ),
    )


def template_places(
    spark: SparkSession, templates: Sequence[tuple[str, str, bool]], k: int = K
) -> DataFrame:
    """(h, place, tpl, size, label, exact): every k-gram of every template, one row each.

    As large as the templates, which are given in the program; it is copied to all tasks.
    """
    values = F.array(
        *[
            F.struct(F.lit(n).alias("tpl"), F.lit(t).alias("t"), F.lit(label).alias("label"), F.lit(e).alias("exact"))
            for n, (t, label, e) in enumerate(templates)
        ]
    )
    rows = spark.range(1, numPartitions=1).select(F.inline(values))
    cut = once(rows, c=words(F.col("t")))
    return cut.select(
        "tpl", "label", "exact", F.size("c").alias("size"), F.explode_outer(_grams(F.col("c"), k)).alias("g")
    ).select("tpl", "label", "exact", "size", F.col("g.pos").alias("place"), F.col("g.h").alias("h"))


def license_hits(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: Sequence[tuple[str, str]] = BASE,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    k: int = K,
) -> DataFrame:
    """(id, th, pos, tpl, label, exact, size, place): k-grams that some template has.

    ``th`` is the hash of the text, so that rows with one id and different texts stay
    apart.  One more row per document, without ``tpl``, has its number of words as
    ``pos``.  Texts are read once, and only hits leave the scan.  Templates have k words at least.
    """
    listed = [(t, label, True) for t, label in base] + [(t, label, False) for t, label in templates]
    places = F.broadcast(materialized(template_places(docs.sparkSession, listed, k), "templates"))
    source = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")
    )
    none = F.lit(None).cast("long").alias("h")
    count = F.array(F.struct(F.size("c").alias("pos"), none))
    grams = F.concat(count, F.coalesce(_grams(F.col("c"), k), F.slice(count, 1, 0)))
    spread = (
        once(source, c=words(F.col("text")))
        .select("id", "th", F.explode_outer(grams).alias("g"))
        .select("id", "th", F.col("g.pos").alias("pos"), F.col("g.h").alias("h"))
    )
    met = spread.join(places, "h", "left").filter(F.col("h").isNull() | F.col("tpl").isNotNull())
    return met.select("id", "th", "pos", "tpl", "label", "exact", "size", "place")


def license_spans(
    hits: DataFrame, k: int = K, slack: int = SLACK, cover: float = COVER
) -> DataFrame:
    """(id, th, tpl, label, exact, first, last, covered): verified spans of ``license_hits``.

    Repeated rows vote once.  ``first`` and ``last`` are word positions from 0, ``covered``
    the share of the template's words under the span's hits.  A base phrase counts in
    full on one diagonal only, and so must templates of under 8 words.
    """
    whole = F.col("exact") | (F.col("size") < WHOLE_BELOW)
    # votes of a diagonal: one row per place of the template that was hit on it
    votes = (
        hits.filter(F.col("tpl").isNotNull())
        .withColumn("d", F.col("pos") - F.col("place"))
        .groupBy("id", "th", "tpl", "label", "exact", "size", "d")
        .agg(F.collect_set("place").alias("at"))
    )
    near = W.partitionBy("id", "th", "tpl").orderBy("d")
    # diagonals in order; a gap above the slack opens a new span, a whole phrase always does
    spans = (
        votes.withColumn("_new", F.coalesce(F.col("d") - F.lag("d").over(near) > slack, F.lit(True)) | whole)
        .withColumn("_span", F.sum(F.col("_new").cast("int")).over(near))
        .groupBy("id", "th", "tpl", "label", "exact", "size", "_span")
        .agg(
            F.min(F.col("d") + F.array_min("at")).alias("first"),
            F.max(F.col("d") + F.array_max("at")).alias("_last"),
            F.array_distinct(F.flatten(F.collect_set("at"))).alias("at"),
        )
    )
    under = F.size(
        F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + F.lit(k - 1)))))
    )
    return (
        spans.withColumn("last", F.col("_last") + (k - 1))
        .withColumn("covered", under / F.col("size"))
        .filter(
            F.when(whole, F.size("at") == F.col("size") - (k - 1)).otherwise(F.col("covered") >= cover)
        )
        .select("id", "th", "tpl", "label", "exact", "first", "last", "covered")
    )


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, places of base phrases, labels and a score.

    The score is the greatest share of a template covered, 0 without a span.  Every row
    gives one row; null and empty texts have no words and no labels.  What meets in a group is
    one text's hits of one template.
    """
    hits = materialized(license_hits(docs, id_col, text_col), "hits")
    base = F.col("exact")
    per_doc = license_spans(hits).groupBy("id", "th").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.least(F.max("covered"), F.lit(1.0)).alias("score"),
    ).withColumnsRenamed({"id": "_id", "th": "_th"})
    plain = hits.filter(F.col("tpl").isNull()).select("id", "th", F.col("pos").cast("long").alias("n_words"))
    joined = plain.join(
        per_doc, plain["id"].eqNullSafe(per_doc["_id"]) & (plain["th"] == per_doc["_th"]), "left"
    )
    return joined.select(
        "id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op1_license_scan": op1_license_scan}
SQL: dict[str, str] = {}
