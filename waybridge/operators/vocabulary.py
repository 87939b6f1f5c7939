"""Names for free labels from a vocabulary table of any size.

A text that stands inside another one has all its substrings of one size (grams) in common
with it.  So each contained side gives one gram, the one that fewest entries have, and meets
all grams of that size of the other side by an equality join; what meets is checked for real.
Grams are long enough to be rare among millions of texts and travel as hashes, for equal
hashes of other grams only add something to check.
Every table here grows with the labels or the vocabulary, however short its files are, so
the joins sort both sides and none of them is copied whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybridge.functions.values import trimmed
from waybridge.operators.hotkeys import lookup
from waybridge.session import materialized

#: characters of a gram; shorter texts are their own gram
GRAM = 8


def gram_size(text: Column) -> Column:
    return F.least(F.length(text), F.lit(GRAM))


def _hashed(text: Column, size: Column) -> Column:
    """Hashes of the substrings of one size; the text has at least that size."""
    places = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.transform(places, lambda i: F.xxhash64(F.substring(text, i, size)))


def grams(text: Column, sizes: Sequence[int]) -> Column:
    """Hashes of all distinct substrings of the given sizes."""
    none = F.array().cast("array<bigint>")
    of = [F.when(F.length(text) >= n, _hashed(text, F.lit(n))).otherwise(none) for n in sizes]
    return F.array_distinct(F.concat(none, *of))


def own_grams(text: Column) -> Column:
    """Hashes of the substrings of the greatest gram size that the text has."""
    return F.array_distinct(_hashed(text, gram_size(text)))


def sizes_of(texts: DataFrame, text: str) -> list[int]:
    """The gram sizes that the texts have, ``GRAM`` numbers at most."""
    return sorted(r[0] for r in texts.select(gram_size(F.col(text))).distinct().collect())


def key_of(label: Column) -> Column:
    return F.lower(trimmed(label))


def candidates(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """(k, ord) of every key and synonym of which one may stand inside the other, and few more.

    ``keys``: (k, key); ``entries``: (synonym, ord); no text is empty.
    """
    inner, outer = sizes_of(entries, "synonym"), sizes_of(keys, "key")
    common = (
        entries.select(F.explode(grams(F.col("synonym"), sorted({*inner, *outer}))).alias("gram"))
        .groupBy("gram")
        .agg(F.count("*").alias("n"))
    )
    common = materialized(common, "gram-counts")

    def rarest(df: DataFrame, text: str, *key: str) -> DataFrame:
        """(key, gram): of each text the gram that fewest synonyms have; none has fewest of all."""
        each = df.select(*key, F.explode(own_grams(F.col(text))).alias("gram"))
        return (
            each.join(common.hint("merge"), "gram", "left")
            .groupBy(*key)
            .agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
        )

    inside = (
        keys.select("k", F.explode(grams(F.col("key"), inner)).alias("gram"))
        .join(rarest(entries, "synonym", "ord", "synonym").hint("merge"), "gram")
        .select("k", "ord")
    )
    postings = entries.select("ord", F.explode(grams(F.col("synonym"), outer)).alias("gram"))
    around = rarest(keys, "key", "k").join(postings.hint("merge"), "gram").select("k", "ord")
    return inside.unionByName(around).distinct()


def named_labels(labels: DataFrame, vocabulary: DataFrame, other: str = "other") -> DataFrame:
    """(key, name) for the distinct keys (see ``key_of``) of ``labels``.

    ``labels``: (label); ``vocabulary``: (synonym, name, ord), ``ord`` being unique.  An equal
    synonym wins, otherwise the first by ``ord`` that contains the key or is contained in
    it, otherwise ``other``; null and blank labels are ``other``.
    """
    keys = labels.select(F.coalesce(key_of(F.col("label")), F.lit("")).alias("key")).distinct()
    # keys go by numbers while they meet the vocabulary; written once, so every reader sees the same
    keys = materialized(keys.withColumn("k", F.monotonically_increasing_id()), "label-keys")
    entries = materialized(
        vocabulary.select(key_of(F.col("synonym")).alias("synonym"), "name", "ord").filter("synonym <> ''"),
        "vocabulary",
    )
    filled = keys.filter("key <> ''")
    met = candidates(filled, entries).join(entries.hint("merge"), "ord").join(filled.hint("merge"), "k")
    fits = F.contains("key", "synonym") | F.contains("synonym", "key")
    best = (
        met.filter(fits)
        .groupBy("k")
        .agg(F.min_by("name", F.struct(F.col("synonym") != F.col("key"), "ord")).alias("name"))
    )
    named = keys.join(best.hint("merge"), "k", "left")
    return named.select("key", F.coalesce("name", F.lit(other)).alias("name"))


def with_names(rows: DataFrame, label: str, vocabulary: DataFrame, spread: list[str], out: str = "charge") -> DataFrame:
    """``rows`` with the name of column ``label``; a label that a third of all rows have is spread
    over tasks by the columns ``spread``."""
    names = named_labels(rows.select(F.col(label).alias("label")), vocabulary)
    keyed = rows.withColumn("_key", F.coalesce(key_of(F.col(label)), F.lit("")))
    found = lookup(keyed, names.select(F.col("key").alias("_key"), F.col("name").alias(out)), ["_key"], spread)
    return found.drop("_key")
