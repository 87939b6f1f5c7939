"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Every bit position gets a vector of ``radius + 1`` bits; for each non-zero vector v one
table keeps the positions whose vector has an odd product with v and masks the rest.
Any ``radius`` positions span less than the whole space, so some v is orthogonal to all of
them and that table does not see them: fingerprints at ``radius`` or fewer differing
bits share a bucket in at least one of the 2^(radius+1)-1 tables, without exception.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybridge.llm.common import LOWER, byte_texts, or_empty, read, texts, type_of
from waybridge.llm.graph import components
from waybridge.session import materialized

RADIUS = 4
#: fingerprints compared with one another in one step; larger buckets are cut into cells
BLOCK = 1024
#: words whose shingles meet in one step of the verification
CELL_WORDS = 200_000
#: bits of the table of shingles met twice, a power of two
SLOTS = 2**26
#: of so many shingles one is counted before the others travel, chosen by its hash
COUNTED = 3


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The bit masks of the tables, as signed 64-bit numbers."""
    full = 2 ** (radius + 1) - 1
    vector = [i % full + 1 for i in range(bits)]
    out = []
    for v in range(1, full + 1):
        mask = sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def shingles(words: list[bytes], k: int, seed: int):
    """XXH64 of every run of k words, repeats included; a shorter text is one run."""
    import numpy as np
    import xxhash

    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= k:
        return np.array([digest(joined, seed)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: n - k + 1].tolist()
    return np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(start, end[k - 1 :].tolist(), strict=True)),
        np.uint64,
        n - k + 1,
    )


def majority(hashes) -> int:
    """Bits that are set in more than half of the hashes, as a signed number."""
    import numpy as np

    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 32768):
        part = hashes[i : i + 32768].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4
) -> DataFrame:
    """(id, fp): the 64-bit fingerprint of every text over its k-word shingles.

    A-Z count as lower case and words are cut at ASCII white space.  A null or empty
    text, or one of white space alone, has fingerprint 0.
    """

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps = [
                majority(shingles(t.translate(LOWER).split(), k, 42))
                for t in byte_texts(batch.column(1))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"]
            )

    source = texts(docs, id_col, text_col)
    return source.mapInArrow(work, f"id {type_of(source, 'id')}, fp long")


def _forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges that join exactly the values linked, directly or not, among those given."""
    import numpy as np

    if len(values) == 2:
        a, b = values
        near = ((a ^ b) & (2**64 - 1)).bit_count() <= radius
        return [(a, b)] if near else []
    x = np.array(values, np.int64).view(np.uint64)
    left = np.arange(len(x))
    edges: list[tuple[int, int]] = []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            fresh = []
            for i in front.tolist():
                near = np.bitwise_count(x[left] ^ x[i]) <= radius
                edges += [(values[i], values[j]) for j in left[near].tolist()]
                fresh.append(left[near])
                left = left[~near]
            front = np.concatenate(fresh)
    return edges


def covering_links(
    fps: DataFrame, radius: int = RADIUS, block: int = BLOCK, extra: Sequence[str] = ()
) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` linked within the radius.

    ``extra`` names columns that must be equal, too (independent fingerprint families).
    The edges are a spanning forest of every bucket, not all its pairs: they join what
    is linked and nothing else.  A bucket above ``block`` values is cut by a hash
    into parts, and every two parts meet in a cell of their own, so no task holds a whole bucket
    and no pair is left out.

    Spark sizes exploded rows like the rows they come from, 31 times too low, so the join
    sorts both sides and none of them is copied to the driver.
    """
    parts = [*extra, "t", "key"]
    keyed = fps.select(
        *extra,
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(radius)])).alias(
            "t", "key"
        ),
    )
    shared = keyed.groupBy(*parts).agg(F.count("*").alias("m")).filter(F.col("m") > 1)
    cells = (
        keyed.join(shared.hint("merge"), parts)
        .withColumn("nb", F.ceil(F.col("m") / block).cast("int"))
        .withColumn("i", F.pmod(F.xxhash64("fp", "t"), F.col("nb")).cast("int"))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .groupBy(*parts, F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"))
        .agg(F.collect_list("fp").alias("fps"))
        .filter(F.size("fps") > 1)
    )

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            where, a, b = [], [], []
            for row, values in enumerate(batch.column("fps").to_pylist()):
                for x, y in _forest(sorted(values), radius):
                    where.append(row)
                    a.append(x)
                    b.append(y)
            kept = [batch.column(c).take(pa.array(where, pa.int64())) for c in extra]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(a, pa.int64()), pa.array(b, pa.int64())], [*extra, "a", "b"]
            )

    kinds = "".join(f"{c} {type_of(fps, c)}, " for c in extra)
    return cells.select(*extra, "fps").mapInArrow(work, f"{kinds}a long, b long").distinct()


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 4,
    radius: int = RADIUS,
) -> DataFrame:
    """(id, fp, component): documents whose fingerprints are linked, directly or not.

    ``component`` is the least id reachable.  Equal fingerprints are one node of the
    search, so copies cost nothing there.  Every input row, repeated or not, gives one row;
    rows with a null id take part and never name a component that has another id.
    No rows in, no rows out; further columns are ignored.
    """
    prints = materialized(fingerprints(docs, id_col, text_col, k), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    found = components(covering_links(nodes.select("fp"), radius))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root")
    return prints.join(named.select("fp", "component"), "fp").select("id", "fp", "component")


def _class_name(words: list[bytes]) -> bytes:
    import hashlib

    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _short(name: bytes) -> int:
    """The first 64 bits of a class, the size that names a shingle, too."""
    return int.from_bytes(name[:8], "little", signed=True)


def _text_bits() -> list[Column]:
    """128 bits that stand for a text as it is."""
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2")]


def _classes(docs: DataFrame, id_col: str, text_col: str, prints: bool) -> DataFrame:
    """(id, t1, t2, class, c, words, fp): exact class of the word sequence and its short name.

    ``fp`` is the fingerprint of :func:`fingerprints`, null without ``prints``.
    """

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            names, sizes, fps = [], [], []
            # one list of words at a time
            for text in byte_texts(batch.column("text")):
                words = text.translate(LOWER).split()
                names.append(_class_name(words))
                sizes.append(len(words))
                fps.append(majority(shingles(words, 4, 42)) if prints else None)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("id", "t1", "t2")),
                    pa.array(names, pa.binary()),
                    pa.array([_short(n) for n in names], pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(fps, pa.int64()),
                ],
                ["id", "t1", "t2", "class", "c", "words", "fp"],
            )

    source = texts(docs, id_col, text_col).select("id", "text", *_text_bits())
    kinds = f"id {type_of(source, 'id')}, t1 long, t2 long, class binary, c long, words long, fp long"
    return source.mapInArrow(work, kinds)


def _holders(
    docs: DataFrame, id_col: str, text_col: str, k: int, met_slots=None, threshold: float = 0.0
) -> DataFrame:
    """(class, c, all, sh): the set of k-word shingles of every class with its size.

    A task gives a class once; several tasks may give it again.  Without ``met_slots`` only
    the counted shingles come out, one in COUNTED.  With it counted shingles whose slot is not
    set are known to stand in one text alone.  They are left out, and so is a text that has
    too many of them: a partner at the threshold has all but ``1 - threshold`` of its
    shingles.  No text with a partner is left out, and the size is that of the whole set.
    """

    def work(batches: Iterator) -> Iterator:
        import math

        import numpy as np
        import pyarrow as pa

        met: set[bytes] = set()
        for batch in batches:
            names, sizes, sets = [], [], []
            for text in byte_texts(batch.column("text")):
                words = text.translate(LOWER).split()
                name = _class_name(words)
                if name not in met:
                    met.add(name)
                    own = np.unique(shingles(words, k, 42)).view(np.int64)
                    size, counted = len(own), own % COUNTED == 0
                    if met_slots is None:
                        own = own[counted]
                    else:
                        slot = own & (SLOTS - 1)
                        alone = counted & ((met_slots[slot >> 6] >> (slot & 63)) & 1 == 0)
                        if alone.sum() > size - math.ceil(size * threshold - 1e-9):
                            continue
                        own = own[~alone]
                    names.append(name)
                    sizes.append(size)
                    sets.append(own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.binary()),
                    pa.array([_short(n) for n in names], pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(sets, pa.list_(pa.int64())),
                ],
                ["class", "c", "all", "sh"],
            )

    source = texts(docs, id_col, text_col).select("text")
    return source.mapInArrow(work, "class binary, c long, all long, sh array<long>")


def _met_slots(holders: DataFrame):
    """Bits of the slots that hold a shingle given twice or more; ``SLOTS`` bits for any corpus.

    Spares most shingles of one text alone the way to other tasks.  A full table spares none,
    and no shared shingle is ever left out.
    """
    import numpy as np

    # 40 bits travel cheaper than 64; two shingles alike in them count as met
    shingle = holders.select(F.explode("sh").alias("sh"))
    again = shingle.groupBy((F.col("sh").bitwiseAND(F.lit(2**40 - 1))).alias("h")).count().filter("count > 1")
    slot = F.col("h").bitwiseAND(F.lit(SLOTS - 1))
    words = again.groupBy(F.shiftright(slot, 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")
    ).toArrow()
    out = np.zeros(SLOTS // 64, np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out


def _prefix_links(holders: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) that connect every two texts ``c`` whose sets reach the threshold.

    All shingles have one order, rare ones first.  If all but the last ``threshold`` of
    each set, and one more, are its prefix, then two sets at the threshold share a shingle
    of both prefixes, without exception.  A shingle of one text alone comes first and joins
    nothing, so only shared ones travel; a text with too few of them has no partner at all.
    Shingles outnumber the rows by which Spark sizes them, so the joins sort both sides.
    """
    # plain numbers keep the rows of both shuffles short and let the counts be hashed
    holders = holders.select("c", "all", F.explode("sh").alias("sh"))
    shared = (
        holders.groupBy("sh")
        .agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("df"))
        .filter("low < high")
        .select("sh", "df")
    )
    room = F.col("all") - F.ceil(F.col("all") * threshold - 1e-9) + 1
    prefix = (
        holders.join(shared.hint("merge"), "sh")
        .groupBy("c", "all")
        .agg(F.array_sort(F.collect_set(F.struct("df", "sh"))).alias("own"))
        .withColumn("left", (room - (F.col("all") - F.size("own"))).cast("int"))
        .filter("left > 0")
        .select("c", F.explode(F.slice("own", F.lit(1), F.col("left"))["sh"]).alias("sh"))
    )
    prefix = materialized(prefix, "prefixes")
    least = materialized(prefix.groupBy("sh").agg(F.min("c").alias("b")), "least")
    return prefix.join(least.hint("merge"), "sh").filter("b < c").select(F.col("c").alias("a"), "b").distinct()


def _print_links(kinds: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) of class names that connect the classes whose fingerprints are linked."""
    firsts = materialized(kinds.groupBy("fp").agg(F.min(F.hex("class")).alias("first")), "first-classes")
    alike = (
        kinds.join(firsts, "fp")
        .select(F.hex("class").alias("a"), F.col("first").alias("b"))
        .filter("a <> b")
    )
    near = covering_links(firsts.select("fp"), radius).withColumnsRenamed({"a": "x", "b": "y"})
    ends = [firsts.select(F.col("fp").alias(v), F.col("first").alias(n)) for v, n in (("x", "a"), ("y", "b"))]
    return alike.unionByName(near.join(ends[0], "x").join(ends[1], "y").select("a", "b"))


def _similar(sets: list, size, threshold: float) -> list[tuple[int, int]]:
    """Edges that join the sets linked by a Jaccard similarity of ``threshold`` or more.

    ``size`` are the sizes of the whole sets; members that no other set has may be missing.
    """
    import numpy as np

    given = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), given)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    posting = owner[order]
    first = np.searchsorted(codes[order], np.arange(codes.max() + 2)) if len(codes) else [0]
    at = np.concatenate([[0], np.cumsum(given)])
    left = np.ones(len(sets), bool)
    edges, queue = [], []
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed] = False
        queue.append(seed)
        while queue and left.any():
            i = queue.pop()
            own = codes[at[i] : at[i + 1]]
            if not len(own):
                continue
            hits = np.concatenate([posting[first[c] : first[c + 1]] for c in own.tolist()])
            common = np.bincount(hits, minlength=len(sets))
            near = left & (common >= threshold * (size + size[i] - common) - 1e-9) & (common > 0)
            found = np.flatnonzero(near).tolist()
            left[near] = False
            edges += [(i, j) for j in found]
            queue += found
        queue.clear()
    return edges


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    threshold: float = 0.8,
    cell_words: int = CELL_WORDS,
    radius: int | None = None,
) -> DataFrame:
    """(id, t1, t2, class, group): groups of texts linked by shared k-word shingles.

    Two texts are linked if the Jaccard similarity of their sets of k-word shingles reaches
    the threshold.  Candidates are texts that share a shingle of their prefixes (see
    ``_prefix_links``), so no pair at the threshold is missed.  Candidate components are then
    checked exactly: the shingle sets of a
    component, as they were read for the candidates, meet in cells of about ``2 * cell_words`` words, every two parts in one cell, and
    only edges that join linked texts come out.  Texts with the same words are one class
    from the start, so copies cost one row each.

    With ``radius`` texts are linked by their SimHash fingerprints, too, as
    :func:`simhash_components` links them; the shingles then add the links that the
    fingerprints miss.

    Every row gives one row, with 128 bits of its text in ``t1`` and ``t2``; ``group`` is the least id of the group.  Null and empty texts
    form one class; a null id never names a group that has another id.
    """
    import numpy as np

    seen = materialized(_classes(docs, id_col, text_col, radius is not None), "classes")
    kinds = seen.groupBy("class").agg(
        F.min("id").alias("least"), *[F.first(n).alias(n) for n in ("c", "words", "fp")]
    )
    kinds = materialized(kinds, "kinds")
    slots = _met_slots(_holders(docs, id_col, text_col, k))
    holders = materialized(_holders(docs, id_col, text_col, k, slots, threshold), "holders")
    candidates = components(_prefix_links(holders, threshold))
    placed = kinds.join(candidates.withColumnRenamed("node", "c"), "c").select(
        "class", "words", "root"
    )
    placed = materialized(placed, "candidates")
    weight = (
        placed.groupBy("root")
        .agg(F.sum("words").alias("total"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("root", F.greatest(F.lit(1), F.ceil(F.col("total") / cell_words)).alias("nb"))
    )
    chosen = placed.join(weight, "root").select("class", "root", "nb")

    cells = (
        holders.join(chosen, "class")
        .dropDuplicates(["class"])
        .withColumn("i", F.pmod(F.xxhash64("class"), F.col("nb")))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .groupBy("root", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"))
        .agg(F.collect_set(F.struct("class", "all", "sh")).alias("members"))
        .select("members")
    )

    def verify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b = [], []
            column = batch.column("members")
            for row in range(len(column)):
                members = column[row].values
                if len(members) < 2:
                    continue
                names = members.field("class").to_pylist()
                lists = members.field("sh")
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                cut = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))[:-1]
                whole = members.field("all").to_numpy(zero_copy_only=False)
                for i, j in _similar(np.split(flat, cut), whole, threshold):
                    a.append(names[i].hex())
                    b.append(names[j].hex())
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"]
            )

    links = cells.mapInArrow(verify, "a string, b string").select(F.upper("a").alias("a"), F.upper("b").alias("b"))
    if radius is not None:
        links = links.unionByName(_print_links(kinds, radius))
    groups = components(links)
    rooted = kinds.select("class", "least").join(
        groups.select(F.unhex("node").alias("class"), "root"), "class", "left"
    ).withColumn("root", F.coalesce("root", F.hex("class")))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("group")), "root")
    return seen.join(named.select("class", "group"), "class").select("id", "t1", "t2", "class", "group")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int | None = None
) -> DataFrame:
    """The documents without those whose group has a smaller id; columns stay as they are.

    See :func:`near_duplicates` for the groups and ``radius``.

    Rows with a null id cannot be told apart and are kept.  Repeated rows of one id and text
    stay together; an id that stands on several texts loses only the rows whose text
    has another survivor.
    """
    groups = near_duplicates(docs, id_col, text_col, radius=radius)
    gone = groups.filter(F.col("id") != F.col("group")).select(F.col("id").alias("_id"), "t1", "t2").distinct()
    text = or_empty(F.col(text_col))
    same = (
        (docs[id_col] == gone["_id"])
        & (F.xxhash64(text) == gone["t1"])
        & (F.xxhash64(F.lit(7), text) == gone["t2"])
    )
    return docs.join(gone, same, "left_anti")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


QUERIES = {"op4_simhash": op4_simhash}
SQL: dict[str, str] = {}
