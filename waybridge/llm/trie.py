"""Prefix trie of conversations, built in range-partitioned shards around a splitter skeleton.

A conversation is the byte string of its turns' digests, 16 bytes a turn, so sorting these
strings walks the trie depth first.  A few splitter paths cut the order into shards.  A node
that is no prefix of a splitter has all its members in one shard, which finishes it alone
while it streams its sorted paths; only the prefixes of splitters, the skeleton, are met
by several shards.  The skeleton goes to every task, tasks send one partial aggregate per
skeleton node, and a reduction over these few rows finishes them.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybridge.llm.common import or_empty, read
from waybridge.session import materialized

#: bytes of a turn's digest
WIDTH = 16
#: turns of a splitter path; longer shared beginnings are never cut apart
SPLIT_DEPTH = 16
#: sampled paths per shard from which splitters are chosen; they decide balance, not results
SAMPLES = 32
#: conversations with ids alike but for the last ten bits are listed together
ID_BITS = 10
#: rows of one output batch
OUT_ROWS = 4096
#: what separates words
WORD = r"[^\x20\x09-\x0D]+"

PATH = "conv_id long, path binary, words binary"
NODE = (
    "seq long, depth long, skeleton int, n_convs long, conv_id long, n_children long,"
    " n_leaves long, saved_tokens long, words long, ends_sha256 string, turn_key string"
)


def _batch(rows: list[tuple], schema):
    import pyarrow as pa

    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _batches(rows: Iterator[tuple], schema, size: int = OUT_ROWS, most_bytes: int = 1 << 24):
    """Rows as Arrow batches, bounded in rows and in bytes of binary values."""
    held, taken = [], 0
    for row in rows:
        held.append(row)
        taken += sum(len(v) for v in row if isinstance(v, bytes))
        if len(held) >= size or taken >= most_bytes:
            yield _batch(held, schema)
            held, taken = [], 0
    if held:
        yield _batch(held, schema)


def _arrow(**kinds: str):
    import pyarrow as pa

    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, types[kind]) for name, kind in kinds.items()])


def _kinds(schema: str) -> dict[str, str]:
    return dict(part.split() for part in schema.split(","))


def _rows(batches: Iterator, *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def turn_paths(
    turns: DataFrame,
    head: Column | None = None,
    shared: Column | None = None,
    most_shared: int = 0,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv_id, path, words): one row per conversation, its turns as digests with word counts.

    Turns are ordered by number, null first, then by digest; null roles and texts are empty.
    With ``head`` and ``shared`` (columns over ``id``) a conversation begins with the first
    ``shared`` turns of conversation ``head`` in place of its own; ``most_shared`` bounds that
    number.  Rows without a conversation id belong to no conversation.  One shuffle of
    narrow rows; a worker streams them and holds one conversation's digests, 20 bytes a turn.
    """
    own = turns.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(turn_col).alias("turn"),
        or_empty(F.col(role_col)).alias("role"),
        or_empty(F.col(text_col)).alias("text"),
    ).filter("id is not null")
    text = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    rows = own.select(
        (F.col("id") if head is None else head).alias("head"),
        "id",
        (F.lit(0) if shared is None else shared).cast("int").alias("shared"),
        "turn",
        F.substring(F.unhex(F.sha2(text, 256)), 1, WIDTH).alias("digest"),
        F.regexp_count("text", F.lit(WORD)).alias("n"),
    )
    ordered = rows.repartition("head").sortWithinPartitions(
        "head", F.col("id") != F.col("head"), "id", F.asc_nulls_first("turn"), "digest"
    )

    def work(batches: Iterator) -> Iterator:
        def paths():
            now, begun, first, digests, counts, cut = None, None, (b"", b""), None, None, 0

            def rebuilt():
                path = first[0][: WIDTH * cut] + bytes(digests[WIDTH * cut :])
                return now, path, first[1][: 4 * cut] + bytes(counts[4 * cut :])

            for block, conv, k, digest, n in _rows(batches, "head", "id", "shared", "digest", "n"):
                if conv != now:
                    if now is not None:
                        if now == begun:
                            first = bytes(digests[: WIDTH * most_shared]), bytes(counts[: 4 * most_shared])
                        yield rebuilt()
                    if block != begun:
                        begun, first = block, (b"", b"")
                    now, digests, counts, cut = conv, bytearray(), bytearray(), k
                digests += digest
                counts += n.to_bytes(4, "little")
            if now is not None:
                if now == begun:
                    first = bytes(digests[: WIDTH * most_shared]), bytes(counts[: 4 * most_shared])
                yield rebuilt()

        yield from _batches(paths(), _arrow(conv_id="long", path="binary", words="binary"))

    return ordered.mapInArrow(work, PATH)


def distinct_paths(paths: DataFrame) -> DataFrame:
    """(path, words, n, least, ends_sha256): equal conversations once, with their ids hashed.

    Ids are listed in blocks of neighbouring numbers first, so a path shared by a third of all
    conversations comes to the worker that hashes it as few long pieces, which it streams.
    """
    pieces = (
        paths.groupBy("path", "words", F.shiftright("conv_id", ID_BITS).alias("block"))
        .agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
        .select(
            "path",
            "words",
            "block",
            F.size("ids").cast("long").alias("n"),
            F.element_at("ids", 1).alias("least"),
            F.array_join(F.col("ids").cast("array<string>"), ",").alias("list"),
        )
    )
    ordered = pieces.repartition("path").sortWithinPartitions("path", "block")

    def work(batches: Iterator) -> Iterator:
        def joined():
            now, words, n, least, seen = None, None, 0, None, None
            for path, w, m, first, ids in _rows(batches, "path", "words", "n", "least", "list"):
                if path != now:
                    if now is not None:
                        yield now, words, n, least, seen.hexdigest()
                    now, words, n, least, seen = path, w, 0, first, hashlib.sha256()
                seen.update((("," if n else "") + ids).encode())
                n += m
            if now is not None:
                yield now, words, n, least, seen.hexdigest()

        kinds = {"path": "binary", "words": "binary", "n": "long", "least": "long", "ends_sha256": "string"}
        yield from _batches(joined(), _arrow(**kinds))

    return ordered.mapInArrow(work, "path binary, words binary, n long, least long, ends_sha256 string")


def splitters(paths: DataFrame, shards: int) -> list[bytes]:
    """At most ``shards - 1`` paths of at most SPLIT_DEPTH turns that cut the order evenly.

    Chosen from the ``shards * SAMPLES`` paths with the smallest hashes.
    """
    sample = (
        paths.select(F.substring("path", 1, WIDTH * SPLIT_DEPTH).alias("p"), F.xxhash64("path").alias("h"))
        .orderBy("h", "p")
        .limit(shards * SAMPLES)
        .collect()
    )
    known = sorted(bytes(r["p"]) for r in sample)
    return sorted({known[i * len(known) // shards] for i in range(1, shards)} - {b""}) if known else []


def skeleton(cuts: list[bytes]) -> dict[bytes, int]:
    """Every prefix of a splitter with its number; the root is number 0."""
    prefixes = {cut[:i] for cut in cuts for i in range(0, len(cut) + 1, WIDTH)} | {b""}
    return {p: i for i, p in enumerate(sorted(prefixes))}


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths share at their beginning."""
    short = min(len(a), len(b))
    if a[:short] == b[:short]:
        return short // WIDTH
    low, high = 0, short // WIDTH
    while low < high:  # the first `low` turns are equal, the first `high` + 1 are not
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * WIDTH] == b[: mid * WIDTH] else (low, mid - 1)
    return low


class _Node:
    __slots__ = ("children", "ends", "key", "least", "leaves", "n", "number", "saved", "words")

    def __init__(self, key: bytes, words: int, number: int | None) -> None:
        self.key, self.words, self.number = key, words, number
        self.n = self.children = self.leaves = self.saved = 0
        self.least = self.ends = None


def shard_nodes(rows: Iterator[tuple], known: dict[bytes, int]) -> Iterator[tuple]:
    """Nodes of one shard's sorted paths, children before parents.

    A node outside the skeleton is finished; one inside carries what this shard adds: its
    members, and children, leaves and tokens of finished subtrees that hang on it.
    """
    stack: list[_Node] = []
    seq, before = 0, None

    def closed() -> tuple:
        nonlocal seq
        node = stack.pop()
        depth = len(stack)
        if node.number is None:
            node.leaves += not node.children
            node.saved += (node.n - 1) * node.words
        if stack:
            up = stack[-1]
            up.n += node.n
            up.least = node.least if up.least is None else min(up.least, node.least)
            if node.number is None:
                up.children += 1
                up.leaves += node.leaves
                up.saved += node.saved
        seq += 1
        return (
            seq, depth, node.number, node.n, node.least, node.children,
            node.leaves, node.saved, node.words, node.ends, node.key.hex(),
        )

    for path, words, n, least, ends in rows:
        same = 0 if before is None else common_turns(before, path)
        while len(stack) > same + 1:
            yield closed()
        if not stack:
            stack.append(_Node(b"", 0, known[b""]))
        for d in range(len(stack), len(path) // WIDTH + 1):
            inside = stack[-1].number is not None
            number = known.get(path[: d * WIDTH]) if inside else None
            count = int.from_bytes(words[4 * d - 4 : 4 * d], "little")
            stack.append(_Node(path[d * WIDTH - WIDTH : d * WIDTH], count, number))
        top = stack[-1]
        top.n += n
        top.least = least if top.least is None else min(top.least, least)
        top.ends = ends
        before = path
    while stack:
        yield closed()


def with_parents(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Adds (parent_conv_id, parent_skeleton) to a shard's nodes, read from last to first."""
    above: list[tuple] = []
    for row in rows:
        depth, number, least = row[1], row[2], row[4]
        del above[depth:]
        parent, up = above[-1] if above else (None, None)
        above.append((least, number))
        yield (*row, None if up is not None else parent, up if number is None else None)


def prefix_trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per distinct beginning of the conversations in ``paths`` (see ``turn_paths``).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256,
    turn_key): the smallest member, the length, the parent's smallest member (null for the
    root), members, children, childless nodes in the subtree, words that need not be
    stored again within it, the hash of the ids that end here, and the digest of the last turn
    (hexadecimal, empty for the root).  No conversation gives no row.  Repeated conversations
    are one path with several members.  ``shards`` is the number of ranges, by default
    ``spark.sql.shuffle.partitions``; the skeleton has at most SPLIT_DEPTH nodes for each.
    """
    spark = paths.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    once = materialized(distinct_paths(paths), "paths")
    cuts = splitters(once, shards)
    known = skeleton(cuts)
    names = ["path", "words", "n", "least", "ends_sha256"]

    def dealt(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            shard = [bisect.bisect_right(cuts, p) for p in batch.column("path").to_pylist()]
            yield batch.append_column("shard", pa.array(shard, pa.int32()))

    def built(batches: Iterator) -> Iterator:
        yield from _batches(shard_nodes(_rows(batches, *names), known), _arrow(**_kinds(NODE)))

    def linked(batches: Iterator) -> Iterator:
        kinds = _kinds(NODE)
        out = _arrow(**kinds, parent_conv_id="long", parent_skeleton="int")
        yield from _batches(with_parents(_rows(batches, *kinds)), out)

    schema = "path binary, words binary, n long, least long, ends_sha256 string, shard int"
    nodes = materialized(
        once.mapInArrow(dealt, schema)
        .repartitionById(shards, F.col("shard"))
        .sortWithinPartitions("path")
        .mapInArrow(built, NODE)
        .sortWithinPartitions(F.desc("seq"))
        .mapInArrow(linked, NODE + ", parent_conv_id long, parent_skeleton int"),
        "nodes",
    )
    tree = [
        (number, known[p[:-WIDTH]] if p else None, [known[p[:i]] for i in range(0, len(p) + 1, WIDTH)])
        for p, number in known.items()
    ]
    upper = materialized(_reduced(nodes.filter("skeleton is not null"), spark.createDataFrame(
        tree, "skeleton int, up int, line array<int>"
    )), "skeleton")
    empty = hashlib.sha256().hexdigest()
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    last = [F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"), F.col("turn_key")]
    least = F.broadcast(upper.select(F.col("skeleton").alias("parent_skeleton"), F.col("conv_id").alias("least")))
    lower = nodes.filter("skeleton is null").join(least, "parent_skeleton", "left")
    return lower.withColumn("parent_conv_id", F.coalesce("least", "parent_conv_id")).select(
        *columns, *last
    ).unionByName(upper.select(*columns, *last))


def _reduced(parts: DataFrame, tree: DataFrame) -> DataFrame:
    """Skeleton nodes from the shards' partial aggregates; every table here is as small as ``tree``."""
    whole = (
        parts.groupBy("skeleton")
        .agg(
            F.max("depth").alias("depth"),
            F.sum("n_convs").alias("n_convs"),
            F.min("conv_id").alias("conv_id"),
            F.sum("n_children").alias("own_children"),
            F.sum("n_leaves").alias("leaves"),
            F.sum("saved_tokens").alias("saved"),
            F.max("words").alias("words"),
            F.max("ends_sha256").alias("ends_sha256"),
            F.max("turn_key").alias("turn_key"),
        )
        .join(tree, "skeleton")
    )
    inner = whole.filter("up is not null").groupBy(F.col("up").alias("skeleton")).agg(F.count("*").alias("more"))
    whole = whole.join(inner, "skeleton", "left").withColumn(
        "n_children", F.col("own_children") + F.coalesce("more", F.lit(0))
    )
    sums = (
        whole.select(
            F.explode("line").alias("skeleton"),
            (F.col("leaves") + (F.col("n_children") == 0).cast("long")).alias("leaves"),
            (F.col("saved") + (F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        )
        .groupBy("skeleton")
        .agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    )
    parent = whole.select(F.col("skeleton").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    return whole.join(sums, "skeleton").join(parent, "up", "left").drop("leaves", "saved", "line")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that begin with up to three turns of the first of their twenty."""
    paths = turn_paths(
        read(spark, sf_dir, "conversations"),
        head=F.col("id") - F.col("id") % 20,
        shared=F.crc32(F.col("id").cast("string")) % 4,
        most_shared=3,
    )
    return prefix_trie(paths).drop("turn_key")


#: common table expression ``crc`` with the 256 table entries of crc32 as a list ``l``
CRC_SQL = """crc_steps as (
  select range as b, range::bigint as c, 0 as k from range(256)
  union all
  select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc_steps where k < 8),
crc as (select list(c order by b) as l from crc_steps where k = 8)"""


def crc_sql(text: str) -> str:
    """SQL for the crc32 of an ASCII text beside ``crc``."""
    return (
        f"xor(list_reduce(list_prepend(4294967295::bigint, [ord(x)::bigint for x in string_split({text}, '')]),"
        " lambda s, x: xor(s >> 8, l[(xor(s, x) & 255) + 1])), 4294967295)"
    )


QUERIES = {"op11_prefix_trie": op11_prefix_trie}
SQL = {
    "op11_prefix_trie": rf"""
with recursive {CRC_SQL},
turns as (
  select *, row_number() over (partition by conv_id order by turn nulls first, k) as i from (
    select conv_id, turn,
           left(sha256(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')), 32) as k,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words
    from conversations where conv_id is not null)),
ids as (
  select conv_id, conv_id - conv_id % 20 as head, {crc_sql("conv_id::varchar")} % 4 as h
  from (select distinct conv_id from turns), crc),
heads as (select ids.conv_id, h, count(t.i) as n from ids left join turns t on t.conv_id = head and i <= h group by 1, 2),
rebuilt as (
  select ids.conv_id, i as d, k, words from ids join turns t on t.conv_id = head and i <= h
  union all
  select t.conv_id, i - h + n, k, words from turns t join heads using (conv_id) where i > h),
paths as (
  select conv_id, coalesce(list(k order by d) filter (d is not null), []) as p,
         coalesce(list(words order by d) filter (d is not null), []) as w
  from heads left join rebuilt using (conv_id) group by 1),
places as (
  select conv_id, d, array_to_string(p[1:d], '') as node, case when d = 0 then 0 else w[d] end as words, len(p) = d as ends
  from (select *, unnest(range(len(p) + 1)) as d from paths)),
nodes as (
  select d, node, any_value(words) as words, count(*) as n, min(conv_id) as least,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256
  from places group by 1, 2),
kids as (select left(node, 32 * (d - 1)::int) as node, count(*) as n from nodes where d > 0 group by 1),
own as (select nodes.*, coalesce(kids.n, 0) as n_children from nodes left join kids using (node)),
sums as (
  select left(node, 32 * j::int) as node, count(*) filter (n_children = 0) as n_leaves, sum((n - 1) * words) as saved
  from (select *, unnest(range(d + 1)) as j from own) group by 1)
select own.least as conv_id, own.d::bigint as depth, up.least as parent_conv_id, own.n as n_convs, own.n_children,
       sums.n_leaves, sums.saved::bigint as saved_tokens, own.ends_sha256
from own join sums using (node)
left join nodes up on own.d > 0 and up.node = left(own.node, 32 * (own.d - 1)::int)
"""
}
