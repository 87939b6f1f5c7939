"""Exhaustive top-k search by term-at-a-time accumulation.

Vectors are sparse rows of integer weights.  A block of candidates keeps one posting list per
dimension; each term of a block of queries scatters its weighted postings into dense
score arrays, a partition step selects the best of the block, and the selections of all
blocks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waybridge.llm.common import read
from waybridge.session import materialized

#: candidates of a block, and queries of a block
CANDIDATES = 4096
QUERIES_AT_ONCE = 1024
#: queries whose score arrays are filled together
SCORED = 64
SCALE = 64


def integer_vectors(
    vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE
) -> DataFrame:
    """(id, terms): floor(scale * x) of every component, as ``array<long>``.

    Rows whose id or vector is null, or whose vector has a null or non-finite component,
    are left out.  Of rows that share an id the smallest vector stays.
    """
    wide = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists(
        wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    return (
        vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad)
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(F.transform(wide, lambda x: F.floor(x * scale))).alias("terms"))
    )


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """(block, ids, terms): up to ``size`` rows of a partition in one row."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        def row(block: int, ids: list, terms: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([terms], pa.list_(pa.list_(pa.int64()))),
                ],
                ["block", "ids", "terms"],
            )

        block = TaskContext.get().partitionId() << 32
        ids, terms = [], []
        for batch in batches:
            ids += batch.column("id").to_pylist()
            terms += batch.column("terms").to_pylist()
            while len(ids) >= size:
                yield row(block, ids[:size], terms[:size])
                ids, terms, block = ids[size:], terms[size:], block + 1
        if ids:
            yield row(block, ids, terms)

    return rows.mapInArrow(work, "block long, ids array<long>, terms array<array<long>>")


def accumulate(query_terms, postings, n: int):
    """Scores of all candidates for a block of queries, one term after the other."""
    import numpy as np

    scores = np.zeros((len(query_terms), n), query_terms.dtype)
    added = np.empty_like(scores)
    for term, (where, weight) in enumerate(postings):
        if term >= query_terms.shape[1] or not len(where):
            continue
        own = query_terms[:, term]
        active = np.flatnonzero(own)
        if len(where) == n and len(active) == len(own):
            np.multiply(own[:, None], weight[None, :], out=added)
            scores += added
        elif len(where) * 2 > n:
            # mostly dense: zeros add nothing, and a plain pass costs less than a scatter
            full = np.zeros(n, weight.dtype)
            full[where] = weight
            np.multiply(own[:, None], full[None, :], out=added)
            scores += added
        elif len(where) == n:
            scores[active] += own[active, None] * weight[None, :]
        else:
            scores[np.ix_(active, where)] += own[active, None] * weight[None, :]
    return scores


def matrix(lists, width: int):
    """An Arrow array of lists as rows of one width, filled up with 0."""
    import numpy as np

    sizes = lists.value_lengths().to_numpy()
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def top_k(
    vectors: DataFrame,
    wanted: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    candidates: int = CANDIDATES,
    queries: int = QUERIES_AT_ONCE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query row.

    ``wanted`` is a condition on the id that names the queries; all rows but the query's
    own are candidates.  Ties go to the smaller id; a query with fewer candidates gets them
    all.  Missing dimensions of shorter vectors count as 0, scores are exact integers
    (beyond 64 bits they stop at the limits).  Blocks of queries meet blocks of candidates in
    pairs, k rows per query leave a pair, and neither side is copied to every task.
    """
    rows = materialized(integer_vectors(vectors, id_col, vector_col), "vectors")
    left = materialized(_packed(rows.filter(wanted), queries), "query-blocks")
    right = materialized(_packed(rows, candidates), "candidate-blocks")
    # blocks of queries are dealt to slots; every block of candidates visits every slot
    slots = max(1, left.count())
    asking = left.select(
        F.pmod(F.xxhash64("block"), F.lit(slots)).alias("slot"),
        F.col("ids").alias("q_ids"),
        F.col("terms").alias("q_terms"),
    )
    pairs = (
        right.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
        .join(asking, "slot")
        .select("q_ids", "q_terms", F.col("ids").alias("c_ids"), F.col("terms").alias("c_terms"))
    )

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        low, high = -(2**63), 2**63 - 1
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids = batch.column("q_ids")[row].values.to_pylist()
                names = batch.column("c_ids")[row].values.to_numpy()
                order = np.argsort(names, kind="stable")
                names = names[order]
                sides = [batch.column(c)[row].values for c in ("q_terms", "c_terms")]
                width = max(int(side.value_lengths().to_numpy().max()) for side in sides)
                asked, block = (matrix(side, width) for side in sides)
                block = block[order]
                most = int(np.abs(block).max(initial=0)) * int(np.abs(asked).max(initial=0)) * max(width, 1)
                kind = np.int32 if most < 2**31 else np.int64 if most < 2**63 else object
                block, asked = block.astype(kind), asked.astype(kind)
                postings = [(np.flatnonzero(column), column[column != 0]) for column in block.T]
                out_q, out_c, out_s = [], [], []
                for start in range(0, len(q_ids), SCORED):
                    scores = accumulate(asked[start : start + SCORED], postings, len(names))
                    if kind is object:
                        scores = np.clip(scores, low, high).astype(np.int64)
                    for own, line in zip(q_ids[start : start + SCORED], scores, strict=True):
                        line = line.astype(np.int64)
                        self_at = np.searchsorted(names, own)
                        free = np.ones(len(names), bool)
                        if self_at < len(names) and names[self_at] == own:
                            free[self_at] = False
                        place = np.flatnonzero(free)
                        line = line[place]
                        if len(line) > k:
                            least = np.partition(line, len(line) - k)[len(line) - k]
                            above = np.flatnonzero(line > least)
                            level = np.flatnonzero(line == least)[: k - len(above)]
                            best = np.concatenate([above, level])
                        else:
                            best = np.arange(len(line))
                        out_q += [own] * len(best)
                        out_c.append(names[place[best]])
                        out_s.append(line[best])
                empty = np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(out_q, pa.int64()),
                        pa.array(np.concatenate(out_c or [empty])),
                        pa.array(np.concatenate(out_s or [empty])),
                    ],
                    ["query_id", "vec_id", "score"],
                )

    found = pairs.mapInArrow(work, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


QUERIES = {"op7_topk": op7_topk}
SQL = {
    "op7_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * x::double) as bigint)) as t
  from embeddings where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank
  from (select q.vec_id as query_id, c.vec_id as vec_id,
               cast(list_sum(list_transform(list_zip(q.t, c.t), lambda p: p[1] * p[2])) as bigint) as score
        from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0))
where rank <= 20
"""
}
