"""Sliding-window submission limits per account, in batch."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waybridge import vocab


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def trailing_counts(
    submissions: DataFrame,
    limit: int = vocab.RATE_LIMIT,
    window_seconds: int = vocab.RATE_WINDOW_SECONDS,
) -> DataFrame:
    """Submissions of the account in the window before each one, accepted or not.

    ``submissions``: (account_id, submission_id, ts).  An account is cut into
    blocks as long as the window; a block also sees the rows of the block before
    it, so accounts of any size are spread over tasks.  Only counts from the
    start of a block are kept per row, never the window itself.
    """
    width = window_seconds * 1_000_000
    block = F.floor(F.col("_us") / width)
    rows = (
        submissions.withColumn("_us", micros("ts"))
        .withColumn("_own", block)
        .withColumn("_block", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    )
    part = W.partitionBy("account_id", "_block")
    position = F.row_number().over(part.orderBy("_us", "submission_id"))
    gone = F.count("*").over(part.orderBy("_us").rangeBetween(W.unboundedPreceding, -width))
    return (
        rows.withColumn("prior_in_window", (position - 1 - gone).cast("bigint"))
        .filter(F.col("_block") == F.col("_own"))
        .withColumn("over_limit", F.col("prior_in_window") >= limit)
        .drop("_own")
    )


def raw_report(
    submissions: DataFrame,
    limit: int = vocab.RATE_LIMIT,
    window_seconds: int = vocab.RATE_WINDOW_SECONDS,
) -> DataFrame:
    """Every submission with the count before it and whether that reaches the limit."""
    return trailing_counts(submissions, limit, window_seconds).drop("_us", "_block")


def admit(
    times: np.ndarray, window: deque, limit: int, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Decide on sorted submission times; ``window`` holds the accepted ones still counting.

    Stretches of refused submissions are skipped with one binary search.
    """
    n = len(times)
    ok = np.zeros(n, dtype=bool)
    wait = np.zeros(n, dtype=np.int64)
    i = 0
    while i < n:
        now = int(times[i])
        while window and window[0] <= now - width:
            window.popleft()
        if len(window) < limit:
            ok[i] = True
            window.append(now)
            i += 1
        else:
            free_at = (window[0] if window else now) + width
            j = i + 1
            if j < n and times[j] < free_at:
                j += int(np.searchsorted(times[j:], free_at, side="left"))
            wait[i:j] = (free_at - times[i:j]) // 1_000_000 + 1
            i = j
    return ok, wait


def rate_limited(
    submissions: DataFrame,
    limit: int = vocab.RATE_LIMIT,
    window_seconds: int = vocab.RATE_WINDOW_SECONDS,
) -> DataFrame:
    """Accept or refuse every submission; only accepted ones count against the limit.

    A submission with fewer than ``limit`` others before it in the window is
    accepted whatever happened before.  Only blocks that contain another kind
    are decided in order, together with the block before them; runs of such
    blocks are independent of each other.  Rows of a run stream through a task
    in batches and at most ``limit`` times are remembered.
    """
    width = window_seconds * 1_000_000
    counted = trailing_counts(submissions, limit, window_seconds).select(
        "account_id", "submission_id", "_us", "_block", "over_limit"
    )
    crowded = (
        counted.filter("over_limit").select("account_id", "_block").distinct()
    )
    by_block = W.partitionBy("account_id").orderBy("_block")
    new_run = F.coalesce(F.lag("_block").over(by_block) != F.col("_block") - 1, F.lit(True))
    runs = crowded.withColumn(
        "_run", F.when(new_run, F.col("_block"))
    ).withColumn("_run", F.last("_run", ignorenulls=True).over(by_block))
    lead_in = F.when(
        F.col("_run") == F.col("_block"),
        F.array(
            F.struct(F.col("_block").alias("_block"), F.lit(False).alias("_lead_in")),
            F.struct((F.col("_block") - 1).alias("_block"), F.lit(True).alias("_lead_in")),
        ),
    ).otherwise(
        F.array(F.struct(F.col("_block").alias("_block"), F.lit(False).alias("_lead_in")))
    )
    plan = runs.select("account_id", "_run", F.inline(lead_in))
    placed = counted.drop("over_limit").join(plan, ["account_id", "_block"], "left")
    quiet = placed.filter(F.col("_run").isNull() | F.col("_lead_in")).select(
        "account_id",
        "submission_id",
        F.lit(True).alias("accepted"),
        F.lit(0).cast("bigint").alias("retry_after"),
    )
    types = {f.name: f.dataType.simpleString() for f in submissions.schema.fields}
    out = (
        f"account_id {types['account_id']}, submission_id {types['submission_id']}, "
        "accepted boolean, retry_after bigint, lead_in boolean"
    )

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, window = None, deque()
        for batch in batches:
            account, run = batch["account_id"].to_numpy(), batch["_run"].to_numpy()
            times = batch["_us"].to_numpy()
            ok = np.empty(len(times), dtype=bool)
            wait = np.empty(len(times), dtype=np.int64)
            changes = (account[1:] != account[:-1]) | (run[1:] != run[:-1])
            starts = np.concatenate(([0], np.flatnonzero(changes) + 1, [len(times)]))
            for i, j in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if i == j:
                    continue
                name = (account[i], run[i])
                if name != current:
                    current, window = name, deque()
                ok[i:j], wait[i:j] = admit(times[i:j], window, limit, width)
            yield pd.DataFrame(
                {
                    "account_id": account,
                    "submission_id": batch["submission_id"],
                    "accepted": ok,
                    "retry_after": wait,
                    "lead_in": batch["_lead_in"],
                }
            )

    decided = (
        placed.filter(F.col("_run").isNotNull())
        .repartition("account_id", "_run")
        .sortWithinPartitions("account_id", "_run", "_us", "submission_id")
        .mapInPandas(decide, out)
        .filter(~F.col("lead_in"))
        .drop("lead_in")
    )
    return quiet.unionByName(decided)
