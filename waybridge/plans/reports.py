"""Read side: result documents, listings, queues and usage figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waybridge import vocab
from waybridge.functions.display import stage_track
from waybridge.functions.scoring import rounded_mean, thousandths
from waybridge.operators.hotkeys import lookup
from waybridge.sources.store import all_of, equal_if

DOCS_PER_PART = 1000

# Stored tables in the order users see them.
CANONICAL_ORDER = {
    "documents": ["page_start", "document_id"],
    "extracted_fields": ["field_name", "document_id"],
    "match_results": ["line_item", "shipment_id"],
    "usage": [("log_date", "desc"), "provider", "model"],
    "review_queue": ["created_at", "item_id"],
}


def in_canonical_order(df: DataFrame, table: str) -> DataFrame:
    """The whole table sorted; ranges of the sort key go to different tasks."""
    keys = [
        F.col(k) if isinstance(k, str) else getattr(F.col(k[0]), k[1])()
        for k in CANONICAL_ORDER[table]
    ]
    return df.orderBy(*keys)


# --- tenants and lookups -----------------------------------------------------------


def of_account(rows: DataFrame, jobs: DataFrame, account_id) -> DataFrame:
    """Rows that belong to jobs of one account."""
    mine = jobs.filter(F.col("account_id") == account_id).select("job_id")
    return rows.join(mine, "job_id", "left_semi")


def fields_named(fields: DataFrame, name: str) -> DataFrame:
    return fields.filter(F.col("field_name") == name)


def highlights(fields: DataFrame, page: int | None = None) -> DataFrame:
    """Fields that can be drawn on their page."""
    on_page = None if page is None else F.col("source_page") == page
    return fields.filter(all_of(F.col("source_bbox").isNotNull(), on_page))


def bbox_struct(text: Column) -> Column:
    """Bounding box from ``[x,y,w,h]`` or ``{"x":..,"y":..,"w":..,"h":..}``."""
    listed = F.from_json(text, "array<double>")
    named = F.from_json(text, "struct<x:double,y:double,w:double,h:double>")
    from_list = F.struct(
        *[F.try_element_at(listed, F.lit(i + 1)).alias(n) for i, n in enumerate("xywh")]
    )
    return F.when(F.ltrim(text).startswith("["), from_list).when(
        F.ltrim(text).startswith("{"), named
    )


# --- pages of listings -------------------------------------------------------------


def keyset_page(
    rows: DataFrame,
    key: str,
    limit: int = 50,
    before: tuple | None = None,
    **equal,
) -> DataFrame:
    """Newest rows before a cursor (created_at, key), at most ``limit`` of them.

    The cursor of the next page is carried on every row and null when the page
    is not full.  A limit outside 1..200 is refused.
    """
    if not 1 <= limit <= 200:
        raise ValueError(f"limit must be between 1 and 200, not {limit}")
    older = None
    if before is not None:
        ts, last = F.lit(before[0]).cast("timestamp"), F.lit(before[1])
        at = F.col("created_at").cast("timestamp")
        older = (at < ts) | ((at == ts) & (F.col(key) < last))
    page = (
        rows.filter(all_of(older, *[equal_if(k, v) for k, v in equal.items()]))
        .orderBy(F.desc("created_at"), F.desc(key))
        .limit(limit)
    )
    # the page has 200 rows at most, so one task may look at all of it
    whole = W.partitionBy(F.lit(0))
    last = F.min(F.struct("created_at", F.col(key).alias("key"))).over(whole)
    is_full = F.count("*").over(whole) == limit
    return (
        page.withColumn("_last", F.when(is_full, last))
        .withColumn("next_created_at", F.col("_last.created_at"))
        .withColumn("next_key", F.col("_last.key"))
        .drop("_last")
    )


def offset_page(rows: DataFrame, key: str, limit: int = 50, offset: int = 0) -> DataFrame:
    return rows.orderBy(F.desc("created_at"), F.desc(key)).offset(offset).limit(limit)


def recent_jobs(jobs: DataFrame, count: int = 5) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(count)


def oldest_first(items: DataFrame, reason: str | None = None) -> DataFrame:
    return items.filter(all_of(equal_if("reason", reason))).orderBy("created_at", "item_id")


# --- jobs and their documents ------------------------------------------------------


def documents_per_job(documents: DataFrame) -> DataFrame:
    return documents.groupBy("job_id").agg(F.count("*").alias("document_count"))


def review_flags(reviews: DataFrame) -> DataFrame:
    """Number of review rows per job and which reasons occur, in the fixed reason order."""
    names = F.array(
        *[
            F.when(F.bool_or(F.col("reason") == r), F.lit(r))
            for r in vocab.REVIEW_REASONS
        ]
    )
    return reviews.groupBy("job_id").agg(
        F.count("*").alias("review_rows"),
        F.array_compact(names).alias("review_reasons"),
    )


def job_listing(jobs: DataFrame, documents: DataFrame, reviews: DataFrame) -> DataFrame:
    """Jobs with document count, review flag and review reasons."""
    return (
        jobs.join(documents_per_job(documents), "job_id", "left")
        .join(review_flags(reviews), "job_id", "left")
        .withColumn("document_count", F.coalesce("document_count", F.lit(0)))
        .withColumn("review_required", F.coalesce(F.col("review_rows") > 0, F.lit(False)))
        .drop("review_rows")
    )


def owned_reviews(reviews: DataFrame, jobs: DataFrame, account_id=None) -> DataFrame:
    """Review items with the account of their job."""
    owners = jobs.select("job_id", "account_id")
    if account_id is not None:
        owners = owners.filter(F.col("account_id") == account_id)
    return lookup(reviews, owners, ["job_id"], ["item_id"], how="inner")


def pending_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy().agg(F.count_if(F.col("state") == "pending").alias("pending"))


def job_details(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Jobs with the summaries of their documents in page order.

    Documents of a job start on different pages, so a part covers a range of
    ``DOCS_PER_PART`` pages and stays bounded; most jobs are one part.
    """
    part = F.floor((F.col("page_start") - 1) / DOCS_PER_PART)
    entry = F.struct("page_start", "document_id", "doc_type", "page_end")
    listed = documents.groupBy("job_id", part.alias("part_no")).agg(
        F.array_sort(F.collect_list(entry)).alias("documents")
    )
    return jobs.join(listed, "job_id", "left").withColumn(
        "part_no", F.coalesce("part_no", F.lit(0))
    )


def result_documents(
    jobs: DataFrame,
    documents: DataFrame,
    fields: DataFrame,
    match_results: DataFrame,
    reviews: DataFrame,
    confidences: DataFrame | None = None,
) -> DataFrame:
    """Nested results of finished jobs: documents with fields, match lines, review reasons.

    Document lists are cut by page ranges as in :func:`job_details`.
    ``match_results`` must use mapped charge names (ten lines per shipment at
    most).  Part 0 carries the match lines and reasons.
    """
    done = jobs.filter(F.col("status").isin(vocab.RESULT_STATUSES)).select(
        "job_id", "shipment_id", "status"
    )
    docs = documents.join(done.select("job_id").hint("merge"), "job_id", "left_semi")
    wanted = docs.select("document_id").hint("merge")
    source = F.struct(F.col("source_page").alias("page"), F.col("source_bbox").alias("bbox"))
    value = F.struct(
        F.col("field_value").alias("value"), F.col("confidence"), source.alias("source")
    )
    # a name that was stored twice counts with its most certain value
    # fields of other documents go no further, and those that stay are dealt out by document once
    named = fields.join(wanted, "document_id", "left_semi").groupBy("document_id", "field_name").agg(
        F.max_by(value, F.struct("confidence", "field_value")).alias("_value")
    )
    field_maps = named.groupBy("document_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_name", "_value")))).alias(
            "fields"
        )
    )
    full = docs.join(field_maps, "document_id", "left")
    if confidences is not None:
        full = full.join(
            confidences.select("document_id", "document_confidence"), "document_id", "left"
        )
    else:
        full = full.withColumn("document_confidence", F.col("class_confidence"))
    part = F.floor((F.col("page_start") - 1) / DOCS_PER_PART)
    entry = F.struct(
        "page_start", "document_id", "doc_type", "fields", "document_confidence",
        "class_confidence",
    )
    def order(a: Column, b: Column) -> Column:
        """By first page, then by id; equal entries compare as equal."""
        out = F.lit(0)
        for name in ("document_id", "page_start"):
            out = (
                F.when(a[name].eqNullSafe(b[name]), out)
                .when(a[name].isNull() | (a[name] < b[name]), -1)
                .otherwise(1)
            )
        return out

    listed = full.groupBy("job_id", part.alias("part_no")).agg(
        F.array_sort(F.collect_list(entry), order).alias("documents")
    )
    line = F.struct(
        "line_ord", "line_item", "rate_con_value", "bol_pod_value", "invoice_value",
        "discrepancy_flag", "discrepancy_amount",
    )
    # lines of other shipments go no further; an inner join, for every shipment stands once on the right
    asked = done.select("shipment_id").distinct()
    matched = match_results.join(asked, "shipment_id").groupBy("shipment_id").agg(
        F.array_sort(F.collect_list(line)).alias("match_results")
    )
    first = F.col("part_no") == 0
    flagged = F.transform(
        F.filter("match_results", lambda m: m["discrepancy_flag"] != "none"),
        lambda m: F.concat(
            F.lit("discrepancy: "), m["discrepancy_flag"], F.lit(" on "), m["line_item"]
        ),
    )
    reasons = F.flatten(
        F.transform(
            F.coalesce("review_reasons", F.array().cast("array<string>")),
            lambda r: F.when(
                r == "discrepancy", F.coalesce(flagged, F.array().cast("array<string>"))
            ).otherwise(F.array(r)),
        )
    )
    return (
        done.join(listed, "job_id", "left")
        .withColumn("part_no", F.coalesce("part_no", F.lit(0)))
        .join(matched, "shipment_id", "left")
        .join(review_flags(reviews), "job_id", "left")
        .select(
            "job_id",
            "part_no",
            "shipment_id",
            "documents",
            F.when(first, F.col("match_results")).alias("match_results"),
            F.coalesce(F.col("review_rows") > 0, F.lit(False)).alias("review_required"),
            F.when(first, reasons).alias("review_reasons"),
        )
    )


def result_json(results: DataFrame) -> DataFrame:
    body = F.struct(*[F.col(c) for c in results.columns if c != "part_no"])
    return results.select("job_id", "part_no", F.to_json(body).alias("result"))


def event_outbox(jobs: DataFrame, data: Column | None = None) -> DataFrame:
    """Event payloads of jobs that reached a reportable status."""
    name = None
    for status, event in vocab.EVENT_BY_STATUS.items():
        hit = F.col("status") == status
        name = F.when(hit, event) if name is None else name.when(hit, event)
    stamp = F.date_format("completed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    named = jobs.withColumn("event", name).filter(F.col("event").isNotNull())
    payload = F.struct(
        "event",
        F.col("job_id").cast("string").alias("job_id"),
        F.col("account_id").cast("string").alias("account_id"),
        stamp.alias("timestamp"),
        (data if data is not None else F.struct("status")).alias("data"),
    )
    return named.select("job_id", "event", F.to_json(payload).alias("payload"))


def stage_rows(jobs: DataFrame) -> DataFrame:
    """Nine stage rows per job with the state of each."""
    return jobs.select("job_id", "status", F.inline(stage_track(F.col("status"))))


# --- usage and accuracy ------------------------------------------------------------


def status_counts(jobs: DataFrame, by: list[str] | None = None) -> DataFrame:
    done = F.count_if(F.col("status") == "complete")
    return (
        jobs.groupBy(*(by or []))
        .agg(
            F.count("*").alias("total"),
            done.alias("completed"),
            F.count_if(F.col("status") == "needs_review").alias("needs_review"),
            F.count_if(F.col("status") == "failed").alias("failed"),
        )
        .withColumn(
            "completion_pct",
            F.coalesce(
                F.round(F.try_divide(F.col("completed") * 100, F.col("total")), 0), F.lit(0)
            ).cast("bigint"),
        )
    )


def in_period(df: DataFrame, day: Column, as_of: Column, days: int) -> DataFrame:
    """Rows whose day lies in the ``days`` before ``as_of``, both ends included."""
    return df.filter(day.between(F.date_sub(as_of, days), as_of))


def usage_totals(usage: DataFrame) -> DataFrame:
    """Calls, cache hits and hit rate; zero when nothing was called."""
    calls, hits = F.sum("request_count"), F.sum("cache_hit_count")
    return usage.groupBy().agg(
        F.coalesce(calls, F.lit(0)).alias("total_calls"),
        F.coalesce(hits, F.lit(0)).alias("cache_hits"),
        F.coalesce(F.round(F.try_divide(hits, calls), 2), F.lit(0.0)).alias("cache_hit_rate"),
    )


def usage_by_provider(usage: DataFrame) -> DataFrame:
    return usage.groupBy("provider").agg(F.sum("request_count").alias("calls"))


def requests_on_day(usage: DataFrame, provider: str, day: Column) -> DataFrame:
    """Requests of one provider on one day; zero without any row."""
    mine = usage.filter((F.col("provider") == provider) & (F.col("log_date") == day))
    return mine.groupBy().agg(F.coalesce(F.sum("request_count"), F.lit(0)).alias("requests"))


def daily_totals(usage: DataFrame, day: Column | None = None) -> DataFrame:
    picked = usage if day is None else usage.filter(F.col("log_date") == day)
    return picked.orderBy(F.desc("log_date"), "provider", "model")


def daily_trend(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Jobs and documents created per day, added up in one grouping."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    rows = jobs.select(
        F.to_date("created_at").alias("day"), one.alias("jobs"), zero.alias("documents")
    ).unionByName(
        documents.select(
            F.to_date("created_at").alias("day"), zero.alias("jobs"), one.alias("documents")
        )
    )
    return rows.groupBy("day").agg(
        F.sum("jobs").alias("jobs"), F.sum("documents").alias("documents")
    )


def documents_by_type(documents: DataFrame) -> DataFrame:
    """Documents and mean class confidence per type."""
    return documents.groupBy("doc_type").agg(
        F.count("*").alias("documents"),
        rounded_mean(
            F.sum(thousandths(F.col("class_confidence"))), F.count("class_confidence")
        ).alias("avg_confidence"),
    )


def review_rates(jobs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Share of jobs sent to review, and of reviews settled by a correction."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    corrected = (F.col("resolution") == "corrected").cast("bigint")
    rows = jobs.select(
        "job_id", one.alias("jobs"), zero.alias("reviews"), zero.alias("corrected")
    ).unionByName(
        reviews.select(
            "job_id",
            zero.alias("jobs"),
            one.alias("reviews"),
            F.coalesce(corrected, F.lit(0)).alias("corrected"),
        )
    )
    per_job = rows.groupBy("job_id").agg(
        F.sum("jobs").alias("jobs"),
        F.sum("reviews").alias("reviews"),
        F.sum("corrected").alias("corrected"),
    )
    return (
        per_job.groupBy()
        .agg(
            F.sum("jobs").alias("jobs"),
            F.count_if(F.col("reviews") > 0).alias("reviewed_jobs"),
            F.sum("reviews").alias("reviews"),
            F.sum("corrected").alias("corrected"),
        )
        .select(
            "jobs",
            "reviewed_jobs",
            F.coalesce(F.round(F.try_divide("reviewed_jobs", "jobs"), 4), F.lit(0.0)).alias(
                "review_rate"
            ),
            F.coalesce(F.round(F.try_divide("corrected", "reviews"), 4), F.lit(0.0)).alias(
                "correction_rate"
            ),
        )
    )


def processing_percentiles(jobs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Median, 90th and 99th percentile of whole seconds from creation to completion.

    Seconds are counted first, so the percentile step reads one row per
    distinct duration instead of one per job.
    """
    by = by or []
    micros = F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(
        F.col("created_at").cast("timestamp")
    )
    counted = (
        jobs.filter(F.col("completed_at").isNotNull())
        .select(*by, F.floor(micros / 1000000).cast("bigint").alias("seconds"))
        .groupBy(*by, "seconds")
        .agg(F.count("*").alias("_n"))
    )

    def at(p: float) -> Column:
        return F.round(F.percentile("seconds", p, F.col("_n")), 3)

    return counted.groupBy(*by).agg(
        F.sum("_n").alias("jobs"),
        at(0.5).alias("p50_seconds"),
        at(0.9).alias("p90_seconds"),
        at(0.99).alias("p99_seconds"),
    )
