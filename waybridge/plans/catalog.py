"""Named queries over the input tables, one per operator or report."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybridge import vocab
from waybridge.functions import display, replies, scoring, sqlfunctions, text, values
from waybridge.operators import (
    classify,
    confidence,
    evaluate,
    extract,
    match,
    normalize,
    requests,
    review,
    split,
    validate,
    vocabulary,
)
from waybridge.plans import endtoend, reports
from waybridge.plans import fixtures as fx
from waybridge.session import durable_dir, materialized
from waybridge.sources import pages as pg
from waybridge.sources import keyed, store, uploads
from waybridge.streaming import batches
from waybridge.streaming import jobs as streams
from waybridge.streaming import limiter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AS_OF = "2024-01-31 00:00:00"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, times and dates as text."""
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f.name)
        if kind.startswith("decimal"):
            c = c.cast("double")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return df.select(*out)


# --- match --------------------------------------------------------------------------


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return match.match_shipments(
        fx.charges(spark, d), fx.quantities(spark, d), fx.shipments(spark, d)
    )


@query
def match_shipment(spark, d):
    return plain(_matches(spark, d))


@query
def match_reasons(spark, d):
    rolled = match.shipment_reasons(_matches(spark, d))
    return rolled.withColumn("reasons", F.array_join("reasons", "; "))


@query
def discrepancy_rows(spark, d):
    return plain(match.discrepancy_reasons(_matches(spark, d)))


@query
def quantity_variance(spark, d):
    lines = match.quantity_lines(fx.quantities(spark, d), fx.shipments(spark, d))
    flagged = match.flagged_lines(lines)
    return plain(flagged.filter(F.col("discrepancy_flag") != "none").drop("line_ord"))


@query
def match_unmapped(spark, d):
    """Match with invoice categories kept as written and duplicate charges added up."""
    out = match.match_shipments(
        fx.charges(spark, d),
        fx.quantities(spark, d),
        fx.shipments(spark, d),
        map_invoice=False,
        duplicates="sum",
    )
    return plain(
        out.groupBy("line_item", "discrepancy_flag").agg(
            F.count("*").alias("n"), F.sum("discrepancy_amount").alias("amount")
        )
    )


@query
def shipment_lines(spark, d):
    """Charge lines of each (account, load number) shipment with the papers that name them."""
    rows = fx.charges(spark, d).select(
        (F.col("shipment_id") % 100).alias("account_id"),
        F.concat(F.lit("RC-"), F.col("shipment_id").cast("string")).alias("load_number"),
        "category",
        "doc_type",
    )
    return (
        rows.select(
            match.shipment_key().alias("shipment_id"),
            match.line_name(F.col("category"), F.col("doc_type")).alias("line_item"),
            "doc_type",
        )
        .groupBy("shipment_id", "line_item")
        .agg(
            F.count_if(F.col("doc_type") == "rate_con").alias("agreed_rows"),
            F.count_if(F.col("doc_type") == "invoice").alias("billed_rows"),
        )
    )


@query
def shipment_papers(spark, d):
    papers = match.assemble_shipments(fx.documents(spark, d), ["load_number", "class_confidence"])
    return plain(
        papers.select(
            "shipment_id",
            *[F.col(t)["document_id"].alias(f"{t}_document") for t in vocab.DOC_TYPES],
            *[F.trim(F.col(t)["load_number"]).alias(f"{t}_load") for t in vocab.DOC_TYPES],
        )
    )


# --- validation ---------------------------------------------------------------------


def _required(spark, d):
    return validate.required_issues(fx.documents(spark, d), fx.fields(spark, d))


def _money(spark, d):
    return validate.money_components(fx.totals(spark, d), fx.charges_of_documents(spark, d))


def _issues(spark, d):
    return validate.all_issues(
        _required(spark, d),
        validate.date_issues(fx.wide(spark, d)),
        validate.money_issues(_money(spark, d)),
        validate.load_issues(fx.documents(spark, d)),
    )


@query
def required_fields(spark, d):
    return _required(spark, d)


@query
def date_sanity(spark, d):
    return validate.date_issues(fx.wide(spark, d))


@query
def money_sanity(spark, d):
    return plain(_money(spark, d))


@query
def money_sanity_issues(spark, d):
    return validate.money_issues(_money(spark, d))


@query
def load_xref(spark, d):
    return validate.load_conflicts(fx.documents(spark, d))


@query
def all_issues(spark, d):
    return (
        _issues(spark, d)
        .groupBy("rule", "severity", "field", "doc_type")
        .agg(F.count("*").alias("issues"), F.count_distinct("job_id").alias("jobs"))
    )


@query
def document_validity(spark, d):
    return validate.validity(fx.documents(spark, d), _issues(spark, d))


@query
def job_validity(spark, d):
    return validate.validity(fx.documents(spark, d), _issues(spark, d), "job_id")


# --- normalisation ------------------------------------------------------------------


@query
def normalize_money(spark, d):
    price = fx.money(F.col("l_extendedprice")).cast("string")
    n = F.col("l_orderkey") + F.col("l_linenumber")
    raw = (
        F.when(n % 8 == 0, F.concat(F.lit("$"), F.format_number(fx.money(F.col("l_extendedprice")), 2)))
        .when(n % 8 == 1, F.concat(F.lit("("), price, F.lit(")")))
        .when(n % 8 == 2, F.concat(F.lit("-$"), price))
        .when(n % 8 == 3, F.concat(price, F.lit(" cad")))
        .when(n % 8 == 4, F.concat(F.lit('{"amount": '), price, F.lit(', "currency": "MXN"}')))
        .when(n % 8 == 5, F.concat(F.lit("  € "), price, F.lit("  ")))
        .when(n % 8 == 6, F.concat(price, F.lit("d")))
        .otherwise("n/a")
    )
    money = values.normalize_money(F.col("raw"))
    return plain(
        fx.table(spark, d, "lineitem")
        .select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", raw.alias("raw"))
        .withColumn("m", money)
        .select(
            "l_orderkey",
            "l_partkey",
            "l_suppkey",
            "l_linenumber",
            F.col("m.amount").alias("amount"),
            F.col("m.currency").alias("currency"),
            values.detected_currency(F.col("raw")).alias("currency_detected"),
        )
    )


@query
def normalize_date(spark, d):
    day = F.to_date("o_orderdate")
    n = F.col("o_orderkey") % 10
    spelled = (
        F.when(n < 6, fx.spelled_date(day, n))
        .when(n == 6, F.date_format(day, "M/d/yy"))
        .when(n == 7, F.date_format(day, "dd.MM.yyyy"))
        .when(n == 8, F.concat(F.date_format(day, "d/M/yyyy"), F.lit(" 10:30")))
        .otherwise(F.concat(F.lit("on "), F.date_format(day, "yyyy-MM-dd")))
    )
    return plain(
        fx.table(spark, d, "orders").select(
            "o_orderkey", values.normalize_date(spelled).alias("day")
        )
    )


@query
def normalize_weight(spark, d):
    n = F.col("l_partkey") % 7
    unit = fx.pick(n, " lbs", " KG", " tons", "", " widgets", " oz", "kilograms")
    raw = F.concat(F.format_number(fx.money(F.col("l_extendedprice")), 2), unit)
    raw = F.when(F.col("l_suppkey") % 10 == 0, F.lit("about 12")).otherwise(raw)
    return plain(
        fx.table(spark, d, "lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
            values.normalize_weight(raw).alias("pounds"),
        )
    )


LABELS = [
    "Detention Charge", "fee", "LAYOVER", "Lumper Fee (night)", "unloading", "Stop-Off", "extra stop 2",
    "tarps", "  ", "misc handling", "overnight", "Tarp",
]


@query
def normalize_accessorial(spark, d):
    label = fx.pick(F.col("p_partkey") % 12, *LABELS)
    return fx.table(spark, d, "part").select(
        "p_partkey",
        values.charge_type(label).alias("charge_type"),
        F.trim(label).alias("raw_label"),
    )


@query
def normalize_fields(spark, d):
    return normalize.normalize_fields(fx.fields(spark, d)).select(
        "document_id", "field_name", "field_value"
    )


@query
def canonical_documents(spark, d):
    ready = normalize.normalize_fields(extract.known_fields(fx.fields(spark, d)))
    return plain(
        normalize.wide_documents(ready).drop("accessorials", "line_items")
    )


@query
def nested_charges(spark, d):
    """Charge lines read out of the nested lists of canonical documents."""
    ready = normalize.normalize_fields(extract.known_fields(fx.fields(spark, d)))
    return plain(normalize.charge_lines(normalize.wide_documents(ready)))


@query
def amount_reading(spark, d):
    price = fx.money(F.col("l_extendedprice")).cast("string")
    n = F.col("l_partkey") % 5
    raw = (
        F.when(n == 0, F.concat(F.lit("$"), price))
        .when(n == 1, F.concat(F.lit('{"amount": "'), price, F.lit('"}')))
        .when(n == 2, F.concat(F.lit("1,"), price))
        .when(n == 3, F.lit("none"))
        .otherwise(price)
    )
    quantity = F.col("l_quantity") + F.when(F.col("l_suppkey") % 2 == 0, 0.5).otherwise(0.0)
    day = F.when(n == 3, F.lit("soon")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    return plain(
        fx.table(spark, d, "lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
            values.amount_of(raw).alias("amount"),
            values.money_text(values.amount_of(raw)).alias("amount_text"),
            values.quantity_text(values.quantity_of(quantity.cast("string"))).alias("quantity_text"),
            values.iso_date(day).alias("ship_day"),
        )
    )


# --- confidence and routing ---------------------------------------------------------


def _scored(spark, d):
    n = F.col("document_id") + F.length("field_name")
    fields = fx.fields(spark, d)
    return confidence.score_fields(
        fields.withColumn("agreed", F.when(n % 3 != 0, n % 3 == 1))
        .withColumn("certainty", F.when(n % 2 == 0, (n % 1000 / 1000.0).cast("decimal(4,3)")))
        .withColumn("confidence", F.when(n % 7 != 0, F.col("confidence")))
    )


def _confidences(spark, d):
    return confidence.document_confidence(fx.documents(spark, d), _scored(spark, d))


@query
def field_confidence(spark, d):
    return plain(_scored(spark, d).select("document_id", "field_name", "confidence"))


@query
def document_confidence(spark, d):
    return plain(
        _confidences(spark, d).select(
            "document_id", "doc_type", "document_confidence", "class_confidence", "fields",
            "missing_required",
        )
    )


@query
def lowest_field(spark, d):
    return plain(
        _confidences(spark, d).select("document_id", "lowest_field", "lowest_confidence")
    )


@query
def confidence_bands(spark, d):
    docs = _confidences(spark, d).select(
        "document_id",
        scoring.confidence_band(F.col("document_confidence"), "document").alias("document_band"),
        scoring.confidence_band(F.col("lowest_confidence"), "field").alias("lowest_field_band"),
    )
    return docs.groupBy("document_band", "lowest_field_band").agg(F.count("*").alias("documents"))


def _document_reasons(spark, d):
    return confidence.combined_reasons(
        confidence.low_document_reasons(_confidences(spark, d)),
        confidence.low_field_reasons(_scored(spark, d)),
    )


@query
def hitl_route(spark, d):
    return plain(_document_reasons(spark, d))


def _all_reasons(spark, d):
    job = F.floor(F.col("document_id") / 4).alias("job_id")
    by_document = confidence.combined_reasons(
        _document_reasons(spark, d),
        confidence.validation_reasons(_issues(spark, d)),
        confidence.failed_document_reasons(fx.documents(spark, d)),
    ).select(job, "reason_ord", "reason")
    by_shipment = match.discrepancy_reasons(_matches(spark, d)).select(
        F.col("shipment_id").alias("job_id"), F.lit(3).alias("reason_ord"), "reason"
    )
    return by_document.unionByName(by_shipment)


@query
def review_reasons_all(spark, d):
    return plain(
        _all_reasons(spark, d).groupBy("job_id", "reason_ord", "reason").agg(F.count("*").alias("n"))
    )


@query
def review_reason(spark, d):
    return confidence.routed(_all_reasons(spark, d), "job_id")


@query
def reason_priority(spark, d):
    """Main reason of short reason lists."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("bigint")
    names = ["llm_capacity", "validation_failed: x", "classification unsure", "low_confidence: bol", "discrepancy: none"]
    listed = F.filter(
        F.array(*[F.when(F.shiftright(k, i) % 2 == 1, n) for i, n in enumerate(names)]),
        lambda x: x.isNotNull(),
    )
    return fx.table(spark, d, "events").select(
        "event_id", confidence.primary_reason(listed).alias("primary_reason")
    )


@query
def partial_failure(spark, d):
    return confidence.partial_failures(fx.documents(spark, d))


def _verifications(spark, d):
    n = F.col("document_id") + F.length("field_name")
    body = F.concat(
        F.lit('{"agreed": '), F.when(n % 4 == 0, "false").otherwise("true"),
        F.lit(', "certainty": '), (n % 13 / 10).cast("string"), F.lit("}"),
    )
    reply = (
        F.when(n % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(n % 5 == 1, F.lit("I think so"))
        .otherwise(body)
    )
    return fx.fields(spark, d).filter(n % 6 != 0).select(
        "document_id", "field_name", reply.alias("reply")
    )


@query
def verified_confidence(spark, d):
    checked = confidence.with_verdicts(fx.fields(spark, d), _verifications(spark, d))
    return plain(
        confidence.score_fields(checked).select(
            "document_id", "field_name", "agreed", "certainty", "confidence"
        )
    )


@query
def mean_confidence(spark, d):
    return plain(extract.mean_confidence(fx.fields(spark, d)))


# --- classification and extraction --------------------------------------------------


@query
def classify_scores(spark, d):
    return classify.score_columns(fx.texts(spark, d))


@query
def classify_top2(spark, d):
    return classify.classify(fx.texts(spark, d)).select(
        "document_id", "doc_type", "top_score", "second_type", "second_score", "needs_model"
    )


@query
def escalation_set(spark, d):
    return (
        classify.classify(fx.texts(spark, d))
        .filter("needs_model")
        .select("document_id", "doc_type", "top_score")
    )


def _class_replies(df: DataFrame) -> DataFrame:
    n = F.col("document_id")
    kind = fx.pick(n % 6, *vocab.DOC_TYPES, "unknown", "parcel")
    return df.filter(n % 11 != 0).select(
        "document_id",
        F.when(n % 3 == 0, F.concat(F.lit("probably "), kind))
        .otherwise(F.concat(F.lit('{"doc_type": "'), kind, F.lit('"}')))
        .alias("reply"),
    )


@query
def escalated_class(spark, d):
    found = classify.classify(fx.texts(spark, d))
    asked = _class_replies(fx.texts(spark, d).select("document_id"))
    return classify.settle_types(found, asked).select(
        "document_id", "doc_type", "class_confidence", "method"
    )


@query
def vision_override(spark, d):
    docs = fx.documents(spark, d).select("document_id", "doc_type")
    return classify.override_from_vision(docs, _class_replies(docs))


@query
def rule_extract(spark, d):
    return plain(extract.rule_fields(fx.texts(spark, d)))


@query
def strict_numbers(spark, d):
    t = F.upper("text")
    return fx.texts(spark, d).select(
        "document_id",
        text.rule_load_number(t).alias("own_number"),
        text.rule_load_number(t, strict=True).alias("load_number"),
    )


@query
def ocr_garbage(spark, d):
    return fx.table(spark, d, "documents").select(
        "doc_id", text.looks_garbled(F.col("text")).alias("garbled")
    )


@query
def scan_detect(spark, d):
    return extract.scan_report(fx.text_pages(spark, d)).drop("route")


@query
def extraction_route(spark, d):
    return extract.scan_report(fx.text_pages(spark, d)).select("job_id", "route")


@query
def segment_text(spark, d):
    pages = fx.text_pages(spark, d)
    out = pg.range_texts(pages, pg.fixed_ranges(pages, 8))
    return out.select(
        "job_id", "page_start", "page_end", "part_no", "pages",
        F.length("text").alias("chars"), F.sha2("text", 256).alias("text_hash"),
    ).transform(plain)


@query
def pages_in_segments(spark, d):
    pages = fx.text_pages(spark, d)
    ranges = pg.fixed_ranges(pages, 5).filter(F.col("page_start") % 2 == 1)
    return plain(
        pg.pages_in_ranges(pages.select("job_id", "page_no"), ranges)
    )


@query
def page_digest(spark, d):
    out = split.page_digests(fx.text_pages(spark, d), page_chars=80, digest_chars=400, block=64)
    return plain(
        out.select("job_id", "part_no", "pages", F.sha2("digest", 256).alias("digest_hash"))
    )


# --- splitting ----------------------------------------------------------------------


@query
def header_type(spark, d):
    return plain(
        split.with_header_type(fx.header_pages(spark, d)).select(
            "job_id", "page_no", "header_type"
        )
    )


@query
def page_headers(spark, d):
    """Header text of every general document, taken as a page top."""
    head = text.header_text(F.col("text"))
    return fx.table(spark, d, "documents").select(
        "doc_id",
        F.length(head).alias("chars").cast("bigint"),
        F.size(F.split(head, "\n")).cast("bigint").alias("lines"),
    )


@query
def split_header(spark, d):
    return plain(split.header_segments(fx.header_pages(spark, d), block=4))


@query
def split_header_repeat(spark, d):
    return plain(
        split.header_segments(fx.header_pages(spark, d), split_on_repeat=True, block=4)
    )


@query
def split_layout(spark, d):
    return plain(split.layout_segments(fx.header_pages(spark, d), block=4))


def _split_replies(spark, d):
    n = F.col("conv_id")
    two = '[{"page_start": 1, "page_end": 2, "doc_type": "bol"}, {"page_start": 3, "page_end": 4}]'
    reply = (
        F.when(n % 4 == 0, F.lit(two))
        .when(n % 4 == 1, F.concat(F.lit('```json\n{"segments": '), F.lit(two), F.lit("}\n```")))
        .when(n % 4 == 2, F.lit('[{"page_start": 1, "page_end": 9}, {"page_end": 3}]'))
        .otherwise("cannot tell")
    )
    return (
        fx.table(spark, d, "conversations")
        .filter(F.col("turn") == 0)
        .select(n.alias("job_id"), reply.alias("reply"))
    )


@query
def proposed_segments(spark, d):
    return plain(split.proposed_segments(_split_replies(spark, d)))


@query
def split_choose(spark, d):
    return plain(
        split.choose_segments(fx.header_pages(spark, d), _split_replies(spark, d), block=4)
    )


@query
def layout_features(spark, d):
    """Layout numbers per document line, words taken as glyph runs of one point per letter."""
    words = (
        fx.text_pages(spark, d)
        .select("job_id", "page_no", F.explode(F.split("text", " ")).alias("w"))
        .select(
            "job_id",
            "page_no",
            F.when(F.length("w") % 5 != 4, (8 + F.length("w") % 3).cast("double")).alias("font_size"),
            (20 + F.length("w") * 2).cast("double").alias("top"),
            F.when(F.col("w") != "", F.col("w")).alias("text"),
            F.lit(484704.0).alias("page_area"),
        )
    )
    return plain(split.page_layout(words))


# --- listings -----------------------------------------------------------------------


@query
def jobs_page(spark, d):
    page = reports.keyset_page(
        fx.jobs(spark, d), "job_id", limit=50, before=("2024-01-15 00:00:00", 10**12), status="complete"
    )
    return plain(page.select("job_id", "account_id", "created_at", "next_created_at", "next_key"))


@query
def jobs_offset(spark, d):
    page = reports.offset_page(fx.jobs(spark, d), "job_id", limit=20, offset=30)
    return plain(page.select("job_id", "created_at"))


@query
def recent_jobs(spark, d):
    return plain(reports.recent_jobs(fx.jobs(spark, d)).select("job_id", "status", "created_at"))


@query
def review_fifo(spark, d):
    return plain(
        reports.oldest_first(fx.reviews(spark, d), "discrepancy").select(
            "item_id", "job_id", "created_at"
        )
    )


@query
def canonical_order(spark, d):
    return plain(
        reports.in_canonical_order(fx.documents(spark, d), "documents").select(
            "job_id", "document_id", "page_start"
        )
    )


@query
def account_jobs(spark, d):
    kept = fx.jobs(spark, d).filter(
        store.all_of(store.equal_if("account_id", 7), store.equal_if("status", None))
    )
    return plain(kept.select("job_id", "status", "created_at"))


@query
def jobs_list(spark, d):
    listed = reports.job_listing(
        fx.jobs(spark, d), fx.documents(spark, d), fx.reviews(spark, d)
    )
    return plain(
        listed.select(
            "job_id", "status", "document_count", "review_required",
            F.coalesce(F.array_join("review_reasons", ","), F.lit("")).alias("review_reasons"),
        )
    )


@query
def review_owned(spark, d):
    owned = reports.owned_reviews(fx.reviews(spark, d), fx.jobs(spark, d))
    return plain(owned.select("item_id", "job_id", "account_id", "reason"))


@query
def account_documents(spark, d):
    return plain(
        reports.of_account(fx.documents(spark, d).drop("account_id"), fx.jobs(spark, d), 7).select(
            "document_id", "job_id", "doc_type"
        )
    )


@query
def pending_count(spark, d):
    return reports.pending_reviews(fx.reviews(spark, d))


@query
def field_lookup(spark, d):
    fields = reports.fields_named(fx.fields(spark, d), "weight")
    return fields.select("document_id", "field_value")


@query
def key_lookup(spark, d):
    return plain(store.by_key(fx.jobs(spark, d), job_id=42).select("job_id", "status"))


@query
def field_highlights(spark, d):
    drawn = reports.highlights(fx.fields(spark, d), page=2).withColumn(
        "box", reports.bbox_struct(F.col("source_bbox"))
    )
    return plain(
        drawn.select(
            "document_id", "field_name", F.col("box.x").alias("x"), F.col("box.h").alias("h")
        )
    )


@query
def status_groups(spark, d):
    jobs = fx.jobs(spark, d)
    return jobs.groupBy(
        display.status_group(F.col("status")).alias("status_group"),
        display.is_terminal(F.col("status")).alias("terminal"),
    ).agg(F.count("*").alias("jobs"))


@query
def job_detail(spark, d):
    jobs = fx.jobs(spark, d).select("job_id", "status")
    detail = reports.job_details(jobs, fx.documents(spark, d))
    shown = F.transform(
        "documents",
        lambda x: F.concat_ws(
            ":", x["document_id"].cast("string"), x["doc_type"], x["page_start"].cast("string"),
            x["page_end"].cast("string"),
        ),
    )
    return plain(
        detail.select(
            "job_id", "status", "part_no",
            F.coalesce(F.array_join(shown, ","), F.lit("")).alias("documents"),
        )
    )


def _results(spark, d):
    jobs = fx.jobs(spark, d)
    return reports.result_documents(
        jobs,
        fx.documents(spark, d),
        fx.fields(spark, d),
        _matches(spark, d),
        fx.reviews(spark, d),
        _confidences(spark, d),
    )


@query
def result_document(spark, d):
    r = _results(spark, d)
    docs = F.coalesce(F.col("documents"), F.array().cast(r.schema["documents"].dataType))
    total = F.aggregate(
        docs,
        F.lit(0).cast("bigint"),
        lambda a, x: a + F.coalesce(F.size(F.map_keys(x["fields"])), F.lit(0)),
    )
    return plain(
        r.select(
            "job_id", "part_no", "shipment_id",
            F.size(docs).alias("documents"),
            total.alias("fields"),
            F.coalesce(F.size("match_results"), F.lit(0)).alias("match_lines"),
            "review_required",
            F.coalesce(F.array_join("review_reasons", ";"), F.lit("")).alias("review_reasons"),
        )
    )


@query
def result_json(spark, d):
    """Whole nested results as JSON text, one row per job part."""
    out = reports.result_json(_results(spark, d))
    return out.select(
        "job_id",
        F.get_json_object("result", "$.shipment_id").alias("shipment_id"),
        F.get_json_object("result", "$.documents[0].doc_type").alias("first_type"),
        F.get_json_object("result", "$.documents[0].fields.load_number.value").alias("first_load"),
    )


@query
def event_outbox(spark, d):
    return reports.event_outbox(fx.jobs(spark, d))


@query
def stage_track(spark, d):
    return plain(reports.stage_rows(fx.jobs(spark, d)))


@query
def display_labels(spark, d):
    m = _matches(spark, d)
    return plain(
        m.filter(F.col("discrepancy_amount").isNotNull()).select(
            "shipment_id",
            "line_item",
            display.flag_label(F.col("discrepancy_flag")).alias("flag_label"),
            display.signed_dollars(F.col("discrepancy_amount")).alias("amount_label"),
            display.money_display(F.col("discrepancy_amount"), F.lit("USD")).alias("amount_text"),
        )
    )


@query
def review_labels(spark, d):
    return fx.reviews(spark, d).select(
        "item_id", display.reason_label(F.col("reason")).alias("reason_label")
    )


@query
def method_labels(spark, d):
    return (
        fx.fields(spark, d)
        .groupBy(display.method_label(F.col("extraction_method")).alias("method_label"))
        .agg(F.count("*").alias("fields"))
    )


@query
def age_buckets(spark, d):
    return fx.jobs(spark, d).select(
        "job_id", display.age_text(F.col("created_at"), as_of()).alias("age")
    )


@query
def decode_value(spark, d):
    decoded = display.decoded_value(F.col("field_value"))
    kind = F.schema_of_variant(decoded)
    return fx.fields(spark, d).select(
        "document_id",
        "field_name",
        F.when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .otherwise("number")
        .alias("kind"),
        F.when(kind == "STRING", decoded.cast("string")).alias("text_value"),
    )


# --- usage and analytics ------------------------------------------------------------


def _usage(spark, d):
    return store.count_usage(fx.calls(spark, d))


def _recent_usage(spark, d, days=7):
    return reports.in_period(_usage(spark, d), F.col("log_date"), F.to_date(as_of()), days)


@query
def usage_counters(spark, d):
    return plain(_usage(spark, d))


@query
def usage_by_provider(spark, d):
    return reports.usage_by_provider(_recent_usage(spark, d))


@query
def cache_hit_rate(spark, d):
    return reports.usage_totals(_recent_usage(spark, d, 30))


@query
def daily_totals(spark, d):
    return plain(reports.daily_totals(_usage(spark, d), F.to_date(F.lit("2024-01-10"))))


@query
def requests_today(spark, d):
    return reports.requests_on_day(_usage(spark, d), "gemini", F.to_date(F.lit("2024-01-10")))


@query
def budget_headroom(spark, d):
    return requests.budget_headroom(_usage(spark, d), F.to_date(F.lit("2024-01-10")))


@query
def job_status_counts(spark, d):
    return reports.status_counts(fx.jobs(spark, d), ["account_id"])


@query
def documents_per_job(spark, d):
    return reports.documents_per_job(fx.documents(spark, d))


@query
def analytics_percentiles(spark, d):
    return plain(reports.processing_percentiles(fx.jobs(spark, d), ["status"]))


@query
def daily_trend(spark, d):
    return plain(reports.daily_trend(fx.jobs(spark, d), fx.documents(spark, d)))


@query
def documents_by_type(spark, d):
    return plain(reports.documents_by_type(fx.documents(spark, d)))


@query
def review_rates(spark, d):
    return reports.review_rates(fx.jobs(spark, d), fx.reviews(spark, d))


# --- stored tables ------------------------------------------------------------------


@query
def idempotent_ingest(spark, d):
    return store.first_submissions(fx.jobs(spark, d)).select(
        "job_id", "answer_job_id", "idempotent_replay"
    )


@query
def idempotent_ingest_known(spark, d):
    """Later submissions answered from the jobs of the first half of the month."""
    jobs = fx.jobs(spark, d)
    cut = F.lit("2024-01-16").cast("timestamp")
    out = store.first_submissions(
        jobs.filter(F.col("created_at") >= cut), jobs.filter(F.col("created_at") < cut)
    )
    return out.select("job_id", "answer_job_id", "idempotent_replay")


@query
def new_jobs(spark, d):
    jobs = fx.jobs(spark, d)
    cut = F.lit("2024-01-16").cast("timestamp")
    fresh = store.new_jobs(
        jobs.filter(F.col("created_at") >= cut), jobs.filter(F.col("created_at") < cut)
    )
    return plain(fresh.select("job_id", "account_id", "idempotency_key", "created_at"))


@query
def cache_upsert(spark, d):
    r = fx.responses(spark, d)
    half = F.lit("2024-01-16").cast("timestamp")
    merged = store.upsert_latest(
        r.filter(F.col("created_at") < half),
        r.filter(F.col("created_at") >= half),
        ["cache_key"],
        ["created_at", "response_id"],
    )
    return merged.select("cache_key", "response_id", "provider")


@query
def cache_live(spark, d):
    r = fx.responses(spark, d)
    live = store.live_entries(r, as_of()).groupBy("provider").agg(F.count("*").alias("live"))
    dead = store.expired_entries(r, as_of()).groupBy("provider").agg(F.count("*").alias("expired"))
    return live.join(dead, "provider", "full")


@query
def update_coalesce(spark, d):
    docs = fx.documents(spark, d).select("document_id", "doc_type", "class_confidence", "load_number")
    changes = docs.filter(F.col("document_id") % 5 == 0).select(
        "document_id",
        F.when(F.col("document_id") % 2 == 0, "unknown").alias("doc_type"),
        F.when(F.col("document_id") % 3 == 0, F.lit("0.500").cast("decimal(4,3)")).alias(
            "class_confidence"
        ),
    )
    return plain(
        store.update_rows(docs, changes, "document_id", ["doc_type", "class_confidence"]).drop(
            "load_number"
        )
    )


@query
def status_update(spark, d):
    jobs = fx.jobs(spark, d)
    e = F.col("job_id")
    changes = jobs.filter(e % 4 == 0).select(
        e.alias("job_id"),
        fx.pick(e % 3, "failed", "scoring", "complete").alias("status"),
        F.when(e % 3 == 0, '{"code":"x"}').alias("error"),
        as_of().alias("changed_at"),
    )
    out = store.update_job_status(jobs, changes)
    return plain(out.select("job_id", "status", "error", "completed_at"))


@query
def delete_cascade(spark, d):
    docs = fx.documents(spark, d)
    tables = {
        "jobs": fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id")),
        "documents": docs,
        "extracted_fields": fx.fields(spark, d).select("document_id", "field_name"),
        "review_queue": fx.reviews(spark, d),
    }
    doomed = tables["jobs"].filter(F.col("job_id") % 3 == 0)
    left = store.delete_jobs(tables, doomed)
    parts = [
        left[n].groupBy().agg(F.lit(n).alias("table_name"), F.count("*").alias("n")) for n in tables
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def keyed_upsert(spark, d):
    """The cache as a bucketed table: made from the older half, then changed by the newer one."""
    r = fx.responses(spark, d)
    half = F.lit("2024-01-16").cast("timestamp")
    cache = keyed.KeyedTable(spark, durable_dir(spark, "cache") + "/responses", ["cache_key"], buckets=16)
    order = ["created_at", "response_id"]
    cache.create(store.latest_by(r.filter(F.col("created_at") < half), ["cache_key"], order))
    cache.upsert(r.filter(F.col("created_at") >= half), order)
    return cache.read().select("cache_key", "response_id", "provider")


@query
def keyed_counters(spark, d):
    """Usage counters of a stored table, a day added to those before it."""
    calls = fx.calls(spark, d).withColumn("log_date", F.to_date("ts"))
    last = F.lit("2024-01-16").cast("date")
    path = durable_dir(spark, "usage") + "/counters"
    usage = keyed.KeyedTable(spark, path, ["provider", "model", "log_date"], buckets=16)
    counters = ["request_count", "cache_hit_count"]
    usage.create(store.count_usage(calls.filter(F.col("log_date") < last)))
    usage.add(store.count_usage(calls.filter(F.col("log_date") >= last)), counters)
    return plain(usage.read())


@query
def cascade_rows(spark, d):
    """What is left of all tables after jobs and shipments were removed."""
    lines = fx.table(spark, d, "lineitem")
    tables = {
        "jobs": fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id")),
        "documents": fx.documents(spark, d).select("document_id", "job_id"),
        "extracted_fields": fx.fields(spark, d).select("document_id", "field_name"),
        "review_queue": fx.reviews(spark, d).select("item_id", "job_id"),
        "shipments": lines.select(F.col("l_orderkey").alias("shipment_id")).distinct(),
        "match_results": lines.select(F.col("l_orderkey").alias("shipment_id"), "l_linenumber"),
    }
    left = store.delete_cascade(
        tables,
        {
            "jobs": ("job_id", tables["jobs"].filter(F.col("job_id") % 3 == 0)),
            "shipments": ("shipment_id", tables["shipments"].filter(F.col("shipment_id") % 5 == 0)),
        },
    )
    rows = [
        t.select(F.lit(n).alias("table_name"), F.concat_ws("|", *(F.col(c).cast("string") for c in t.columns)).alias("row_key"))
        for n, t in left.items()
    ]
    return reduce(DataFrame.unionByName, rows)


@query
def vocabulary_labels(spark, d):
    """Labels named from a table of synonyms, one per part."""
    part = fx.table(spark, d, "part")
    name = F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))
    entries = part.select(name.alias("synonym"), F.col("p_type").alias("name"), F.col("p_partkey").alias("ord"))
    labels = F.array(
        F.concat(F.upper(name), F.lit(" surcharge")),
        F.concat_ws(" ", F.element_at(F.split("p_name", " "), 2), F.col("p_partkey").cast("string")),
        F.concat(F.lit(" "), F.col("p_brand")),
    )
    rows = part.select("p_partkey", F.posexplode(labels).alias("place", "label"))
    return vocabulary.with_names(rows, "label", entries, ["p_partkey", "place"]).select("p_partkey", "place", "charge")


@query
def append_roundtrip(spark, d):
    """Two appends to a stored table, read back."""
    root = durable_dir(spark, "append") + "/match_results"
    m = fx.charges(spark, d)
    store.append(m.filter(F.col("doc_type") == "rate_con"), root)
    store.append(m.filter(F.col("doc_type") == "invoice"), root)
    back = spark.read.parquet(root)
    return plain(
        back.groupBy("doc_type").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
    )


def _uploads(spark, d):
    n = F.col("doc_id") % 4
    body = (
        F.when(n == 0, F.concat(F.lit("%PDF-1.4\n"), F.col("text")))
        .when(n == 1, "")
        .when(n == 2, F.concat(F.lit("PK "), F.col("text")))
        .otherwise(F.concat(F.lit("%PDF"), F.col("text"), F.col("text")))
    )
    content = F.encode(body, "UTF-8")
    return fx.table(spark, d, "documents").select(
        "doc_id", content.alias("content"), F.octet_length(content).alias("length")
    )


@query
def upload_gate(spark, d):
    return uploads.gate_uploads(_uploads(spark, d), limit=4000).select(
        "doc_id", F.col("length").cast("bigint").alias("length"), "reject_code"
    )


@query
def blob_lookup(spark, d):
    blobs = _uploads(spark, d).select(F.col("doc_id").alias("job_id"), "content")
    out = uploads.document_blobs(fx.documents(spark, d), blobs)
    return out.select("document_id", F.octet_length("content").cast("bigint").alias("bytes"))


@query
def job_blob(spark, d):
    blobs = _uploads(spark, d).select(F.col("doc_id").alias("job_id"), "content")
    return uploads.job_blob(blobs, 4).select(F.sha2("content", 256).alias("content_hash"))


# --- requests and replies -----------------------------------------------------------


def _probe_requests(spark, d):
    e = F.col("event_id")
    return fx.table(spark, d, "events").select(
        e.alias("request_id"),
        requests.response_key(
            F.lit("classification_v1"), F.sha2((e % 140).cast("string"), 256), F.lit("1")
        ).alias("cache_key"),
    )


def _stored(spark, d):
    return store.latest_by(fx.responses(spark, d), ["cache_key"], ["created_at", "response_id"])


@query
def cache_probe(spark, d):
    out = requests.probe_responses(_probe_requests(spark, d), _stored(spark, d), as_of(), ["request_id"])
    return out.select(
        "request_id", "cached", replies.reply_doc_type(F.col("response_json")).alias("doc_type")
    )


@query
def missing_responses(spark, d):
    return requests.missing_responses(_probe_requests(spark, d), _stored(spark, d), as_of())


@query
def parse_model_json(spark, d):
    r = F.col("response_json")
    return fx.responses(spark, d).select(
        "response_id",
        replies.reply_doc_type(r).alias("doc_type"),
        F.get_json_object(replies.reply_object(r), "$.n").cast("bigint").alias("n"),
    )


@query
def prompt_requests(spark, d):
    out = requests.classification_requests(fx.texts(spark, d), ["document_id"])
    return plain(
        out.select(
            "document_id", "template", "part_no", "cache_key", F.sha2("prompt", 256).alias("prompt_hash")
        )
    )


@query
def extraction_prompts(spark, d):
    typed = fx.texts(spark, d).withColumn(
        "doc_type", fx.pick(F.col("document_id") % 5, *vocab.DOC_TYPES, "unknown")
    )
    out = requests.extraction_requests(typed, ["document_id"])
    return out.groupBy("template").agg(
        F.count("*").alias("requests"), F.count_distinct("document_id").alias("documents")
    )


@query
def verification_prompts(spark, d):
    asked = fx.texts(spark, d).withColumn("field_name", F.lit("load_number")).withColumn(
        "field_value", F.col("document_id").cast("string")
    )
    out = requests.verification_requests(asked, ["document_id"])
    return plain(out.groupBy("document_id").agg(F.count("*").alias("requests")))


@query
def split_prompts(spark, d):
    digests = split.page_digests(fx.text_pages(spark, d), vocab.DIGEST_PAGE_CHARS, block=64)
    return plain(requests.split_requests(digests).select("job_id", "part_no", "cache_key"))


@query
def merge_fields(spark, d):
    rules = fx.fields(spark, d).filter(F.col("confidence") < 0.8)
    n = F.col("document_id") + F.length("field_name")
    model = fx.fields(spark, d).filter(n % 2 == 0).select(
        "document_id", "field_name", F.when(n % 3 != 0, F.lit("model")).alias("field_value")
    )
    return plain(extract.merge_fields(rules, model))


@query
def schema_enforced(spark, d):
    """Fields of model replies: unknown keys and nulls are dropped."""
    n = F.col("document_id")
    body = F.concat(
        F.lit('{"load_number": "RC-'), n.cast("string"),
        F.lit('", "total_amount": {"amount": 5, "currency": "USD"}, "weight": '),
        F.when(n % 3 == 0, "null").otherwise((n % 100).cast("string")),
        F.lit(', "admin": true}'),
    )
    asked = fx.documents(spark, d).select("document_id", "doc_type", body.alias("reply"))
    return extract.model_fields(asked).drop("doc_type")


@query
def apply_corrections(spark, d):
    n = F.col("document_id") + F.length("field_name")
    changes = fx.fields(spark, d).filter(n % 5 == 0).select(
        "document_id",
        F.when(n % 2 == 0, F.col("field_name")).otherwise(F.concat(F.col("field_name"), F.lit("_2"))).alias("field_name"),
        F.when(n % 3 != 0, n.cast("string")).alias("field_value"),
    )
    return plain(review.corrected_fields(fx.fields(spark, d), changes))


@query
def redact_contacts(spark, d):
    mails, phones = text.contact_counts(F.col("text"))
    return fx.table(spark, d, "documents").select(
        "doc_id",
        F.sha2(text.redact_contacts(F.col("text")), 256).alias("text_hash"),
        mails.cast("bigint").alias("emails"),
        phones.cast("bigint").alias("phones"),
    )


# --- SQL functions ------------------------------------------------------------------

SCALARS = """
SELECT l_orderkey AS order_key, l_linenumber AS line_no,
  normalize_money(CASE l_linenumber % 4 WHEN 0 THEN concat('$', format_number(price, 2)) WHEN 1 THEN concat('(', price, ')')
                  WHEN 2 THEN concat(price, ' cad') ELSE 'n/a' END) AS money,
  money.amount AS total, money.currency AS currency,
  normalize_weight(concat(quantity, ' kg')) AS kilos, normalize_weight(string(quantity), unit => 'oz') AS ounces,
  normalize_date(date_format(l_shipdate, CASE l_suppkey % 3 WHEN 0 THEN 'MM/dd/yyyy' WHEN 1 THEN 'yyyy-MM-dd' ELSE 'MMMM d, yyyy' END)) AS day,
  normalize_accessorial(CASE l_suppkey % 5 WHEN 0 THEN 'Detention charge' WHEN 1 THEN ' LUMPER ' WHEN 2 THEN '' WHEN 3 THEN 'chassis' END) AS charge,
  match_line_item(price, CASE l_suppkey % 3 WHEN 0 THEN price WHEN 1 THEN price + 25 END) AS line,
  line.discrepancy_flag AS flag, signed_dollars(line.discrepancy_amount) AS difference,
  flag_label(flag) AS flag_label, has_discrepancies(array('none', flag)) AS differs,
  score_field_confidence(CASE l_linenumber % 3 WHEN 0 THEN 'rule' WHEN 1 THEN 'ocr' ELSE 'llm_text' END,
                         verification_agreed => l_linenumber % 2 = 0) AS field_score,
  confidence_band(field_score) AS band,
  score_document_confidence('bol', map('weight', field_score, 'remark', 0.6BD), 0.9BD) AS document,
  document.document_confidence AS document_score, document.lowest_field AS lowest_field,
  should_route_to_hitl(array(named_struct('doc_type', 'bol', 'document_confidence', document_score,
                                          'fields', map('weight', field_score)))) AS routing,
  size(routing.reasons) AS reasons, routing.needs_review AS needs_review,
  classify_review_reason(routing.reasons) AS reason,
  can_transition('pending', CASE l_suppkey % 2 WHEN 0 THEN 'in_review' ELSE 'resolved' END) AS may_move,
  resolve_approved(CASE l_suppkey % 2 WHEN 0 THEN 'in_review' ELSE 'pending' END) AS moved,
  moved.state AS state, moved.error AS error,
  money_agrees(price, array(price - 1, 1.01BD + l_linenumber % 2, NULL)) AS sums_up,
  array_join(missing_required('pod', array('signature_present', CASE WHEN l_linenumber > 3 THEN 'recipient_name' END)), ',') AS missing,
  money_tolerance() AS tolerance
FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(12,2)) AS price, CAST(l_quantity AS INT) AS quantity FROM {lineitem})
"""


@query
def sql_scalars(spark, d):
    """The scalar operations called by name in a SQL query."""
    sqlfunctions.register(spark)
    lines = spark.sql(SCALARS, lineitem=fx.table(spark, d, "lineitem"))
    return plain(lines.drop("money", "line", "document", "routing", "moved"))


# --- evaluation ---------------------------------------------------------------------


@query
def field_f1(spark, d):
    truth = fx.fields(spark, d).filter(F.col("field_value") != "  ")
    n = F.col("document_id") + F.length("field_name")
    guess = fx.fields(spark, d).filter(n % 6 != 0).withColumn(
        "field_value", F.when(n % 7 == 0, F.lit("wrong")).otherwise(F.col("field_value"))
    )
    return evaluate.field_scores(guess, truth)


@query
def match_accuracy(spark, d):
    papers = (fx.charges(spark, d), fx.quantities(spark, d), fx.shipments(spark, d))
    # both results come from one reading of the papers
    amounts = materialized(match.line_amounts(*papers), "line-amounts", compression="zstd")
    strict = match.match_shipments(*papers, duplicates="sum", amounts=amounts)
    results = match.match_shipments(*papers, amounts=amounts)
    return evaluate.match_accuracy(results, strict, list(vocab.FLAG_LABELS))


def _labelled(spark, d):
    guess = ((F.col("n_chars") % 1001) / 1000.0).cast("decimal(4,3)")
    return (
        fx.table(spark, d, "documents")
        .select("doc_id", guess.alias("confidence"))
        .join(fx.table(spark, d, "labels"), "doc_id")
        .select("confidence", (F.col("quality") == 1).alias("correct"))
    )


@query
def calibration(spark, d):
    return plain(evaluate.calibration(_labelled(spark, d)))


@query
def calibration_error(spark, d):
    return evaluate.calibration_error(evaluate.calibration(_labelled(spark, d)))


# --- limits, state machine and streams ----------------------------------------------


@query
def rate_limit_raw(spark, d):
    return plain(limiter.raw_report(fx.submissions(spark, d), limit=2))


@query
def rate_limit_accepted(spark, d):
    return limiter.rate_limited(fx.submissions(spark, d), limit=1)


@query
def rate_limit_accepted_two(spark, d):
    """Two accepted submissions per account and six hours."""
    return limiter.rate_limited(fx.submissions(spark, d), limit=2, window_seconds=21600)


@query
def transition_check(spark, d):
    e = F.col("event_id")
    now = fx.pick(e % 4, *vocab.REVIEW_STATES)
    then = fx.pick(F.floor(e / 4) % 4, *vocab.REVIEW_STATES)
    return (
        fx.table(spark, d, "events")
        .groupBy(now.alias("current_state"), then.alias("target_state"))
        .agg(F.count("*").alias("n"))
        .withColumn(
            "allowed", review.can_transition(F.col("current_state"), F.col("target_state"))
        )
    )


@query
def review_state_fold(spark, d):
    judged = review.judge_actions(fx.actions(spark, d))
    return judged.select("action_id", "item_id", "action", "state_before", "accepted", "error")


@query
def review_item_states(spark, d):
    return plain(review.item_states(review.judge_actions(fx.actions(spark, d))))


def _stream(spark, d, name):
    # a glob, so that the table may be a single file as well as a folder of files
    schema = fx.table(spark, d, name).schema
    return streams.file_stream(spark, f"{d}/{{{name}.parquet}}", schema)


def _event_stream(spark, d):
    return _stream(spark, d, "events")


@query
def stream_usage(spark, d):
    counters = streams.daily_usage(fx.calls_of(_event_stream(spark, d)))
    return plain(streams.latest_counters(streams.run_to_end(counters, "usage", mode="update")))


@query
def stream_dedup(spark, d):
    kept = streams.run_to_end(
        streams.distinct_submissions(fx.jobs_of(_event_stream(spark, d))), "dedup"
    )
    return (
        kept.groupBy("account_id", "idempotency_key")
        .agg(F.count("*").alias("n"))
        .select(
            "account_id",
            "idempotency_key",
            F.when(F.col("idempotency_key").isNull(), F.col("n")).alias("free_rows"),
        )
    )


@query
def stream_answers(spark, d):
    """Every submission with the job that answers it, over a stream."""
    answers = streams.answered_submissions(fx.jobs_of(_event_stream(spark, d)))
    return streams.run_to_end(answers, "answers").drop("batch_id")


@query
def stream_rate_limit(spark, d):
    limited = streams.limited_submissions(fx.submissions_of(_event_stream(spark, d)), limit=1)
    return streams.run_to_end(limited, "limit").drop("batch_id")


@query
def stream_review(spark, d):
    judged = streams.judged_stream(fx.actions_of(_event_stream(spark, d)))
    return streams.run_to_end(judged, "review").drop("batch_id", "action")


@query
def stream_arrivals(spark, d):
    """Arriving documents classified and read by rules as they come."""
    arriving = _stream(spark, d, "documents").select(
        F.col("doc_id").alias("document_id"), "text"
    )
    found = streams.run_to_end(
        arriving,
        "arrivals",
        transform=lambda b: classify.classify(b).select(
            "document_id", "doc_type", "top_score", "needs_model"
        ),
    )
    return found.drop("batch_id")


def paper_pages(spark: SparkSession, d: str) -> DataFrame:
    """All order texts and general documents as pages with layout numbers, up to eight to a job."""
    key, length = F.col("document_id"), F.length("text")
    return fx.texts(spark, d).select(
        F.floor(key / 8).alias("job_id"),
        (key % 8 + 1).alias("page_no"),
        "text",
        text.header_text(F.col("text"), 1).alias("header_text"),
        (F.lit(10) + length % 4).cast("double").alias("avg_font_size"),
        (length % 80).cast("double").alias("top_margin"),
        (F.lit(2000) + length % 900).cast("double").alias("text_density"),
    )


def paper_jobs(pages: DataFrame) -> DataFrame:
    return (
        pages.groupBy("job_id").agg(F.count("*").alias("pages")).withColumn("account_id", F.col("job_id") % 10)
    )


@query
def reconcile(spark, d):
    """All stages from pages to review decisions."""
    pages = paper_pages(spark, d)
    return endtoend.reconcile(pages, paper_jobs(pages))["review_routing"]


@query
def reconcile_replies(spark, d):
    """Documents and their types with stored replies to the questions about unclear ones.

    A first run writes its requests; the replies are made from them, and a second run over the
    same folder takes them up.
    """
    pages = paper_pages(spark, d)
    jobs = paper_jobs(pages)
    root = durable_dir(spark, "reconcile")
    none = spark.createDataFrame([], "cache_key string, response_json string, ttl_expires_at timestamp")
    asked = endtoend.reconcile(pages, jobs, responses=none, as_of=as_of(), root=root)["open_requests"]
    kind = fx.pick(F.ascii("cache_key") % 5, *vocab.DOC_TYPES, vocab.UNKNOWN)
    replies = asked.filter(F.col("round") == "classification").select(
        "cache_key",
        F.concat(F.lit('{"doc_type": "'), kind, F.lit('"}')).alias("response_json"),
        (as_of() + F.expr("interval 1 day")).alias("ttl_expires_at"),
    )
    out = endtoend.reconcile(pages, jobs, responses=replies, as_of=as_of(), root=root)
    return plain(out["documents"].drop("document_id"))


@query
def stream_reconcile(spark, d):
    """Pages of a stream through all stages; jobs are done when all of their pages have come."""
    pages = paper_pages(spark, d)
    jobs = paper_jobs(pages)
    source = durable_dir(spark, "page-files")
    pages.write.parquet(source)
    stream = streams.file_stream(spark, source, spark.read.parquet(source).schema)
    return batches.reconciled_arrivals(stream, jobs)["review_routing"]
