"""Freight tables derived by Spark from the general-purpose input tables.

Everything is a projection, filter or explode of the inputs, and all rows of an input table
are used.  The large inputs are dealt out by their keys first, for one of their files may be a
single row group, which no reader can split; only the columns a query uses travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybridge import vocab
from waybridge.sources.store import read_table


#: keys by which a table is dealt out; lines of an order stay together, by 64 of them, so that
#: what is added up per order is short before it travels
DEALT = {
    "lineitem": ["l_orderkey", "floor(l_linenumber / 64)"],
    "orders": ["o_orderkey"],
    "documents": ["doc_id"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table; large ones in as many partitions as the session shuffles into."""
    rows = read_table(spark, f"{sf_dir}/{name}.parquet")
    if name not in DEALT:
        return rows
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *map(F.expr, DEALT[name]))


def pick(index: Column, *options: str | None) -> Column:
    """The option at ``index``, counted from zero."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index + 1).cast("int"))


def money(c: Column) -> Column:
    return c.cast("decimal(12,2)")


# --- shipments ----------------------------------------------------------------------

RATE_CON_LABELS = [
    "Linehaul", "Fuel Surcharge", "Detention Charge", "layover", "LUMPER FEE", "Stop-Off", "tarping",
]
INVOICE_LABELS = [
    "linehaul", "fuel", "detention", "overnight stay", "lumper", "extra stop", "tarp",
]


def charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreed and billed charges: two per line item, less those one side leaves out."""
    line = (F.col("l_linenumber") - 1) % 7
    price = money(F.col("l_extendedprice"))
    extra = pick(F.col("l_suppkey") % 4, "0.00", "0.02", "0.03", "25.00").cast("decimal(12,2)")
    agreed = F.when(
        F.col("l_partkey") % 7 != 0,
        F.struct(
            F.lit("rate_con").alias("doc_type"),
            pick(line, *RATE_CON_LABELS).alias("category"),
            price.alias("amount"),
        ),
    )
    billed = F.when(
        F.col("l_partkey") % 5 != 0,
        F.struct(
            F.lit("invoice").alias("doc_type"),
            F.when((line > 1) & (F.col("l_suppkey") % 9 == 0), "chassis fee")
            .when((line > 1) & (F.col("l_suppkey") % 9 == 1), "Bridge Toll")
            .when((line == 3) & (F.col("l_suppkey") % 9 < 5), "layover")
            .otherwise(pick(line, *INVOICE_LABELS))
            .alias("category"),
            money(price + extra).alias("amount"),
        ),
    )
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_orderkey").alias("shipment_id"),
            F.col("l_partkey").alias("pos"),
            F.explode(F.array_compact(F.array(agreed, billed))).alias("_c"),
        )
        .select("shipment_id", "pos", "_c.*")
    )


def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loaded and delivered weight and pieces of every order; every eleventh has no proof."""
    pieces = F.col("o_custkey") % 40
    grown = F.when(F.col("o_orderkey") % 3 == 0, 100).when(F.col("o_orderkey") % 3 == 1, 101)
    number = "decimal(18,4)"
    bol = F.struct(
        F.lit("bol").alias("doc_type"),
        (pieces * 100).cast(number).alias("weight"),
        pieces.cast(number).alias("pieces"),
    )
    pod = F.when(
        F.col("o_orderkey") % 11 != 0,
        F.struct(
            F.lit("pod").alias("doc_type"),
            (pieces * F.coalesce(grown, F.lit(105))).cast(number).alias("weight"),
            (pieces - F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(0))
            .cast(number)
            .alias("pieces"),
        ),
    )
    return (
        table(spark, sf_dir, "orders")
        .select(
            F.col("o_orderkey").alias("shipment_id"),
            F.explode(F.array_compact(F.array(bol, pod))).alias("_q"),
        )
        .select("shipment_id", "_q.*")
    )


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("shipment_id"))


# --- documents and fields -----------------------------------------------------------


def _days() -> dict[str, Column]:
    """Days that the papers of an order carry."""
    order, start = F.col("o_orderkey"), F.to_date("o_orderdate")
    late = (order % 5 + 1 - F.when(order % 7 == 0, 4).otherwise(0)).cast("int")
    return {
        "pickup": F.date_add(start, 1),
        "delivery": F.date_add(start, late),
        "due": F.date_add(start, (order % 4 + 3).cast("int")),
    }


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four documents per order, less one in thirteen; an order is a job."""
    return _documents_of(table(spark, sf_dir, "orders"))


def _documents_of(orders: DataFrame, *more: str) -> DataFrame:
    """The documents of orders, with columns ``more`` of their order."""
    order, i = F.col("o_orderkey"), F.col("_i")
    load = F.concat(
        F.lit("RC-"), (order + F.when((i == 3) & (order % 9 == 0), 1).otherwise(0)).cast("string")
    )
    return (
        orders.select(
            "o_orderkey",
            "o_custkey",
            "o_orderdate",
            *more,
            F.explode(F.sequence(F.lit(0), F.lit(3))).alias("_i"),
        )
        .filter((order + i) % 13 != 0)
        .select(
            order.alias("job_id"),
            (order * 4 + i).alias("document_id"),
            F.col("o_custkey").alias("account_id"),
            order.alias("shipment_id"),
            pick(i, *vocab.DOC_TYPES).alias("doc_type"),
            (i * 3 + 1).alias("page_start"),
            (i * 3 + 3).alias("page_end"),
            ((order * 53 + i * 17) % 301 / 1000 + 0.7).cast("decimal(4,3)").alias("class_confidence"),
            F.when((order + i) % 10 == 0, F.lit("  ")).otherwise(load).alias("load_number"),
            ((order * 3 + i) % 17 == 0).alias("extraction_failed"),
            F.col("o_orderdate").alias("created_at"),
            *[day.alias(f"{name}_day") for name, day in _days().items()],
            *more,
        )
    )


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the typed dates their type carries."""
    kind = F.col("doc_type")
    return documents(spark, sf_dir).select(
        "job_id",
        "document_id",
        "account_id",
        "shipment_id",
        "doc_type",
        "load_number",
        F.when(kind.isin("rate_con", "bol"), F.col("pickup_day")).alias("pickup_date"),
        F.col("delivery_day").alias("delivery_date"),
        F.when(kind == "invoice", F.col("due_day")).alias("due_date"),
    )


FIELD_SLOTS = [
    (t, n, i) for t in vocab.DOC_TYPES for i, n in enumerate(vocab.CANONICAL_FIELDS[t])
]

#: where a field finds its text among those of its order (see ``_order_texts``)
PLACES = {
    **{n: 0 for n in vocab.MONEY_FIELDS},
    **{n: 3 for n in vocab.DATE_FIELDS},
    "pickup_date": 1, "delivery_date": 2, "pickup": 4, "delivery": 5, "weight": 6, "pieces": 7,
    "signature_present": 8, "damage_flag": 8, "accessorials": 9, "line_items": 10, "load_number": 11,
    "shipper": 12, "consignee": 12, "remit_to": 12,
}


def _order_texts() -> Column:
    """What the papers of an order say, each value spelled once and used by all of its documents."""
    job = F.col("o_orderkey")
    cents = (job * 7919 % 900000 + 100).cast("decimal(12,2)") / 100
    amount = cents.cast("decimal(12,2)").cast("string")
    as_money = (
        F.when(job % 4 == 0, F.concat(F.lit("$"), F.format_number(cents.cast("decimal(12,2)"), 2)))
        .when(job % 4 == 1, F.concat(amount, F.lit(" USD")))
        .when(job % 4 == 2, F.concat(F.lit("("), amount, F.lit(")")))
        .otherwise(F.concat(F.lit('{"amount": '), amount, F.lit(', "currency": "CAD"}')))
    )
    days = F.transform(F.array(*_days().values()), lambda day: spelled_date(day, job % 6))
    docks = F.transform(
        F.slice(days, 1, 2),
        lambda day: F.concat(F.lit('{"location":"Dock 5","date":"'), day, F.lit('"}')),
    )
    texts = F.array(
        F.concat((job % 5000 + 1).cast("string"), pick(job % 4, " lbs", " kg", " tons", "")),
        (job % 40).cast("string"),
        F.when(job % 2 == 0, "true").otherwise("false"),
        F.concat(
            F.lit('[{"type":"Detention Charge","amount":"$'), amount,
            F.lit('","description":"two hours"}]'),
        ),
        F.concat(
            F.lit('[{"category":"linehaul","description":"trip","amount":"'), amount,
            F.lit(' USD"}]'),
        ),
        F.concat(F.lit("RC-"), job.cast("string")),
        F.lit('{"name":"Acme","address":null}'),
    )
    return F.concat(F.array(as_money), days, docks, texts)


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical fields of every document in raw spelling, some missing, blank or hollow.

    The texts are made per order, before documents and fields multiply it, and picked by place.
    """
    slots = None
    for t in vocab.DOC_TYPES:
        listed = F.array(
            *[
                F.struct(
                    F.lit(n).alias("field_name"),
                    F.lit(i).alias("ord"),
                    F.lit(PLACES.get(n, -1)).alias("_place"),
                    F.lit(n in ("shipper", "consignee")).alias("_party"),
                )
                for i, n in enumerate(vocab.CANONICAL_FIELDS[t])
            ]
        )
        hit = F.col("doc_type") == t
        slots = F.when(hit, listed) if slots is None else slots.when(hit, listed)
    job, ord_ = F.col("job_id"), F.col("ord")
    turn = (job * 7 + ord_ * 3) % 10
    name = F.col("field_name")
    text = (
        F.when(F.col("_party") & (turn == 2), '{"name":null,"address":null}')
        .when(turn == 1, F.lit("  "))
        .when(F.col("_place") >= 0, F.get("_texts", F.col("_place")))
        .otherwise(F.concat(name, F.lit(" "), (job % 100).cast("string")))
    )
    orders = table(spark, sf_dir, "orders").withColumn("_texts", _order_texts())
    return (
        _documents_of(orders, "_texts")
        .select("job_id", "document_id", "doc_type", "_texts", F.inline(slots))
        .filter(turn != 0)
        .select(
            "job_id",
            "document_id",
            "doc_type",
            "field_name",
            text.alias("field_value"),
            ((500 + (job * 37 + ord_ * 101) % 500) / 1000.0).cast("decimal(4,3)").alias("confidence"),
            pick((job + ord_) % 4, *vocab.EXTRACTION_METHODS).alias("extraction_method"),
            ((job + ord_) % 3 + 1).cast("int").alias("source_page"),
            F.when((job + ord_) % 2 == 0, "[1.5,2,30,4]").alias("source_bbox"),
        )
    )


def spelled_date(day: Column, turn: Column) -> Column:
    return (
        F.when(turn == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(turn == 1, F.date_format(day, "MM/dd/yyyy"))
        .when(turn == 2, F.date_format(day, "MM-dd-yyyy"))
        .when(turn == 3, F.date_format(day, "MMMM d, yyyy"))
        .when(turn == 4, F.date_format(day, "MMM dd yyyy"))
        .otherwise(F.date_format(day, "yyyy/MM/dd"))
    )


def charges_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charges with the document they stand on, as the money check reads them."""
    place = F.when(F.col("doc_type") == "rate_con", 0).otherwise(3)
    line = F.when(
        F.lower("category") == "linehaul", "linehaul"
    ).when(F.lower("category").isin("fuel", "fuel surcharge"), "fuel_surcharge").otherwise(
        F.col("category")
    )
    return charges(spark, sf_dir).select(
        F.col("shipment_id").alias("job_id"),
        (F.col("shipment_id") * 4 + place).alias("document_id"),
        "doc_type",
        line.alias("category"),
        "amount",
    )


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated totals: exact order totals, so most differ from the sum of the charges."""
    stated = documents(spark, sf_dir).filter(F.col("doc_type").isin("rate_con", "invoice"))
    amount = money((F.col("job_id") * 7919 % 900000 + 100) / 100)
    return stated.select(
        "job_id", "document_id", "doc_type",
        F.when(F.col("job_id") % 6 != 0, amount).alias("total"),
    )


# --- texts and pages ----------------------------------------------------------------

ORDER_HEADS = [
    "RATE CONFIRMATION\nLOAD #: RC-", "Bill of  Lading\nBOL #: ", "PROOF OF DELIVERY\nPOD # ",
    "CARRIER INVOICE\nINVOICE # ", "shipping note ", "Invoice\nLoad # ", "BOL RATE CON\nLOAD ",
]


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short freight texts rendered from orders, and all general documents as they are."""
    key = F.col("o_orderkey")
    cents = (key * 7919 % 900000 + 100).cast("decimal(12,2)") / 100
    amount = cents.cast("decimal(12,2)").cast("string")
    tail = pick(
        key % 4,
        "\nSIGNATURE OF RECEIVER ____",
        "\nREMIT TO: Acme, PAYMENT TERMS NET 30",
        "\nDUE DATE: 2026-09-30",
        "\nSHIPPER Acme CONSIGNEE Bolt, WEIGHT 900 LBS",
    )
    order_text = F.concat(
        pick(key % 7, *ORDER_HEADS),
        key.cast("string"),
        F.lit("\nLinehaul Rate: $"),
        amount,
        F.lit("\nTOTAL AMOUNT DUE: $1,"),
        (key % 900 + 100).cast("string"),
        F.lit(".50\nPickup Date: "),
        F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit("\nDelivery: "),
        F.date_format("o_orderdate", "M/d/yyyy"),
        tail,
    )
    orders = table(spark, sf_dir, "orders").select(
        (key * 2).alias("document_id"), order_text.alias("text")
    )
    general = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") * 2 + 1).alias("document_id"), "text"
    )
    return orders.unionByName(general)


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every general document as a page."""
    return (
        table(spark, sf_dir, "documents")
        .select(F.col("doc_id").alias("job_id"), F.posexplode(F.split("text", "\n")).alias("_p", "text"))
        .select("job_id", (F.col("_p") + 1).alias("page_no"), "text")
    )


PAGE_HEADS = [
    "RATE CONFIRMATION", "RATE  CONFIRMATION PAGE 2", "BILL OF LADING", "", "CARRIER INVOICE",
    "NOTES", "P.O.D. # 7",
]


def header_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as pages with a header and layout numbers; one job in ten has no header."""
    length = F.length("text")
    head = pick((F.col("conv_id") * 3 + F.floor(F.col("turn") / 2)) % 7, *PAGE_HEADS)
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("job_id"),
        (F.col("turn") + 1).alias("page_no"),
        F.when(F.col("conv_id") % 10 == 0, "").otherwise(head).alias("header_text"),
        (10 + length % 4).cast("double").alias("avg_font_size"),
        (length % 80).cast("double").alias("top_margin"),
        (F.lit(2000) + length % 900).cast("double").alias("text_density"),
        "text",
    )


# --- events -------------------------------------------------------------------------


def _k() -> Column:
    return F.regexp_extract("props", "[0-9]+", 0).cast("bigint")


def jobs_of(events: DataFrame) -> DataFrame:
    k, e = _k(), F.col("event_id")
    status = pick(e % 12, *vocab.JOB_STATUSES)
    spent = F.round(F.col("value") * 100).cast("bigint") * 10000
    done = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + spent)
    return events.select(
        e.alias("job_id"),
        F.col("user_id").alias("account_id"),
        F.when(k % 4 != 0, F.concat(F.lit("k"), (k % 10).cast("string"))).alias("idempotency_key"),
        status.alias("status"),
        F.when(e % 5 != 0, e % 1000).alias("shipment_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.when(status.isin(vocab.TERMINAL_STATUSES), done).alias("completed_at"),
        F.lit(None).cast("string").alias("error"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs_of(table(spark, sf_dir, "events"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, e = _k(), F.col("event_id")
    return (
        table(spark, sf_dir, "events")
        .filter(k % 3 == 0)
        .select(
            e.alias("item_id"),
            (e - e % 4).alias("job_id"),
            pick(k % 5, *vocab.REVIEW_REASONS).alias("reason"),
            pick(e % 4, *vocab.REVIEW_STATES).alias("state"),
            pick(k % 4, "approved", "corrected", "escalated", None).alias("resolution"),
            F.col("ts").cast("timestamp").alias("created_at"),
        )
    )


def calls_of(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    provider = pick(e % 3, "openrouter", "gemini", "groq")
    return events.select(
        provider.alias("provider"),
        F.concat(provider, F.lit("-m"), (e % 2).cast("string")).alias("model"),
        F.col("ts").cast("timestamp").alias("ts"),
        (_k() < 40).alias("is_cache_hit"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls_of(table(spark, sf_dir, "events"))


def submissions_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("account_id"),
        F.col("event_id").alias("submission_id"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return submissions_of(table(spark, sf_dir, "events"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored replies keyed by the hash of a short text, several per key."""
    k, e = _k(), F.col("event_id")
    kind = pick(k % 6, *vocab.DOC_TYPES, "unknown", "parcel")
    body = F.concat(
        F.lit('{"doc_type": "'), kind, F.lit('", "n": '), e.cast("string"), F.lit("}")
    )
    reply = (
        F.when(e % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(e % 5 == 1, F.concat(F.lit("Sure: "), body, F.lit(" done")))
        .when(e % 5 == 2, F.concat(F.lit("looks like "), kind))
        .otherwise(body)
    )
    made = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        F.sha2(F.concat(F.lit("classification_v1:"), F.sha2(k.cast("string"), 256), F.lit(":1")), 256)
        .alias("cache_key"),
        e.alias("response_id"),
        pick(e % 3, "openrouter", "gemini", "groq").alias("provider"),
        reply.alias("response_json"),
        made.alias("created_at"),
        (made + F.expr("interval 10 days")).alias("ttl_expires_at"),
    )


def actions_of(events: DataFrame) -> DataFrame:
    e, k = F.col("event_id"), _k()
    name = F.concat(F.lit("field_"), (k % 7).cast("string"))
    return events.select(
        F.floor(e / 6).alias("item_id"),
        e.alias("action_id"),
        pick(e * 7 % 5, "claim", "approve", "correct", "escalate", "claim").alias("action"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("actor"),
        F.when(k % 3 == 0, F.concat(F.lit("note "), k.cast("string"))).alias("notes"),
        F.when(k % 4 != 0, F.create_map(name, k.cast("string"))).alias("corrections"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions_of(table(spark, sf_dir, "events"))
