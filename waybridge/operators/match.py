"""Three-way match: agreed against delivered against billed, per shipment and line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybridge import vocab
from waybridge.functions.values import (
    MONEY, charge_of, charge_type, joined_words, money_text, quantity_text, quick_trimmed,
)
from waybridge.sources.store import row_id

_VALUE = "decimal(18,4)"


def shipment_key(account: str = "account_id", load_number: str = "load_number") -> Column:
    """Identifier of the shipment a load number stands for inside an account."""
    return F.when(F.col(load_number).isNotNull(), row_id(account, load_number))


def line_name(category: Column, side: Column, map_invoice: bool = True) -> Column:
    """Match line a charge belongs to; a label outside the vocabulary is a line of its own."""
    return _line(category, side, map_invoice, F.lower(category), charge_type(category))


def _line(category: Column, side: Column, map_invoice: bool, low: Column, kind: Column) -> Column:
    """``line_name`` for a label whose lower case and charge type are known."""
    plain, own = joined_words(low), joined_words(F.trim(low))
    free = F.when((kind == "other") & (own != ""), own).otherwise(kind)
    if not map_invoice:
        free = F.when(side == "invoice", plain).otherwise(F.coalesce(category, F.lit("other")))
    return (
        F.when(plain == "linehaul", "linehaul")
        .when(plain.isin("fuel", "fuel_surcharge"), "fuel_surcharge")
        .otherwise(free)
    )


def _charge_entries(charges: DataFrame, map_invoice: bool) -> DataFrame:
    """Charges with the order in which they compete for a line.

    The first linehaul and fuel charge counts; an explicit fuel surcharge goes before plain
    fuel.  Of other charges the last one of each written category counts, and differently
    written charges of one line add up.
    """
    low = F.col("_low")
    line = _line(F.col("category"), F.col("doc_type"), map_invoice, low, F.col("_kind"))
    fixed = F.col("line_item").isin(vocab.SPINE_LINES)
    return (
        charges.filter(F.col("amount").isNotNull())
        # step by step, so that a label is lowered and looked up once
        .withColumn("_low", F.lower("category"))
        .withColumn("_key", quick_trimmed(low))
        .withColumn("_kind", charge_of(F.col("_key")))
        .withColumn("line_item", line)
        .select(
            "shipment_id",
            "line_item",
            F.when(~fixed, joined_words(F.trim(low))).alias("written"),
            F.col("doc_type").alias("side"),
            F.col("amount").cast(_VALUE).alias("value"),
            F.when(joined_words(low) == "fuel", 1).otherwise(0).alias("rank"),
            F.when(fixed, F.col("pos")).otherwise(-F.col("pos")).alias("turn"),
        )
    )


def _quantity_entries(quantities: DataFrame) -> DataFrame:
    pair = F.array(
        F.struct(F.lit("weight").alias("line_item"), F.col("weight").cast(_VALUE).alias("value")),
        F.struct(F.lit("pieces").alias("line_item"), F.col("pieces").cast(_VALUE).alias("value")),
    )
    return quantities.select(
        "shipment_id", F.col("doc_type").alias("side"), F.explode(pair).alias("_q")
    ).select(
        "shipment_id",
        "_q.line_item",
        F.lit(None).cast("string").alias("written"),
        "side",
        "_q.value",
        F.lit(0).alias("rank"),
        F.lit(0).cast("bigint").alias("turn"),
    )


def _spine(shipments: DataFrame, names: list[str]) -> DataFrame:
    """The lines that every shipment has, with no paper."""
    lines = F.array(*[F.lit(n) for n in names])
    return shipments.select("shipment_id", F.explode(lines).alias("line_item"))


def shipments_of(charges: DataFrame, quantities: DataFrame) -> DataFrame:
    return (
        charges.select("shipment_id").unionByName(quantities.select("shipment_id")).distinct()
    )


def sided_lines(
    charges: DataFrame,
    quantities: DataFrame,
    shipments: DataFrame | None = None,
    map_invoice: bool = True,
    duplicates: str = "last",
) -> DataFrame:
    """One row per shipment and line with the value of each paper that has it.

    All papers meet in a single grouping on (shipment, line): partial results
    are formed before the shuffle, so neither a shipment nor a line with very
    many rows ends up whole in one task.
    """
    return _by_line(line_amounts(charges, quantities, shipments, map_invoice), duplicates)


def line_amounts(
    charges: DataFrame,
    quantities: DataFrame,
    shipments: DataFrame | None = None,
    map_invoice: bool = True,
) -> DataFrame:
    """One row per shipment and line, for each side the value that counts and, as ``<side>_sum``,
    the one with all duplicates.
    """
    if shipments is None:
        shipments = shipments_of(charges, quantities)
    return _amounts(
        _charge_entries(charges, map_invoice).unionByName(_quantity_entries(quantities)),
        _spine(shipments, vocab.SPINE_LINES),
    )


def quantity_lines(quantities: DataFrame, shipments: DataFrame | None = None) -> DataFrame:
    """Weight and pieces lines only, for checks that need no charges."""
    if shipments is None:
        shipments = quantities.select("shipment_id").distinct()
    return _by_line(_amounts(_quantity_entries(quantities), _spine(shipments, ["weight", "pieces"])), "last")


#: ten thousandths of a value, 18 digits at most, stand behind their place in one number; they lie between
#: minus and plus HALF, a power of two, so that the bytes of small values stay zero
HALF = 2**60


def _amounts(rows: DataFrame, spine: DataFrame) -> DataFrame:
    # rank, turn and value in one number: fixed-size buffers let the aggregate hash
    # its groups, while a struct would make it sort all rows; the value that counts is read
    # from the least of these numbers, so it does not travel beside it
    whole = "decimal(19,0)"
    place = F.col("turn") + F.col("rank") * (1 << 61)
    value = (F.col("value") * 10000).cast("decimal(18,0)") + F.lit(HALF).cast(whole)
    turn = place.cast(whole) * F.lit(2 * HALF).cast(whole) + value.cast(whole)
    found = F.pmod(F.col("_turn"), F.lit(2 * HALF).cast(whole)) - F.lit(HALF).cast(whole)
    found = (found.cast("decimal(18,0)") * F.lit("0.0001").cast("decimal(4,4)")).cast(_VALUE)
    # sides travel as numbers, and a total only where it is not the value that counts
    side = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in vocab.DOC_TYPES]), F.col("side")), F.lit(0)).cast("int")
    free = F.when(~F.col("line_item").isin(vocab.SPINE_LINES), F.col("value"))
    one, total = F.col("one"), F.coalesce("total", "one")

    def of(name: str, value: Column, kind: str) -> Column:
        return F.sum(F.when(F.col("side") == vocab.DOC_TYPES.index(name) + 1, value)).cast(kind)

    keys = ["shipment_id", "line_item"]
    # sides are rows at first, not columns: every row touches one buffer instead of one of each side;
    # then the amounts of the written categories are added, of which fixed lines have one
    counted = (
        rows.withColumn("_turn", F.when(F.col("value").isNotNull(), turn))
        .withColumn("side", side)
        .groupBy(*keys, "written", "side")
        .agg(F.min("_turn").alias("_turn"), F.sum(free).alias("total"))
        .select(*keys, "side", found.alias("one"), "total")
        .withColumn("total", F.nullif("total", "one"))
    )
    return (
        # what is left of a line are its written categories; they are dealt out as they are, for a
        # partial result would be wider than they and hardly ever hold two of them
        counted.unionByName(spine, allowMissingColumns=True)
        .repartition(*keys)
        .groupBy(*keys)
        .agg(
            *[of(s, one, _VALUE).alias(s) for s in vocab.DOC_TYPES],
            *[of(s, total, "decimal(28,4)").alias(f"{s}_sum") for s in vocab.DOC_TYPES],
        )
    )


def _by_line(amounts: DataFrame, duplicates: str) -> DataFrame:
    end = "_sum" if duplicates == "sum" else ""
    return amounts.select("shipment_id", "line_item", *[F.col(s + end).alias(s) for s in vocab.DOC_TYPES])


def flagged_lines(lines: DataFrame) -> DataFrame:
    """Compare the sides of every line and name the discrepancy."""
    rc, bol, pod, inv = (F.col(s) for s in vocab.DOC_TYPES)
    quantity = F.col("line_item").isin("weight", "pieces")
    fixed = F.col("line_item").isin("linehaul", "fuel_surcharge")
    money_off = F.abs(inv - rc) > F.lit(vocab.MONEY_TOLERANCE).cast(MONEY)
    tolerance = F.when(
        F.col("line_item") == "weight", F.lit(vocab.WEIGHT_TOLERANCE).cast("decimal(3,2)")
    ).otherwise(F.lit(vocab.PIECES_TOLERANCE).cast("decimal(3,2)"))
    varies = F.when(bol != 0, F.abs(pod - bol) > tolerance * F.abs(bol)).otherwise(pod != 0)
    flag = (
        F.when(
            quantity,
            F.when(
                varies,
                F.when(F.col("line_item") == "weight", "weight_variance").otherwise(
                    "pieces_variance"
                ),
            ),
        )
        .when(money_off, "rate_delta")
        .when(~fixed & inv.isNull(), "missing_accessorial")
        .when(~fixed & rc.isNull(), "extra_accessorial")
    )
    amount = (
        F.when(F.col("discrepancy_flag") == "rate_delta", inv - rc)
        .when(F.col("discrepancy_flag") == "extra_accessorial", inv)
        .when(F.col("discrepancy_flag").isin("weight_variance", "pieces_variance"), pod - bol)
    )
    order = (
        F.when(F.col("line_item") == "linehaul", 1)
        .when(F.col("line_item") == "fuel_surcharge", 2)
        .when(F.col("line_item") == "weight", 4)
        .when(F.col("line_item") == "pieces", 5)
        .otherwise(3)
    )
    return (
        lines.withColumn("discrepancy_flag", F.coalesce(flag, F.lit("none")))
        .withColumn("discrepancy_amount", F.round(amount, 2).cast(MONEY))
        .select(
            "shipment_id",
            "line_item",
            order.alias("line_ord"),
            F.when(~quantity, money_text(rc)).alias("rate_con_value"),
            F.when(quantity, quantity_text(bol)).alias("bol_pod_value"),
            F.when(quantity, quantity_text(pod)).otherwise(money_text(inv)).alias("invoice_value"),
            F.when(quantity, quantity_text(pod)).alias("pod_value"),
            "discrepancy_flag",
            "discrepancy_amount",
        )
    )


def match_shipments(
    charges: DataFrame,
    quantities: DataFrame,
    shipments: DataFrame | None = None,
    map_invoice: bool = True,
    duplicates: str = "last",
    amounts: DataFrame | None = None,
) -> DataFrame:
    """Match results of all shipments.

    ``charges``: (shipment_id, doc_type, category, pos, amount) of rate
    confirmations and invoices.  ``quantities``: (shipment_id, doc_type,
    weight, pieces) of bills of lading and proofs of delivery.  ``amounts``: their
    :func:`line_amounts`, where these are at hand because several results are made of them.
    """
    if amounts is None:
        return flagged_lines(sided_lines(charges, quantities, shipments, map_invoice, duplicates))
    return flagged_lines(_by_line(amounts, duplicates))


def discrepancy_reasons(match_results: DataFrame) -> DataFrame:
    """One reason row per line that does not match."""
    return match_results.filter(F.col("discrepancy_flag") != "none").select(
        "shipment_id",
        "line_ord",
        "line_item",
        F.concat(
            F.lit("discrepancy: "), F.col("discrepancy_flag"), F.lit(" on "), F.col("line_item")
        ).alias("reason"),
    )


def shipment_reasons(match_results: DataFrame) -> DataFrame:
    """Number of discrepancies and their reasons in line order, per shipment.

    Meant for results with mapped charge names, where a shipment has ten lines
    at most; use :func:`discrepancy_reasons` for free charge names.
    """
    ordered = F.array_sort(F.collect_list(F.struct("line_ord", "line_item", "reason")))
    return (
        discrepancy_reasons(match_results)
        .groupBy("shipment_id")
        .agg(
            F.count("*").alias("discrepancies"),
            F.transform(ordered, lambda r: r["reason"]).alias("reasons"),
        )
    )


def assemble_shipments(documents: DataFrame, columns: list[str]) -> DataFrame:
    """One row per shipment with a struct per paper; the lowest document id wins."""

    def paper(doc_type: str) -> Column:
        return F.min_by(
            F.struct("document_id", *columns),
            F.when(F.col("doc_type") == doc_type, F.col("document_id")),
        ).alias(doc_type)

    return (
        documents.filter(F.col("shipment_id").isNotNull())
        .groupBy("shipment_id")
        .agg(*[paper(t) for t in vocab.DOC_TYPES])
    )
