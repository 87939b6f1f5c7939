"""Column functions for confidence values, kept as decimal(4,3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waybridge import vocab

CONF = "decimal(4,3)"


def conf(value: str) -> Column:
    return F.lit(value).cast(CONF)


def field_confidence(
    method: Column, base: Column, agreed: Column, certainty: Column
) -> Column:
    """Confidence of one field given how it was read and whether a check agreed."""
    by_rule = F.when(
        base.isNotNull(), F.greatest(conf("0.950"), F.least(base, conf("0.990")))
    ).otherwise(conf("0.990"))
    checked = F.when(
        agreed, F.least(F.coalesce(certainty, conf("0.850")), conf("0.990"))
    ).otherwise(conf("0.500"))
    unchecked = F.least(F.coalesce(base, conf("0.850")), conf("0.950"))
    by_model = F.when(agreed.isNotNull(), checked).otherwise(unchecked)
    by_ocr = F.least(F.coalesce(base, conf("0.850")), conf("0.850"))
    otherwise = F.least(F.coalesce(base, conf("0.800")), conf("0.800"))
    return (
        F.when(method == "rule", by_rule)
        .when(method.isin("llm_text", "llm_vision"), by_model)
        .when(method == "ocr", by_ocr)
        .otherwise(otherwise)
        .cast(CONF)
    )


def thousandths(confidence: Column) -> Column:
    return (confidence * 1000).cast("bigint")


def rounded_mean(total_thousandths: Column, weight: Column) -> Column:
    """Mean of whole thousandths, rounded half up, without leaving integers."""
    half_up = F.call_function("div", total_thousandths * 2 + weight, weight * 2)
    return (half_up / 1000).cast(CONF)


def rounded_ratio(part: Column, whole: Column, steps: int) -> Column:
    """``part / whole`` rounded half up to multiples of ``1 / steps``; both are whole numbers."""
    return F.call_function("div", part * (2 * steps) + whole, whole * 2) / float(steps)


def is_required(doc_type: Column, field_name: Column) -> Column:
    """Whether a field is required for its document type."""
    hits = [
        (doc_type == t) & field_name.isin(names) for t, names in vocab.REQUIRED_FIELDS.items()
    ]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return F.coalesce(out, F.lit(False))


def confidence_band(score: Column, scope: str = "field") -> Column:
    limit = conf(vocab.DOCUMENT_THRESHOLD if scope == "document" else vocab.FIELD_THRESHOLD)
    return (
        F.when(score >= limit, "high")
        .when(score >= limit - conf(vocab.BAND_WIDTH), "mid")
        .otherwise("low")
    )
