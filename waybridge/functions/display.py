"""Column functions for labels, ages and stages shown to users."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waybridge import vocab
from waybridge.functions.replies import strict_json


def _label(value: Column, labels: dict[str, str]) -> Column:
    chain = None
    for key, text in labels.items():
        chain = F.when(value == key, text) if chain is None else chain.when(value == key, text)
    return chain


def flag_label(flag: Column) -> Column:
    return _label(flag, vocab.FLAG_LABELS)


def reason_label(reason: Column) -> Column:
    return _label(reason, vocab.REASON_LABELS)


def method_label(method: Column) -> Column:
    return _label(method, vocab.METHOD_LABELS)


def signed_dollars(amount: Column) -> Column:
    digits = F.abs(amount).cast("decimal(12,2)").cast("string")
    return F.when(amount >= 0, F.concat(F.lit("+$"), digits)).otherwise(
        F.concat(F.lit("-$"), digits)
    )


def money_display(amount: Column, currency: Column) -> Column:
    shown = F.concat(F.lit("$"), F.format_number(amount, 2), F.lit(" "), currency)
    return F.coalesce(shown, F.lit("—"))


def age_text(ts: Column, as_of: Column) -> Column:
    """Age in the largest whole unit, counted from an explicit point in time."""
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    minutes = F.floor(micros / 60000000)
    hours = F.floor(minutes / 60)
    return (
        F.when(minutes < 1, "just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit(" hr")))
        .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit(" d")))
    )


def status_group(status: Column) -> Column:
    return F.when(status.isin(vocab.PROCESSING_STATUSES), "processing").otherwise(status)


def is_terminal(status: Column) -> Column:
    return status.isin(vocab.TERMINAL_STATUSES)


def stage_track(status: Column) -> Column:
    """Array of (ord, stage, state) over the nine shown stages."""
    ordinal = F.array_position(
        F.array(*[F.lit(s) for s in vocab.STAGE_TRACK]), status
    )
    scoring = vocab.STAGE_TRACK.index("scoring") + 1
    stopped = status.isin("failed", "needs_llm_capacity")

    def state(i: int) -> Column:
        if i <= scoring:
            halted = F.lit("completed")
        else:
            halted = F.lit("pending")
        return F.when(stopped, halted).otherwise(
            F.when(F.lit(i) < ordinal, "completed")
            .when(F.lit(i) == ordinal, "current")
            .otherwise("pending")
        )

    return F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.lit(s).alias("stage"), state(i).alias("state"))
            for i, s in enumerate(vocab.STAGE_TRACK, 1)
        ]
    )


def decoded_value(text: Column) -> Column:
    """The JSON value written in a text, or the text itself as a JSON string."""
    return F.coalesce(strict_json(text), text.cast("variant"))
