"""Review items: state machine over recorded actions, and reviewer corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybridge import vocab
from waybridge.functions.values import worded
from waybridge.operators.hotkeys import attach_per_key
from waybridge.session import materialized

# action -> state it leads to
TARGET_STATE = {
    "claim": "in_review",
    "approve": "resolved",
    "correct": "resolved",
    "escalate": "escalated",
}


def can_transition(current: Column, target: Column) -> Column:
    """Whether the state machine has this step."""
    allowed = [
        (current == state) & target.isin(targets)
        for state, targets in vocab.REVIEW_TRANSITIONS.items()
        if targets
    ]
    out = allowed[0]
    for step in allowed[1:]:
        out = out | step
    return F.coalesce(out, F.lit(False))


def target_state(action: Column) -> Column:
    chain = None
    for name, state in TARGET_STATE.items():
        chain = F.when(action == name, state) if chain is None else chain.when(action == name, state)
    return chain


def judge_actions(actions: DataFrame) -> DataFrame:
    """Say for every action in which state it met its item and whether it was legal.

    ``actions``: (item_id, action_id, action, actor, notes, corrections, ts),
    ``corrections`` being a map that must not be empty for ``correct``.

    An item takes three steps at most: the first claim, the first decision
    after it, and the first resolution after an escalation.  Each step is an
    aggregate over the item, so an item with any number of actions can be
    spread over tasks.
    """
    moment = F.struct("ts", "action_id")
    filled = F.coalesce(F.size("corrections") > 0, F.lit(False))
    resolves = (F.col("action") == "approve") | ((F.col("action") == "correct") & filled)
    marked = actions.withColumn("_at", moment).withColumn("_resolves", resolves)

    def step(df: DataFrame, condition: Column, name: str) -> DataFrame:
        first = F.min(F.when(condition, F.struct("_at", "action")))
        out = attach_per_key(df, ["item_id"], ["action_id"], {name: (first, F.min)})
        return out if name == "_closing" else materialized(out, "review-actions")

    one = step(marked, F.col("action") == "claim", "_claim")
    decided = (F.col("_at") > F.col("_claim._at")) & (
        F.col("_resolves") | (F.col("action") == "escalate")
    )
    two = step(one, decided, "_decision")
    late = (
        (F.col("_decision.action") == "escalate")
        & (F.col("_at") > F.col("_decision._at"))
        & F.col("_resolves")
    )
    three = step(two, late, "_closing")
    before = (
        F.when(F.col("_claim").isNull() | (F.col("_at") <= F.col("_claim._at")), "pending")
        .when(
            F.col("_decision").isNull() | (F.col("_at") <= F.col("_decision._at")), "in_review"
        )
        .when(F.col("_decision.action") != "escalate", "resolved")
        .when(F.col("_closing").isNull() | (F.col("_at") <= F.col("_closing._at")), "escalated")
        .otherwise("resolved")
    )
    return (
        three.withColumn("state_before", before)
        .withColumn(
            "accepted",
            can_transition(F.col("state_before"), target_state(F.col("action")))
            & ((F.col("action") != "correct") | filled),
        )
        .withColumn("error", action_error(F.col("action"), F.col("state_before"), filled))
        .drop("_at", "_resolves", "_claim", "_decision", "_closing")
    )


def action_error(action: Column, state: Column, filled: Column) -> Column:
    """Message for a refused action, null for a legal one."""
    legal = can_transition(state, target_state(action))
    return (
        F.when(
            ~legal & (action == "claim"),
            worded(vocab.CLAIM_REFUSED, state=state),
        )
        .when(
            ~legal & (action == "escalate"),
            worded(vocab.ESCALATE_REFUSED, state=state),
        )
        .when(~legal, worded(vocab.RESOLVE_REFUSED, state=state))
        .when(
            (action == "correct") & ~filled,
            vocab.CORRECTIONS_MISSING,
        )
    )


def resolution_note(action: Column, notes: Column, corrections: Column) -> Column:
    """The given note, or the standard one of the action."""
    names = F.array_join(F.array_sort(F.map_keys(corrections)), ", ")
    standard = (
        F.when(action == "approve", vocab.APPROVED_NOTE)
        .when(action == "correct", F.concat(F.lit("Corrected fields: "), names))
        .when(action == "escalate", vocab.ESCALATED_NOTE)
    )
    return F.coalesce(F.nullif(notes, F.lit("")), standard)


def item_states(judged: DataFrame) -> DataFrame:
    """Final row per item: state, assignee, note and resolution time.

    Only accepted actions count, of which an item has three at most.
    """
    at = F.struct("ts", "action_id")
    ok = F.col("accepted")
    closing = ok & (F.col("action") != "claim")
    note = resolution_note(F.col("action"), F.col("notes"), F.col("corrections"))
    actor = F.nullif(F.col("actor"), F.lit(""))
    return judged.groupBy("item_id").agg(
        F.coalesce(
            F.max_by(target_state(F.col("action")), F.when(ok, at)), F.lit("pending")
        ).alias("state"),
        F.max_by(actor, F.when(ok & actor.isNotNull(), at)).alias("assigned_to"),
        F.max_by(note, F.when(closing, at)).alias("resolution_notes"),
        F.max(F.when(closing, F.col("ts"))).alias("resolved_at"),
        F.count_if(ok).alias("accepted_actions"),
        F.count_if(~ok).alias("refused_actions"),
    )


def corrected_fields(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """Fields with reviewer values written in, at full confidence; new names are added.

    ``corrections`` has one row (document_id, field_name, field_value) per
    corrected field; a null value clears the field.  Rows are dealt out by document as they are:
    fields of a document stand together and travel short, and hardly two rows of a task are of one field.
    """
    payload = F.struct("field_value", "confidence", "corrected")
    old = fields.select(
        "document_id",
        "field_name",
        "field_value",
        F.col("confidence").cast("decimal(4,3)").alias("confidence"),
        F.lit(False).alias("corrected"),
    )
    new = corrections.select(
        "document_id",
        "field_name",
        F.col("field_value").cast("string").alias("field_value"),
        F.lit("1.000").cast("decimal(4,3)").alias("confidence"),
        F.lit(True).alias("corrected"),
    )
    return (
        old.unionByName(new)
        .repartition("document_id")
        .groupBy("document_id", "field_name")
        .agg(F.max_by(payload, "corrected").alias("_best"))
        .select("document_id", "field_name", "_best.*")
    )
