import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from waybridge import vocab
from waybridge.operators import review
from waybridge.operators.review import TARGET_STATE
from waybridge.streaming import limiter

START = datetime(2024, 1, 1)


def _submissions(seed, hot):
    """Bursts and gaps; ``hot`` puts most rows on one account."""
    rnd = random.Random(seed)
    rows, clock = [], {a: START for a in range(6)}
    for i in range(1500):
        a = 0 if rnd.random() < hot else rnd.randrange(6)
        clock[a] += timedelta(seconds=rnd.choice([0, 1, 30, 200, 200, 1500, 4000]))
        rows.append((a, i, clock[a]))
    return rows


def _walk(rows, limit, width):
    """The limit applied one submission at a time."""
    out, windows = {}, {}
    for a, i, ts in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        kept = [t for t in windows.get(a, []) if t > ts - timedelta(seconds=width)]
        if len(kept) >= limit:
            left = (kept[0] + timedelta(seconds=width) - ts).total_seconds()
            out[i] = (False, int(left) + 1)
        else:
            kept.append(ts)
            out[i] = (True, 0)
        windows[a] = kept
    return out


def _frame(spark, rows):
    return spark.createDataFrame(rows, "account_id bigint, submission_id bigint, ts timestamp").repartition(3)


def test_accepted_only_limit(spark):
    for seed, hot, limit, width in [(1, 0.2, 3, 3600), (2, 0.8, 2, 600), (3, 0.8, 1, 3600), (4, 0.5, 60, 3600)]:
        rows = _submissions(seed, hot)
        got = limiter.rate_limited(_frame(spark, rows), limit, width).collect()
        assert len(got) == len(rows)
        assert {r["submission_id"]: (r["accepted"], r["retry_after"]) for r in got} == _walk(rows, limit, width)


def test_raw_counts(spark):
    rows = _submissions(5, 0.6)
    got = {r["submission_id"]: r["prior_in_window"] for r in limiter.raw_report(_frame(spark, rows), 3).collect()}
    for a, i, ts in rows:
        before = [1 for b, j, t in rows if b == a and (t, j) < (ts, i) and t > ts - timedelta(hours=1)]
        assert got[i] == len(before)


def _actions(seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(900):
        item = 0 if rnd.random() < 0.4 else rnd.randrange(120)
        action = rnd.choice(["claim", "approve", "correct", "escalate"])
        fixes = rnd.choice([None, {}, {"weight": "5"}])
        rows.append((item, i, action, rnd.choice(["ann", "bo", None]), rnd.choice([None, "ok"]), fixes, START + timedelta(seconds=rnd.randrange(400))))
    return rows


def _fold(rows):
    states, out = {}, {}
    for item, i, action, _, _, fixes, ts in sorted(rows, key=lambda r: (r[0], r[6], r[1])):
        state = states.get(item, "pending")
        target = TARGET_STATE[action]
        ok = target in vocab.REVIEW_TRANSITIONS[state] and (action != "correct" or bool(fixes))
        out[i] = (state, ok)
        states[item] = target if ok else state
    return out, states


SCHEMA = "item_id bigint, action_id bigint, action string, actor string, notes string, corrections map<string,string>, ts timestamp"


def test_review_actions_against_a_fold(spark):
    rows = _actions(1)
    judged = review.judge_actions(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = judged.collect()
    want, states = _fold(rows)
    assert {r["action_id"]: (r["state_before"], r["accepted"]) for r in got} == want
    assert all((r["error"] is None) == r["accepted"] for r in got)
    final = {r["item_id"]: r["state"] for r in review.item_states(judged).collect()}
    assert final == states


def test_resolution_keeps_assignee_and_writes_notes(spark):
    rows = [
        (1, 1, "claim", "ann", None, None, START),
        (1, 2, "correct", None, None, {"weight": "5", "pieces": "2"}, START + timedelta(seconds=1)),
        (2, 3, "approve", "bo", None, None, START),
        (3, 4, "claim", "ann", None, None, START),
        (3, 5, "escalate", "bo", None, None, START + timedelta(seconds=1)),
    ]
    out = {r["item_id"]: r for r in review.item_states(review.judge_actions(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert (out[1]["state"], out[1]["assigned_to"], out[1]["resolution_notes"]) == ("resolved", "ann", "Corrected fields: pieces, weight")
    assert (out[2]["state"], out[2]["refused_actions"]) == ("pending", 1)
    assert (out[3]["state"], out[3]["assigned_to"]) == ("escalated", "bo")
    assert out[3]["resolved_at"] is not None


def test_transitions(spark):
    pairs = [(a, b) for a in vocab.REVIEW_STATES for b in vocab.REVIEW_STATES]
    df = spark.createDataFrame(pairs, "a string, b string")
    legal = {(r["a"], r["b"]) for r in df.filter(review.can_transition(F.col("a"), F.col("b"))).collect()}
    assert legal == {("pending", "in_review"), ("in_review", "resolved"), ("in_review", "escalated"), ("escalated", "resolved")}


def test_corrections_add_and_replace(spark):
    fields = spark.createDataFrame([(1, "weight", "5", 0.7), (1, "pieces", "2", 0.9)], "document_id int, field_name string, field_value string, confidence double")
    changes = spark.createDataFrame([(1, "weight", "6"), (1, "seal", "x"), (1, "pieces", None)], "document_id int, field_name string, field_value string")
    got = {r["field_name"]: (r["field_value"], float(r["confidence"])) for r in review.corrected_fields(fields, changes).collect()}
    assert got == {"weight": ("6", 1.0), "seal": ("x", 1.0), "pieces": (None, 1.0)}
