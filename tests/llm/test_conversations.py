"""Prefix trie and structure repair of conversations against brute force and SQL."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from waybridge.llm import repair, trie

TURNS = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _rebuilt(rows):
    """{conv_id: [(role, text), ...]} with shared first turns, as op11 states it."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns, key=lambda t: t[:2])] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = own.get(head, [])[:h] + turns[h:]
    return out


def _trie(rows):
    members = {}
    for c, turns in _rebuilt(rows).items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append((c, len(turns) == d))
    kids = {}
    for node in members:
        if node:
            kids[node[:-1]] = kids.get(node[:-1], 0) + 1
    out = []
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        out.append((
            min(c for c, _ in own), len(node),
            min(c for c, _ in members[node[:-1]]) if node else None,
            len(own), kids.get(node, 0), sum(n not in kids for n in below),
            sum((len(members[n]) - 1) * len(WORD.findall(n[-1][1])) for n in below if n),
            _sha(",".join(str(c) for c in sorted(c for c, ends in own if ends))),
        ))
    return sorted(map(repr, out))


def _found(spark, rows, monkeypatch, query, columns, shards=None):
    df = spark.createDataFrame(rows, TURNS + ", n int, path string, id int, audit string") if rows else spark.createDataFrame([], TURNS)
    for module in (trie, repair):
        monkeypatch.setattr(module, "read", lambda *_: df)
    if shards:
        monkeypatch.setattr(trie, "splitters", lambda p, _, cut=trie.splitters: cut(p, shards))
        spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        return sorted(repr(tuple(r[c] for c in columns)) for r in query(spark, "").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _conversations(seed, n=90):
    rnd = random.Random(seed)
    texts = ["hi", "hi there", "", "a b  c\td", "é x y", "long " * 300]
    rows = []
    for c in rnd.sample(range(-30, 300), n):
        turns = rnd.choice([0, 1, 2, 3, 5, 9])
        for t in range(turns):
            rows.append((c, t, rnd.choice(["user", "assistant"]), rnd.choice(texts)))
        if turns and rnd.random() < 0.3:
            rows.append((c, None, rnd.choice([None, "system"]), rnd.choice([None, "be kind"])))
    return [(*r, 0, "p", 1, "x") for r in rows]


@pytest.mark.parametrize("shards", [1, 3, 11])
def test_trie_equals_brute_force(spark, monkeypatch, shards):
    rows = _conversations(shards)
    got = _found(spark, rows, monkeypatch, trie.op11_prefix_trie, NODE, shards)
    assert got == _trie([r[:4] for r in rows])


def test_trie_of_copies_deep_and_odd_rows(spark, monkeypatch):
    """A third of all conversations are equal, one is deeper than any splitter, rows repeat, an id is null."""
    rows = [(c, t, "user", f"same {t}") for c in range(2000, 2400) for t in range(4)]
    rows += [(7, t, "user", "again") for t in range(300)] + [(8, t, "user", "again") for t in range(280)]
    rows += [(9, 1, "user", "twice"), (9, 1, "user", "twice"), (None, 0, "user", "nobody")]
    rows = [(*r, 0, "p", 1, "x") for r in rows]
    got = _found(spark, rows, monkeypatch, trie.op11_prefix_trie, NODE, 5)
    assert got == _trie([r[:4] for r in rows])
    assert _found(spark, [], monkeypatch, trie.op11_prefix_trie, NODE) == []


def test_trie_of_plain_conversations_names_its_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b c")], TURNS)
    nodes = {r["depth"]: r for r in trie.prefix_trie(trie.turn_paths(df)).collect()}
    assert [nodes[d]["n_convs"] for d in range(3)] == [2, 2, 1]
    assert nodes[1]["turn_key"] == _sha("4:usera")[:32] and nodes[0]["saved_tokens"] == 1


def _damaged(rows):
    """{conv_id: rows in order} after the damage that op12 states."""
    out = {c: [] for c, *_ in rows}
    for c, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out[c] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {c: sorted(r, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2])) for c, r in out.items()}


def _repair(rows):
    """All edits of a short conversation, tried out."""
    seen, faults = set(), []
    for _, role, text in rows:
        solid = text.strip(" \t\n\v\f\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    best = {("", 0): (0, "", ())}  # (what may follow, row) -> way

    def better(states, key, way):
        if key not in states or way < states[key]:
            states[key] = way

    def inserted(states):
        for _ in range(3):
            for (state, i), (cost, audit, out) in list(states.items()):
                to, role = ("u", "user") if state in ("", "s", "a") else ("a", "assistant")
                better(states, (to, i), (cost + 3, audit + "I", (*out, f"{role}:")))
        return states

    for i, ((_, role, text), fault) in enumerate(zip(rows, faults, strict=True)):
        after = {}
        for (state, _), (cost, audit, out) in inserted(best).items():
            better(after, (state, i), (cost + 4, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            cut = 3 if fault == "truncated" else 0
            for name, letter, extra in ((role, "K", 0), ("user", "R", 3), ("assistant", "R", 3)):
                to = name[:1]
                if (state, to) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    better(after, (to, i), (cost + cut + extra, audit + letter, (*out, f"{name}:{text}")))
        best = after
    cost, audit, out = min(way for (state, _), way in inserted(best).items() if state in ("", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, _sha("\n".join(out)))


REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _chats(seed, n=150):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(n), None]:
        for t in range(rnd.choice([1, 1, 2, 4, 7, 12])):
            role = rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"])
            text = rnd.choice(["Fine.", "What?", "no end", "ends…", " \n", "", None, f"number {t}!", "x" * 5000 + "."])
            rows.append((c, rnd.choice([t, t, t, t + 3, None]), role, text, 0, "p", 1, "x"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_trying_all_edits(spark, monkeypatch, seed):
    rows = _chats(seed)
    got = _found(spark, rows, monkeypatch, repair.op12_structure_repair, REPORT)
    want = sorted(repr((c, *_repair(r))) for c, r in _damaged([r[:4] for r in rows]).items())
    assert got == want


def test_repair_equals_its_sql(spark, monkeypatch, tmp_path):
    rows = _chats(3, 60)
    got = _found(spark, rows, monkeypatch, repair.op12_structure_repair, REPORT)
    spark.createDataFrame(rows, TURNS + ", n int, path string, id int, audit string").write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/c/*.parquet'")
    sql = con.sql(f"select {', '.join(REPORT)} from ({repair.SQL['op12_structure_repair']})").fetchall()
    assert got == sorted(map(repr, sql))


def test_repair_of_a_long_conversation_waits_for_few_rows(spark, monkeypatch):
    """Decided steps leave early, so one long conversation needs little memory."""
    most = []
    steps = repair._steps
    monkeypatch.setattr(repair, "_steps", lambda t: (lambda out: most.append(len(out)) or out)(steps(t)))
    rnd = random.Random(5)
    rows = [(rnd.choice([b"user", b"assistant", b"tool"]), b"%d." % i, None) for i in range(20_000)]
    letters = "".join(step[0] for step in repair.repaired(iter(rows)))
    assert len(letters) - letters.count("I") == len(rows)
    assert max(most) < 2_000


def test_equal_tops_accept_equal_rests():
    """Merging by the top alone is exact: what lies below a top does not change what may follow."""

    def rests(top, depth):
        out = {""} if repair.shifted(top, repair.END) == (None, None) else set()
        if depth:
            for x in "sua":
                to = repair.shifted(top, x)
                if to and to != (None, None):
                    out |= {x + r for r in rests(repair.Top(*to, 0, 0, "", None), depth - 1)}
        return out

    seen, todo = {}, [repair.Top(0, None, 0, 0, "", None)]
    for _ in range(6):
        after = []
        for top in todo:
            language = rests(top, 5)
            assert seen.setdefault(top.state, language) == language
            after += [repair.Top(*to, 0, 0, "", None) for x in "sua" if (to := repair.shifted(top, x)) and to[0] is not None]
        todo = after


def test_repaired_turns_follow_the_grammar(spark):
    df = spark.createDataFrame(
        [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c."), (2, 0, None, None)], TURNS
    )
    got = [tuple(r) for r in repair.repaired_turns(df).orderBy("conv_id", "position").collect()]
    assert got == [
        (1, 0, "K", "user", "a."), (1, 1, "I", "assistant", ""), (1, 2, "K", "user", "b."), (1, 3, "K", "assistant", "c."),
    ]
    assert repair.repair_report(df.limit(0)).count() == 0
