"""Repair of conversations whose roles do not follow the grammar, by generalised LR parsing.

The grammar of a conversation is: nothing, or an optional system turn followed by pairs of a user and an
assistant turn.  Its LR tables are computed below.  Rows are read from left to right; every
row may be kept, given another role or deleted, and turns may be inserted between rows.  All
ways of doing so are parsed together: their stacks share their lower parts, and of stacks
with equal tops the one with the least (cost, audit) goes on.  That loses nothing, because
here the top of a stack alone decides which rests it accepts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybridge.llm.common import read
from waybridge.llm.trie import CRC_SQL, _arrow, _batches, crc_sql

#: left and right sides; the first is the start, terminals are initials of roles
GRAMMAR = (("C", ""), ("C", "B"), ("C", "sB"), ("B", "ua"), ("B", "Bua"))
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
END = "$"
#: what takes any top at most to where another one is: a system turn deleted, a pair inserted
DEAR = DELETE + 2 * INSERT
#: decided rows are given out once so many rows wait for a decision
WAITING = 512


def tables() -> tuple[dict, dict]:
    """(go, reduce): successor state by (state, symbol), and rule by (state, next terminal)."""
    left = {a for a, _ in GRAMMAR}

    def closed(items: frozenset) -> frozenset:
        out = set(items)
        while more := {
            (rule, 0)
            for i, at in out
            for rule, (a, _) in enumerate(GRAMMAR)
            if GRAMMAR[i][1][at : at + 1] == a
        } - out:
            out |= more
        return frozenset(out)

    follow = {a: set() for a in left}
    follow[GRAMMAR[0][0]].add(END)
    for _ in GRAMMAR:
        for a, right in GRAMMAR:
            for at, x in enumerate(right):
                after = right[at + 1 : at + 2]
                if x in left:
                    follow[x] |= follow[a] if not after else {after}
    states = [closed(frozenset((i, 0) for i, (a, _) in enumerate(GRAMMAR) if a == GRAMMAR[0][0]))]
    go, reduce = {}, {}
    for number, state in enumerate(states):
        for symbol in {GRAMMAR[i][1][at] for i, at in state if at < len(GRAMMAR[i][1])}:
            to = closed(frozenset((i, at + 1) for i, at in state if GRAMMAR[i][1][at : at + 1] == symbol))
            if to not in states:
                states.append(to)
            go[number, symbol] = states.index(to)
        for i, at in state:
            if at == len(GRAMMAR[i][1]):
                reduce.update({(number, x): i for x in follow[GRAMMAR[i][0]]})
    return go, reduce


GO, REDUCE = tables()


class Top:
    """A stack top: its state, what lies below, and the best way there.

    ``rank`` orders ways by their audit up to the last row, ``since`` are the letters after it,
    ``trail`` is the chain (before, letter, role, text, length) of all that is undelivered.
    """

    __slots__ = ("below", "cost", "rank", "since", "state", "trail")

    def __init__(self, state, below, cost, rank, since, trail) -> None:
        self.state, self.below = state, below
        self.cost, self.rank, self.since, self.trail = cost, rank, since, trail

    def order(self) -> tuple:
        return self.cost, self.rank, self.since


def shifted(top: Top, symbol: str) -> tuple | None:
    """(state, below) after all reductions that ``symbol`` asks for and its shift."""
    state, below = top.state, top
    while (rule := REDUCE.get((state, symbol))) is not None:
        name, right = GRAMMAR[rule]
        for _ in right:
            below = below.below
        state = GO.get((below.state, name))
        if state is None:  # the start symbol is complete
            return (None, None) if symbol == END else None
        below = Top(state, below, 0, 0, "", None)
    to = GO.get((state, symbol))
    return None if to is None else (to, below)


def _put(tops: dict, top: Top) -> bool:
    old = tops.get(top.state)
    if old is None or top.order() < old.order():
        tops[top.state] = top
        return True
    return False


def _step(top: Top, symbol: str, cost: int, letter: str, role, text) -> Top | None:
    to = shifted(top, symbol)
    if to is None:
        return None
    trail = [top.trail, letter, role, text, top.trail[4] + 1]
    return Top(*to, top.cost + cost, top.rank, top.since + letter, trail)


def with_inserts(tops: dict) -> dict:
    """The tops and all that insertions make of them at least cost."""
    out, todo = dict(tops), list(tops.values())
    while todo:
        top = todo.pop()
        if out[top.state] is not top:
            continue
        for symbol, role in ROLES.items():
            new = _step(top, symbol, INSERT, "I", role.encode(), b"")
            if new is not None and _put(out, new):
                todo.append(new)
    return out


def after_row(tops: dict, role: bytes, text: bytes, fault: str | None) -> dict:
    """The tops after one more row, which may be kept, given a role or deleted."""
    out: dict = {}
    initial = chr(role[0]) if role[:1] in (b"s", b"u", b"a") else None
    cut = CUT if fault == "truncated" else 0
    for top in with_inserts(tops).values():
        trail = [top.trail, "D", None, None, top.trail[4] + 1]
        _put(out, Top(top.state, top.below, top.cost + DELETE, top.rank, top.since + "D", trail))
        if fault in ("blank", "duplicate"):
            continue
        if initial and (new := _step(top, initial, KEEP + cut, "K", role, text)):
            _put(out, new)
        for symbol, name in ROLES.items():
            if new := _step(top, symbol, REROLE + cut, "R", name.encode(), text):
                _put(out, new)
    # a top that costs more than the way there from the cheapest one is on no best way
    most = min(t.cost for t in out.values()) + DEAR
    out = {state: top for state, top in out.items() if top.cost <= most}
    for rank, top in enumerate(sorted(out.values(), key=lambda t: (t.rank, t.since))):
        top.rank, top.since = rank, ""
    return out


def finished(tops: dict) -> Top:
    """The cheapest top that ends a conversation."""
    ends = [t for t in with_inserts(tops).values() if shifted(t, END) == (None, None)]
    return min(ends, key=Top.order)


def _meeting(trails: list):
    """The last step that all trails have in common."""
    while any(t is not trails[0] for t in trails):
        longest = max(t[4] for t in trails)
        trails = [t[0] if t[4] == longest else t for t in trails]
    return trails[0]


def _steps(trail) -> list:
    """Steps up to ``trail`` that have not been delivered; they are forgotten."""
    out, at = [], trail
    while at[0] is not None:
        out.append((at[1], at[2], at[3]))
        at = at[0]
    trail[0] = None
    return out[::-1]


def repaired(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Steps (letter, role, text) of the cheapest repair of (role, text, fault) rows.

    A step is given out as soon as all ways that are still open agree on it, so few rows wait.
    """
    start = [None, "", None, None, 0]
    tops = {0: Top(0, None, 0, 0, "", start)}
    waiting, limit = 0, WAITING
    for role, text, fault in rows:
        tops = after_row(tops, role, text, fault)
        waiting += 1
        if waiting >= limit:
            known = _steps(_meeting([t.trail for t in tops.values()]))
            yield from known
            waiting -= sum(step[0] != "I" for step in known)
            limit = max(WAITING, 2 * waiting)
    yield from _steps(finished(tops).trail)


class Faults:
    """Names the first fault of each row of a conversation and counts what it sees."""

    def __init__(self) -> None:
        self.seen: set[bytes] = set()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.last = None
        self.turns, self.before = 0, None

    def of(self, turn: int | None, role: bytes, text: bytes) -> str | None:
        if turn is not None and turn != self.last:
            self.low = turn if self.low is None else self.low
            self.high = self.last = turn
            self.turns += 1
        if self.before is not None:
            self.illegal += self.before + role[:1] not in (b"su", b"ua", b"au")
        self.before = role[:1]
        key = hashlib.blake2b(b"%d:%b%b" % (len(role), role, text), digest_size=16).digest()
        known = key in self.seen
        self.seen.add(key)
        solid = text.strip()  # of bytes: exactly the six ASCII white space characters
        if not solid:
            self.blank += 1
            return "blank"
        if known:
            self.duplicate += 1
            return "duplicate"
        if solid[-1:] not in (b".", b"!", b"?"):
            self.truncated += 1
            return "truncated"
        return None

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


COST = {"D": DELETE, "I": INSERT, "K": KEEP, "R": REROLE}
REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long,"
    " cost long, audit string, repaired_sha256 string"
)


def _ordered(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, present_col: str | None):
    text = {c: F.coalesce(F.col(n), F.lit(" ")) for c, n in (("role", role_col), ("text", text_col))}
    rows = turns.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(turn_col).cast("long").alias("turn"),
        *(c.alias(n) for n, c in text.items()),
        (F.col(present_col) if present_col else F.lit(True)).alias("present"),
    )
    return rows.repartition("id").sortWithinPartitions(
        "id", F.asc_nulls_first("turn"), "role", "text"
    )


def _conversations(batches: Iterator) -> Iterator[tuple]:
    """(id, rows) by conversation; the rows of one must be used up before the next is asked for."""
    import itertools

    import pyarrow as pa

    def rows():
        for batch in batches:
            texts = [batch.column(c).cast(pa.binary()).to_pylist() for c in ("role", "text")]
            yield from zip(
                *(batch.column(c).to_pylist() for c in ("id", "turn", "present")), *texts, strict=True
            )

    for key, own in itertools.groupby(rows(), key=lambda r: r[0]):
        yield key, ((turn, role, text) for _, turn, present, role, text in own if present)


def _parsed(faults: Faults, rows: Iterator[tuple], cost: list[int]) -> Iterator[tuple]:
    """Steps of the repair; ``cost[0]`` holds their cost afterwards."""

    def named():
        for turn, role, text in rows:
            yield role, text, faults.of(turn, role, text)

    for letter, role, text in repaired(named()):
        cost[0] += COST[letter]
        if letter in "KR" and text.strip()[-1:] not in (b".", b"!", b"?"):
            cost[0] += CUT
        yield letter, role, text


def repair_report(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    present_col: str | None = None,
) -> DataFrame:
    """One row per conversation: faults found, the cheapest repair and the hash of its outcome.

    Rows are ordered by turn, null first, then by role and text; null roles and texts are one space.
    A null id is a conversation like any other.  Rows where ``present_col`` is false only name
    their conversation.  A row's first fault counts: blank, duplicate (role and text met
    before), truncated (does not end in ``.``, ``!`` or ``?``).  Audit letters are K, R, D, I for
    kept, given a role, deleted and inserted; ties go to the audit that sorts first.

    One shuffle by conversation.  A worker streams the rows; it holds a digest of each
    row of one conversation (about 100 bytes) and the few rows that are not decided yet.
    """

    def work(batches: Iterator) -> Iterator:
        def reports():
            for key, rows in _conversations(batches):
                faults, cost, audit, seen, first = Faults(), [0], [], hashlib.sha256(), True
                for letter, role, text in _parsed(faults, rows, cost):
                    audit.append(letter)
                    if role is not None:
                        seen.update((b"" if first else b"\n") + role + b":" + text)
                        first = False
                yield (
                    key, faults.gaps(), faults.blank, faults.duplicate, faults.truncated,
                    faults.illegal, cost[0], "".join(audit), seen.hexdigest(),
                )

        kinds = dict(part.split() for part in REPORT.split(","))
        yield from _batches(reports(), _arrow(**kinds))

    return _ordered(turns, id_col, turn_col, role_col, text_col, present_col).mapInArrow(work, REPORT)


def repaired_turns(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    present_col: str | None = None,
) -> DataFrame:
    """(conv_id, position, action, role, text): the repaired conversations themselves.

    Deleted rows are left out; positions count from 0.  The rules are those of ``repair_report``.
    """

    def work(batches: Iterator) -> Iterator:
        def steps():
            for key, rows in _conversations(batches):
                at = 0
                for letter, role, text in _parsed(Faults(), rows, [0]):
                    if role is not None:
                        yield key, at, letter, role, text
                        at += 1

        kinds = {"conv_id": "long", "position": "long", "action": "string", "role": "binary", "text": "binary"}
        yield from _batches(steps(), _arrow(**kinds))

    schema = "conv_id long, position long, action string, role binary, text binary"
    return (
        _ordered(turns, id_col, turn_col, role_col, text_col, present_col)
        .mapInArrow(work, schema)
        .withColumns({c: F.col(c).cast("string") for c in ("role", "text")})
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present) with one fault in a quarter of the rows.

    The crc32 of ``conv_id:turn`` modulo 20 decides: 0 drops the row (it stays with ``present``
    false), 1 empties the text, 2 takes its closing marks out, 3 repeats the row, 4 makes it a
    user's.  Nulls are one space, but a null turn still sorts first.
    """

    def shown(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn"))) % 20
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    gone = F.col("kind") == 0
    return rows.select(
        "conv_id",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(F.col("kind") == 4, "user").when(~gone, F.col("role")).alias("role"),
        F.when(~gone, text).alias("text"),
        (~gone).alias("present"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(read(spark, sf_dir, "conversations")), present_col="present")


QUERIES = {"op12_structure_repair": op12_structure_repair}
SQL = {
    "op12_structure_repair": rf"""
with recursive {CRC_SQL},
raw as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
coded as (select raw.*, {crc_sql("key")} % 20 as kind from raw, crc),
harmed as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text,
         unnest(range(case when kind = 3 then 2 else 1 end)) as copy
  from coded where kind <> 0),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as solid
  from harmed),
marked as (
  select *, case when solid = '' then 'blank'
                 when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
                 when right(solid, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
         lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as pair
  from placed),
ids as (select distinct conv_id from conversations),
counts as (
  select ids.conv_id, count(i) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
         count(*) filter (fault = 'truncated') as truncated,
         count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
  from ids left join marked on marked.conv_id is not distinct from ids.conv_id group by 1),
-- states: b(egin), s(ystem read), u(ser read), p(air complete)
inserts(a, m, cost, letters, body) as (values
  ('b', 'b', 0, '', ''), ('s', 's', 0, '', ''), ('u', 'u', 0, '', ''), ('p', 'p', 0, '', ''),
  ('b', 'u', 3, 'I', chr(10) || 'user:'), ('s', 'u', 3, 'I', chr(10) || 'user:'), ('p', 'u', 3, 'I', chr(10) || 'user:'),
  ('u', 'p', 3, 'I', chr(10) || 'assistant:'),
  ('b', 'p', 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), ('s', 'p', 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
moves(m, z, initial) as (values ('b', 's', 's'), ('b', 'u', 'u'), ('s', 'u', 'u'), ('p', 'u', 'u'), ('u', 'p', 'a')),
edits as (
  select m, z, initial, 'K' as letter, 0 as cost from moves
  union all select m, z, initial, 'R', 3 from moves where initial <> 's'
  union all select distinct m, m, '', 'D', 4 from (select m from inserts)),
ways as (
  select ins.a, ed.z, ed.letter, ed.initial, ins.cost + ed.cost as cost, ins.letters || ed.letter as letters, ins.body
  from inserts ins join edits ed using (m)),
best as (
  select conv_id, 0::bigint as i, 'b' as state, {{'c': 0::bigint, 'a': '', 't': ''}} as way from counts
  union all
  select conv_id, i, z, min(way) from (
    select b.conv_id, r.i, w.z, {{
      'c': b.way.c + w.cost + case when w.letter <> 'D' and r.fault = 'truncated' then 3 else 0 end,
      'a': b.way.a || w.letters,
      't': b.way.t || w.body || case w.letter when 'K' then chr(10) || r.role || ':' || r.text
             when 'R' then chr(10) || case w.initial when 'u' then 'user' else 'assistant' end || ':' || r.text
             else '' end }} as way
    from best b join marked r on r.conv_id is not distinct from b.conv_id and r.i = b.i + 1
    join ways w on w.a = b.state and (w.letter = 'D' or (r.fault not in ('blank', 'duplicate')
         and (w.letter = 'R' or w.initial = left(r.role, 1)))))
  group by conv_id, i, z),
ends as (
  select counts.conv_id, min({{'c': b.way.c + ins.cost, 'a': b.way.a || ins.letters, 't': b.way.t || ins.body}}) as way
  from counts join best b on b.conv_id is not distinct from counts.conv_id and b.i = counts.n
  join inserts ins on ins.a = b.state and ins.m in ('b', 'p') group by 1)
select counts.conv_id, gaps::bigint as gaps, blank, duplicate, truncated, illegal, way.c as cost, way.a as audit,
       sha256(substr(way.t, 2)) as repaired_sha256
from counts join ends on ends.conv_id is not distinct from counts.conv_id
"""
}
