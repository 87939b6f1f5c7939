"""Removal of long passages that occur more than once, by recompression.

Words are named by hashes.  A round of recompression first joins runs of one symbol, then every pair
of a left and a right symbol, where a hash of its name puts a symbol on one of the sides; the
name of what is joined is a hash of the joined names.  Names are therefore the same in
every document and every task, and no exchange is needed to agree on them.  Equal passages get
equal symbols but for the few at their ends.  Every symbol carries its context, the words
that alone decide that it is there; a window of words that holds the context of a symbol
holds that symbol wherever the window occurs.

Each window takes the best symbol whose context it holds as its anchor, and neighbouring windows
with one anchor make a region.  Three exchanges follow.  The first finds anchors whose context
occurs again.  The second compares whole regions of
such anchors: equal ones are repeats as they stand.  Regions that share an anchor and differ
lie at the ends of a repeat; the third compares their windows one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybridge.llm.common import byte_texts, read, texts
from waybridge.llm.trie import _arrow, _batch
from waybridge.session import durable_dir

#: words of a window
WINDOW = 35
#: least words of an anchor, by rounds of recompression from the last to none
LEAST = (1, 1, 1, 1, 1)
#: windows of one piece of a text; pieces overlap, so nothing is lost between them
PIECE = 1 << 16
#: words compressed together
TOGETHER = 1 << 18
#: words whose hashes a worker remembers
REMEMBERED = 200_000
FAR = 1 << 60
#: multipliers of the two rolling hashes
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def mixed(x):
    """A bijective scramble of unsigned 64-bit numbers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Symbols:
    """Symbols of a sequence of pieces: name, words [start, end), context [low, high).

    ``first`` marks symbols that begin a piece.  A context that reaches beyond a piece is far away.
    """

    def __init__(self, name, start, end, low, high, first) -> None:
        self.name, self.start, self.end = name, start, end
        self.low, self.high, self.first = low, high, first

    def _neighbours(self):
        """Contexts of the symbols before and after each; far where a piece ends."""
        import numpy as np

        before = np.full(len(self.name), -FAR)
        after = np.full(len(self.name), FAR)
        inner = ~self.first[1:]
        before[1:][inner] = self.low[:-1][inner]
        after[:-1][inner] = self.high[1:][inner]
        return before, after

    def runs(self) -> Symbols:
        """Runs of one symbol as one; what stands on both sides decides where a run ends."""
        import numpy as np

        before, after = self._neighbours()
        begins = np.ones(len(self.name), bool)
        begins[1:] = (self.name[1:] != self.name[:-1]) | self.first[1:]
        at = np.flatnonzero(begins)
        last = np.append(at[1:], len(begins)) - 1
        long = last > at
        name = self.name[at]
        name[long] = mixed(name[long] + mixed((last - at)[long].astype(np.uint64)))
        low = np.minimum(self.low[at], before[at])
        high = np.maximum(self.high[last], after[last])
        return Symbols(name, self.start[at], self.end[last], low, high, self.first[at])

    def pairs(self, seed: int) -> Symbols:
        """Every left symbol joined with a right one that follows it."""
        import numpy as np

        before, after = self._neighbours()
        right = (mixed(self.name + np.uint64(seed * 0x632BE59BD9B4E019 % 2**64)) & np.uint64(1)).astype(bool)
        joined = np.zeros(len(self.name), bool)
        joined[:-1] = ~right[:-1] & right[1:] & ~self.first[1:]
        second = np.zeros(len(self.name), bool)
        second[1:] = joined[:-1]
        low = np.where(right & ~second, np.minimum(self.low, before), self.low)
        high = np.where(right | joined, self.high, np.maximum(self.high, after))
        name, end = self.name.copy(), self.end.copy()
        at = np.flatnonzero(joined)
        name[at] = mixed(self.name[at] * np.uint64(3) + mixed(self.name[at + 1] + np.uint64(seed)))
        end[at] = self.end[at + 1]
        low[at] = np.minimum(self.low[at], self.low[at + 1])
        high[at] = np.maximum(self.high[at], self.high[at + 1])
        keep = ~second
        return Symbols(name[keep], self.start[keep], end[keep], low[keep], high[keep], self.first[keep])


def anchors(hashes, first, windows, width: int = WINDOW):
    """(low, high, symbol): context and number of the anchor of each window that begins at ``windows``.

    The last round is asked first; of the symbols there with enough words the one with the
    smallest scrambled name is taken, the leftmost of equal ones.  A single word is
    an anchor without context, so every window has one.
    """
    import numpy as np

    places = np.arange(len(hashes), dtype=np.int64)
    levels = [Symbols(hashes, places, places + 1, places, places + 1, first)]
    levels.append(levels[0].runs())
    while len(levels) < len(LEAST):
        levels.append(levels[-1].pairs(len(levels)))
    low, high, symbol = (np.zeros(len(windows), np.int64) for _ in range(3))
    left = np.arange(len(windows))
    for number, (least, level) in enumerate(zip(LEAST, levels[::-1], strict=True)):
        fit = (level.end - level.start >= least) & (level.low > -FAR) & (level.high < FAR)
        fit = np.flatnonzero(fit)
        lows, highs = level.low[fit], level.high[fit]
        key = mixed(level.name[fit] ^ np.uint64(number)) & ~np.uint64(2**24 - 1)
        key |= np.arange(len(fit), dtype=np.uint64)
        at = windows[left]
        a = np.searchsorted(lows, at)
        b = np.searchsorted(highs, at + width, "right")
        have = a < b
        if have.any():
            ends = np.stack([a[have], b[have]], 1).ravel()
            best = np.minimum.reduceat(np.append(key, key[-1:]), ends)[::2] & np.uint64(2**24 - 1)
            best = best.astype(np.int64)
            low[left[have]], high[left[have]] = lows[best], highs[best]
            symbol[left[have]] = (number << 32) + fit[best]
        left = left[~have]
        if not len(left):
            break
    return low, high, symbol


class Words:
    """Hashes of words, remembered up to a bound."""

    class _Known(dict):
        def __missing__(self, word: bytes) -> int:
            import xxhash

            value = self[word] = xxhash.xxh64_intdigest(word, 13)
            return value

    def __init__(self) -> None:
        self.known = self._Known()

    def of(self, words: list[bytes]):
        import numpy as np

        if len(self.known) > REMEMBERED:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


class Rolling:
    """Two independent 64-bit hashes of any range of words."""

    def __init__(self) -> None:
        self.powers = []

    def _powers(self, n: int):
        import numpy as np

        if not self.powers or len(self.powers[0][0]) < n:
            self.powers = []
            for base in BASES:
                pair = []
                for b in (base, pow(base, -1, 2**64)):
                    steps = np.full(n, b, np.uint64)
                    steps[:1] = 1
                    pair.append(np.cumprod(steps))
                self.powers.append(pair)
        return self.powers

    def over(self, hashes):
        """A function from starts and ends to the two hashes of the words between."""
        import numpy as np

        n = len(hashes)
        lanes = []
        for lane, (up, down) in enumerate(self._powers(n + 1)):
            values = mixed(hashes + np.uint64(lane))
            lanes.append((np.append(np.uint64(0), np.cumsum(values * up[:n])), down))

        def of(start, end):
            return [mixed((sums[end] - sums[start]) * down[start]) for sums, down in lanes]

        return of


#: kinds of rows: a region to compare, windows known to repeat, a text and its number
REGION, COVERED, TEXT = 0, 1, 2
FOUND = (
    "kind int, text_no long, lo int, n int, name long, r1 long, r2 int, copies int, k1 long, k2 long"
)


def _as_long(x):
    import numpy as np

    return x.astype(np.uint64).view(np.int64)


def _grouped(*keys):
    """(order, group, heads): rows sorted by keys, the group of each, and where groups begin."""
    import numpy as np

    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        ranked = key[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


class Finder:
    """Regions of texts with their anchors; equal ones of one batch are met here already."""

    def __init__(self, width: int, base: int = 0) -> None:
        self.width, self.words, self.rolling = width, Words(), Rolling()
        self.next = base

    def rows(self, texts: dict[tuple, tuple[bytes, int]]) -> Iterator[list]:
        """Columns of FOUND for {key: (text, copies)}."""
        pieces, size = [], 0
        for key, (text, copies) in texts.items():
            words = text.split()
            if len(words) < self.width:
                continue
            hashes = self.words.of(words)
            for at in range(0, len(words) - self.width + 1, PIECE):
                part = hashes[at : at + PIECE + self.width - 1]
                pieces.append((self.next, copies, at, part, key))
                size += len(part)
                if size >= TOGETHER:
                    yield self._found(pieces)
                    pieces, size = [], 0
            self.next += 1
        if pieces:
            yield self._found(pieces)

    def _found(self, pieces: list[tuple]) -> list:
        import numpy as np

        sizes = np.array([len(p[3]) for p in pieces])
        starts = np.cumsum(sizes) - sizes
        hashes = np.concatenate([p[3] for p in pieces])
        first = np.zeros(len(hashes), bool)
        first[starts] = True
        counts = sizes - self.width + 1
        owner = np.repeat(np.arange(len(pieces)), counts)
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        windows = starts[owner] + inside
        low, high, symbol = anchors(hashes, first, windows, self.width)
        new = np.ones(len(windows), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        n = np.append(at[1:], len(windows)) - at
        start, own = windows[at], owner[at]
        over = self.rolling.over(hashes)
        # an anchor is named by all words of its context, which every window of its region holds
        name = over(low[at], high[at])[0]
        r1, r2 = over(start, start + n + self.width - 1)
        r2 = (r2 >> np.uint64(32)).astype(np.uint32).view(np.int32)
        copies = np.array([p[1] for p in pieces])[own]
        order, group, heads = _grouped(r1, r2, n)
        total = np.bincount(group, weights=copies[order]).astype(np.int64)
        many = np.empty(len(order), np.int64)
        many[order] = total[group]
        kept = np.sort(order[heads])
        base = np.array([p[2] for p in pieces])[own] + inside[at]
        number = np.array([p[0] for p in pieces])
        # neighbouring regions that repeat within the batch leave as one range
        sure = np.flatnonzero(many > 1)
        joint = np.ones(len(sure), bool)
        joint[1:] = (np.diff(sure) != 1) | (own[sure[1:]] != own[sure[:-1]])
        begins = np.flatnonzero(joint)
        length = np.add.reduceat(n[sure], begins) if len(sure) else n[:0]
        sure = sure[begins]
        begun = [i for i, p in enumerate(pieces) if p[2] == 0]
        keys = np.array([pieces[i][4] for i in begun], np.int64).reshape(-1, 2)
        pad = len(sure) + len(begun)

        def column(region, covered=0, text=0):
            filled = (np.broadcast_to(x, m) for x, m in ((covered, len(sure)), (text, len(begun))))
            return np.concatenate([np.broadcast_to(region, len(kept)), *filled])

        return [
            column(REGION, COVERED, TEXT),
            column(number[own[kept]], number[own[sure]], number[begun]),
            column(base[kept], base[sure]),
            column(n[kept], length),
            np.append(_as_long(name[kept]), np.zeros(pad, np.int64)),
            np.append(_as_long(r1[kept]), np.zeros(pad, np.int64)),
            np.append(r2[kept], np.zeros(pad, np.int32)),
            column(np.minimum(many[kept], 2)),
            column(0, 0, keys[:, 0]),
            column(0, 0, keys[:, 1]),
        ]


def _written(df: DataFrame, purpose: str) -> DataFrame:
    """A table in the shared folder, packed tightly: most of it are texts or small numbers."""
    path = durable_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key() -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2")]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts(docs, id_col, text_col)


def regions(rows: DataFrame, width: int = WINDOW) -> DataFrame:
    """FOUND rows of a table (id, text).

    Texts are numbered by task; written once, the numbers stand for the texts from then on.
    """

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        finder = Finder(width, TaskContext.get().partitionId() << 32)
        schema = _arrow(**dict(p.split() for p in FOUND.split(",")))
        for batch in batches:
            keys = zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True)
            met: dict[tuple, tuple[bytes, int]] = {}
            for key, text in zip(keys, byte_texts(batch.column("text")), strict=True):
                met[key] = (text, met[key][1] + 1 if key in met else 1)
            for columns in finder.rows(met):
                arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return rows.select(*text_key(), "text").mapInArrow(work, FOUND)


def compared(found: DataFrame) -> DataFrame:
    """(text_no, kind, lo, n, copies): what is known of each text's windows.

    COVERED ranges repeat; of REGION ranges the windows have to be compared.  Counts are
    summed before they are shuffled, and joined to rows, which can be split, by name.
    """
    rows = found.filter(F.col("kind") == REGION)
    # 40 bits travel cheaper than 64; a name alike in them with another is sent on and found alone below
    short = F.col("name").bitwiseAND(F.lit(2**40 - 1))
    names = rows.groupBy(short.alias("short")).agg(F.sum("copies").alias("c")).filter("c > 1").select("short")
    at = ["text_no", "lo", "n"]
    same = ["name", "r1", "r2", "n"]
    # a region has at most as many windows as a window has words, so three numbers fit in one
    place = F.col("lo").cast("long") * (1 << 16) + F.col("n") * 2 + (F.col("copies") - 1)
    again = _written(
        rows.select("name", "r1", "r2", "text_no", place.alias("place"))
        .join(names, short == F.col("short"), "left_semi")
        .select(
            "name", "r1", "r2", "text_no",
            F.shiftright("place", 16).cast("int").alias("lo"),
            (F.shiftright("place", 1) % (1 << 15)).cast("int").alias("n"),
            (F.col("place") % 2 + 1).cast("int").alias("copies"),
        ),
        "again",
    )
    each = _written(
        again.groupBy(*same).agg(
            F.least(F.sum("copies"), F.lit(2)).cast("int").alias("copies"),
            F.min(F.struct("text_no", "lo")).alias("one"),
        ),
        "regions",
    )
    ends = each.groupBy("name").agg(F.count("*").alias("c")).filter("c > 1").select("name")
    equal = again.join(each.filter("copies > 1").select(*same), same, "left_semi").select(*at)
    sure = found.filter(F.col("kind") == COVERED).select(*at).unionByName(equal)
    differ = each.join(ends, "name", "left_semi").select(
        "one.text_no", F.lit(REGION).alias("kind"), "one.lo", "n", "copies"
    )
    return sure.select(
        "text_no", F.lit(COVERED).alias("kind"), "lo", "n", F.lit(2).alias("copies")
    ).unionByName(differ)


def _covered(n: int, ranges, width: int):
    """Mask of the words that the windows of ``ranges`` (first, number) cover."""
    import numpy as np

    step = np.zeros(n + 1, np.int64)
    for lo, count in ranges:
        step[lo] += 1
        step[min(lo + count + width - 1, n)] -= 1
    return np.cumsum(step[:n]) > 0


def _outcome(text: bytes, ranges, width: int, form: str) -> tuple:
    import hashlib

    words = text.split()
    kept = words
    if ranges:
        gone = _covered(len(words), ranges, width).tolist()
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
    rest = b" ".join(kept)
    out = hashlib.sha256(rest).hexdigest() if form == "sha256" else rest
    return len(words), len(words) - len(kept), out


#: kinds of rows after texts have met their ranges
DONE, WAITS, ASKED = 0, 1, 2


class Asked:
    """Windows of some texts that have to be compared; equal ones of a batch are met here already."""

    def __init__(self, width: int) -> None:
        self.width, self.words, self.rolling = width, Words(), Rolling()
        self.parts: list[tuple] = []

    def add(self, owner: int, words: list[bytes], lo: int, n: int, copies: int) -> None:
        part = self.words.of(words[lo : lo + n + self.width - 1])
        self.parts.append((owner, lo, copies, part))

    def taken(self):
        """(owner, lo, h1, h2, copies, repeats, speaks) of all windows added so far, as arrays.

        ``repeats`` are windows met again here; one of equal windows ``speaks`` for them.
        """
        import numpy as np

        parts, self.parts = self.parts, []
        sizes = np.array([len(p[3]) for p in parts])
        starts = np.cumsum(sizes) - sizes
        counts = sizes - self.width + 1
        of = np.repeat(np.arange(len(parts)), counts)
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = starts[of] + inside
        h1, h2 = self.rolling.over(np.concatenate([p[3] for p in parts]))(at, at + self.width)
        h2 = (h2 >> np.uint64(32)).astype(np.uint32).view(np.int32)
        copies = np.array([p[2] for p in parts])[of]
        order, group, heads = _grouped(h1, h2)
        total = np.bincount(group, weights=copies[order]).astype(np.int64)
        many = np.empty(len(of), np.int64)
        many[order] = total[group]
        speaks = np.zeros(len(of), bool)
        speaks[order[heads]] = True
        owner = np.array([p[0] for p in parts])[of]
        lo = np.array([p[1] for p in parts])[of] + inside
        return owner, lo, _as_long(h1), h2, np.minimum(many, 2), many > 1, speaks


def drop_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WINDOW,
    form: str = "text",
) -> DataFrame:
    """(id, n_words, n_removed, kept): texts without the words of windows that occur more than once.

    Words are separated by ASCII white space and kept as they are, joined by one space.  A window is
    ``width`` consecutive words of one text; it repeats if its words begin anywhere else, in
    the same text or another, copies and overlapping places included.  All windows are judged on the
    input.  Null texts are empty; texts shorter than a window lose nothing; every row of
    ``docs`` gives one row, equal rows and null ids as well.  Other columns play no part.
    ``form`` is "text" for the texts that are left or "sha256" for their hash.

    Regions are compared by 96 bits beside the 64 of their context, windows by 96.  Texts are cut into pieces, so a
    worker's memory does not grow with the length of a text beyond its words.
    """
    rows = _rows(docs, id_col, text_col)
    found = _written(regions(rows, width), "found")
    numbers = found.filter(F.col("kind") == TEXT).select("text_no", "k1", "k2")
    ranges = (
        compared(found)
        .join(numbers, "text_no")
        # copies in other batches have other numbers and the same ranges
        .groupBy("k1", "k2", "kind", "lo", "n", "copies")
        .agg(F.min("text_no").alias("text_no"))
        .groupBy("k1", "k2")
        .agg(
            F.collect_list(F.when(F.col("kind") == COVERED, F.struct("lo", "n"))).alias("sure"),
            F.collect_list(F.when(F.col("kind") == REGION, F.struct("lo", "n", "copies"))).alias("asked"),
            F.min("text_no").alias("text_no"),
        )
    )
    joined = rows.select("id", *text_key(), "text").join(ranges, ["k1", "k2"], "left").drop("k1", "k2")
    id_type = rows.schema["id"].dataType.simpleString()
    kept = "string" if form == "sha256" else "binary"
    result = f"id {id_type}, n_words long, n_removed long, kept {kept}"
    extra = "kind int, text binary, text_no long, ranges binary, h1 long, h2 int, lo int, copies int"

    def met(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        asked, schema = Asked(width), None
        for batch in batches:
            if schema is None:
                fields = dict(p.split() for p in f"n_words long, n_removed long, kept {kept}, {extra}".split(","))
                schema = pa.schema([pa.field("id", batch.schema.field("id").type), *_arrow(**fields)])
            texts = byte_texts(batch.column("text"))
            sure, open_, seen = {}, {}, set()
            for i, (ranges, questions, number) in enumerate(
                zip(*(batch.column(c).to_pylist() for c in ("sure", "asked", "text_no")), strict=True)
            ):
                if ranges:
                    sure[i] = [(r["lo"], r["n"]) for r in ranges]
                if not questions:
                    continue
                if any(r["copies"] == 1 for r in questions):
                    open_[i] = False
                if number not in seen:
                    seen.add(number)
                    words = texts[i].split()
                    for r in questions:
                        asked.add(i, words, r["lo"], r["n"], r["copies"])
            if asked.parts:
                owner, lo, h1, h2, copies, repeats, speaks = asked.taken()
                for i, p in zip(owner[repeats].tolist(), lo[repeats].tolist(), strict=True):
                    if i in open_:
                        sure.setdefault(i, []).append((p, 1))
                for i in set(owner[~repeats].tolist()) & open_.keys():
                    open_[i] = True
                numbers = np.array([x or 0 for x in batch.column("text_no").to_pylist()])[owner[speaks]]
                m = int(speaks.sum())
                columns = {
                    "kind": np.full(m, ASKED), "text_no": numbers, "h1": h1[speaks], "h2": h2[speaks],
                    "lo": lo[speaks], "copies": copies[speaks],
                }
                arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(m, f.type) for f in schema]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)
            held = []
            ids, numbers = (batch.column(c).to_pylist() for c in ("id", "text_no"))
            for i, (key, text, number) in enumerate(zip(ids, texts, numbers, strict=True)):
                if open_.get(i):
                    packed = np.array(sure.get(i, []), "<i4").tobytes()
                    held.append((key, None, None, None, WAITS, text, number, packed, *[None] * 4))
                else:
                    held.append((key, *_outcome(text, sure.get(i), width, form), DONE, *[None] * 7))
            yield _batch(held, schema)

    state = _written(joined.mapInArrow(met, f"{result}, {extra}"), "met")
    asked = state.filter(F.col("kind") == ASKED)
    twice = asked.groupBy("h1", "h2").agg(F.sum("copies").alias("c")).filter("c > 1").select("h1", "h2")
    places = (
        asked.filter("copies = 1")
        .select("h1", "h2", "text_no", "lo")
        .join(twice, ["h1", "h2"], "left_semi")
        .groupBy("text_no")
        .agg(F.collect_list("lo").alias("more"))
    )
    waits = state.filter(F.col("kind") == WAITS).select("id", "text", "text_no", "ranges")

    def finished(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fields = _arrow(n_words="long", n_removed="long", kept=kept)
            schema = pa.schema([pa.field("id", batch.schema.field("id").type), *fields])
            columns = (batch.column(c).to_pylist() for c in ("id", "text", "ranges", "more"))
            held = []
            for key, text, packed, more in zip(*columns, strict=True):
                ranges = np.frombuffer(packed, "<i4").reshape(-1, 2).tolist() + [(p, 1) for p in more or ()]
                held.append((key, *_outcome(text, ranges, width, form)))
            yield _batch(held, schema)

    late = waits.join(places, "text_no", "left").select("id", "text", "ranges", "more").mapInArrow(finished, result)
    done = state.filter(F.col("kind") == DONE).select("id", "n_words", "n_removed", "kept")
    return done.unionByName(late).withColumn("kept", F.col("kept").cast("string"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(read(spark, sf_dir, "documents"), form="sha256").select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256")
    )


QUERIES = {"op13_substring_dedup": op13_substring_dedup}
SQL = {
    "op13_substring_dedup": r"""
with words as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (
  select r, p, sha256(array_to_string(w[p + 1:p + 35], ' ')) as h
  from (select r, w, unnest(range(greatest(len(w) - 34, 0))) as p from words)),
again as (select r, p from (select r, p, count(*) over (partition by h) as c from windows) where c > 1),
gone as (select r, list(distinct p + j) as places from again, range(35) t(j) group by 1),
kept as (
  select doc_id, len(w) as n, list_filter(w, lambda x, i: places is null or not list_contains(places, i - 1)) as k
  from words left join gone using (r))
select doc_id, n as n_words, n - len(k) as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept
"""
}
