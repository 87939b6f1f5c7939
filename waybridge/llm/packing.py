"""Packing of token sequences into fixed-size bins by minimum bin slack.

A bin is opened with the longest piece left; of all combinations of the other lengths
that fit beside it the fullest is taken.  Subset sums are bits of one long number, which is
shifted and merged once per piece, so the fullest sum is its highest bit.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterable, Iterator
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybridge.llm.common import byte_texts, read, texts, type_of
from waybridge.session import materialized

CAPACITY = 4096
END = 1
VOCABULARY = "word_bpe_49k.json"
#: pieces packed together; the number of groups follows the number of pieces
GROUP = 32_768
#: words of one generation of what a worker remembers; two generations are held
REMEMBERED = 200_000
#: bytes of text whose words are looked up together
STEP_BYTES = 4_000_000
#: words encoded by one call
TOGETHER = 4_000


class Recent:
    """A bounded dictionary that forgets what has not been asked for since the last turn."""

    def __init__(self, size: int = REMEMBERED) -> None:
        self.size, self.young, self.old = size, {}, {}

    def missing(self, keys: Iterable) -> list:
        """Of distinct keys those that are not known; all others are in ``young`` afterwards."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        young, old, new = self.young, self.old, []
        for key in keys:
            if key not in young:
                if key in old:
                    young[key] = old[key]
                else:
                    new.append(key)
        return new


class Vocabulary:
    """A tokenizer with what a worker remembers of it; a worker keeps it for its next tasks."""

    def __init__(self, path: str) -> None:
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.stems = Recent()
        self.apart = all(self.coded(f"Word{m}") == self.coded("word") + self.coded(m) for m in ".,")
        self.marks = {m: self.coded(m) for m in ".,"}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def coded(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def together(self, words: list[str]) -> list[bytes]:
        """The ids of words that are encoded as lines of one text, by the places of the tokens."""
        import numpy as np

        found = self.tokenizer.encode("\n".join(words), add_special_tokens=False)
        data = np.array(found.ids, "<u4").tobytes()
        starts = np.array([o[0] for o in found.offsets], np.int64)
        ends = np.cumsum([len(w) + 1 for w in words])
        cut = [0, *(4 * np.searchsorted(starts, ends)).tolist()]
        return [data[i:j] for i, j in zip(cut, cut[1:])]

    def letters(self, words: list[str]) -> list[bytes]:
        """The same for words of letters, whose last token alone ends a word: no places are needed."""
        import numpy as np

        found = self.tokenizer.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0]
        ids = np.array(found.ids, "<u4")
        at = np.flatnonzero(self.ends[ids]) + 1
        if len(at) != len(words):
            return self.together(words)
        data, cut = ids.tobytes(), [0, *(4 * at).tolist()]
        return [data[i:j] for i, j in zip(cut, cut[1:])]


def encoder(path: str | None):
    """A function from UTF-8 texts to their ids, each as little-endian 32-bit numbers.

    The vocabulary drops white space and never joins across it, so every run
    between white space is encoded once per worker and remembered.  Where it also cuts
    between letters and a closing mark and ignores case, "Word," is put together
    from "word" and ",", which leaves far fewer strings to encode and to remember.  New strings
    are encoded many to a call, on lines of their own, and cut apart afterwards.
    """
    import numpy as np

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    # a Python worker keeps what it has encoded, bounded by REMEMBERED, for its next task
    kept = sys.modules.setdefault("_encoded_words", types.ModuleType("_encoded_words")).__dict__
    vocabulary = kept.get(path) or kept.setdefault(path, Vocabulary(path))
    apart, marks, stems = vocabulary.apart, vocabulary.marks, vocabulary.stems

    def parts(words: list[str]) -> tuple[list[str], list[bytes]]:
        """The strings to encode, and what follows each; words are lower-cased together."""
        found, tails = list(words), [b""] * len(words)
        if not apart:
            return found, tails
        for i, (text, lower) in enumerate(zip(words, "\n".join(words).lower().split("\n"), strict=True)):
            # a final sigma depends on its neighbours in Python and not in the vocabulary
            if not text.isascii() and "\u03a3" in text:
                continue
            if text.isalpha():
                found[i] = lower
            elif text[-1] in marks:
                # lower case may end in a mark that joins what follows
                stem = lower[:-1]
                if stem.isalpha() and text[:-1].isalpha():
                    found[i], tails[i] = stem, marks[text[-1]]
        return found, tails

    def coded(words: list[str]) -> Iterator[bytes]:
        """The ids of distinct words."""
        if not words:
            return iter(())
        split, tails = parts(words)
        plain, others = [], []
        for w in stems.missing(set(split)):
            (plain if w.isalpha() else others).append(w)
        for some, code in ((plain, vocabulary.letters), (others, vocabulary.together)):
            for i in range(0, len(some), TOGETHER):
                stems.young.update(zip(some[i : i + TOGETHER], code(some[i : i + TOGETHER]), strict=True))
        return map(add, map(stems.young.__getitem__, split), tails)

    def ids(texts: list[bytes]) -> Iterator[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        at = 0
        while at < len(texts):
            begun, size = at, 0
            while at < len(texts) and (at == begun or size + len(texts[at]) <= STEP_BYTES):
                size += len(texts[at])
                at += 1
            split = pc.ascii_split_whitespace(pa.array(texts[begun:at], pa.string()))
            words = split.flatten().dictionary_encode()
            # all words as one string and cut again, which is faster than one by one
            together = pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary)
            distinct = pc.binary_join(together, "\n")[0].as_py().split("\n") if len(words.dictionary) else []
            # white space at an end of a text gives an empty word, which has no ids
            empty = distinct.index("") if "" in distinct else None
            code = list(coded([w for w in distinct if w]))
            if empty is not None:
                code.insert(empty, b"")
            code = pa.array(code, pa.large_binary())
            data = code.take(words.indices)
            cut = np.frombuffer(data.buffers()[1], np.int64)[split.offsets.to_numpy()].tolist()
            whole = memoryview(data.buffers()[2] or b"")
            for i, j in zip(cut, cut[1:]):
                yield whole[i:j].tobytes()

    return ids


def token_bytes(path: str | None):
    """The same for one text at a time."""
    encode = encoder(path)
    return lambda text: next(encode([text]))


def joined(batches: Iterator, size: int = STEP_BYTES) -> Iterator:
    """Batches put together up to about ``size`` bytes, for more words are met again in a longer step."""
    import pyarrow as pa

    held, taken = [], 0
    for batch in batches:
        held.append(batch)
        taken += batch.nbytes
        if taken >= size:
            yield pa.concat_batches(held)
            held, taken = [], 0
    if held:
        yield pa.concat_batches(held)


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end: int = END,
    path: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): tokenised documents, cut where too long.

    Every row gives the ids of its text followed by ``end`` (a null or empty text: ``end``
    alone), in pieces of ``capacity`` ids, the last one shorter.  ``ids`` holds them as
    little-endian 32-bit numbers.
    """

    def work(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        encode = encoder(path)
        tail = np.array([end], "<u4").tobytes()
        for batch in joined(batches):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, data in enumerate(encode(byte_texts(batch.column(1)))):
                data += tail
                for p, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            arrays = [
                batch.column(0).take(pa.array(row, pa.int64())),
                pa.array(piece, pa.int32()),
                *[pa.array(x, pa.int64()) for x in (start, length, crc)],
            ]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)
        # the worker waits for its next task, maybe of another stage, without the memory of this one
        pa.default_memory_pool().release_unused()

    source = texts(docs, id_col, text_col)
    more = ", ids binary" if with_ids else ""
    return source.mapInArrow(
        work,
        f"id {type_of(source, 'id')}, piece int, start long, length long, ids_crc32 long{more}",
    )


def fullest(counts: list[int], room: int) -> list[int]:
    """Lengths with the greatest sum up to ``room``; ``counts[n]`` pieces of length n exist."""
    reach, seen, limit = 1, [], (1 << (room + 1)) - 1
    for n in range(room, 0, -1):
        for _ in range(min(counts[n], room // n)):
            more = (reach | reach << n) & limit
            if more == reach:
                break
            seen.append((n, reach))
            reach = more
        if reach >> room:
            break
    left, taken = reach.bit_length() - 1, []
    for n, before in reversed(seen):
        if not before >> left & 1:
            taken.append(n)
            left -= n
    return taken


def bins(lengths: list[int], capacity: int = CAPACITY) -> Iterator[list[int]]:
    """Lists of indexes into ``lengths``, one per bin, by minimum bin slack."""
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, n in enumerate(lengths):
        held[n].append(i)
    counts = [len(x) for x in held]
    # bit n, and bit capacity-n, are set while a piece of length n is left
    there = sum(1 << n for n in range(1, capacity + 1) if counts[n])
    back = sum(1 << capacity - n for n in range(1, capacity + 1) if counts[n])

    def take(n: int) -> int:
        nonlocal there, back
        counts[n] -= 1
        if not counts[n]:
            there ^= 1 << n
            back ^= 1 << capacity - n
        return held[n].pop()

    while there:
        first = there.bit_length() - 1
        chosen = [take(first)]
        room = capacity - first
        if room and there:
            if there >> room & 1:
                more = [room]
            else:
                # n with a partner room-n fills the bin; the longest such n
                pairs = there & (back >> capacity - room) & ((1 << room) - 1)
                if room % 2 == 0 and counts[room // 2] < 2:
                    pairs &= ~(1 << room // 2)
                n = pairs.bit_length() - 1
                more = [n, room - n] if n > 0 else fullest(counts, room)
            chosen += [take(n) for n in more]
        yield chosen


def pack(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The rows of a table with ``length`` (1 to ``capacity``), plus sequence_id and offset.

    Pieces are dealt evenly into groups of about ``group`` and each group is packed on its
    own; a group leaves about one bin unfilled, so a split costs almost nothing.  No
    group grows with the input.  Rows with a null length belong to no sequence (null ids).
    """
    columns = cut.columns
    wanted = max(1, -(-cut.count() // group))

    def work(tables: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        batches = [b for b in tables if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        lengths = table.column("length").to_pylist()
        real = [i for i, n in enumerate(lengths) if n is not None]
        sequence = [None] * len(lengths)
        offset = [None] * len(lengths)
        base = TaskContext.get().partitionId() << 32
        for b, chosen in enumerate(bins([lengths[i] for i in real], capacity)):
            at = 0
            for c in chosen:
                i = real[c]
                sequence[i], offset[i] = base + b, at
                at += lengths[i]
        table = table.append_column("sequence_id", pa.array(sequence, pa.int64()))
        yield from table.append_column("offset", pa.array(offset, pa.int64())).to_batches()

    kinds = ", ".join(f"`{c}` {type_of(cut, c)}" for c in columns)
    return cut.repartition(wanted).mapInArrow(work, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where every piece of every document lies; repeated rows are packed as often as they occur."""
    return pack(materialized(pieces(docs, id_col, text_col), "pieces"))


def sequences(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from pieces with ``ids``.

    ``ids`` are joined in order of ``offset``; a sequence has ``capacity`` ids at most.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return (
        cut.filter(F.col("sequence_id").isNotNull())
        .groupBy("sequence_id")
        .agg(parts.alias("parts"))
        .select("sequence_id", F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "").alias("h"))
        .select("sequence_id", F.unhex("h").alias("ids"))
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op10_packing": op10_packing}
SQL: dict[str, str] = {}
