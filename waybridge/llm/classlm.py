"""Brown class-based bigram model: exchange clustering, then class transitions and emissions.

P(text) is the product over its tokens of P(class | previous class) * P(word | class).  What is
counted (words, neighbouring units) is counted over all training texts in Spark.  Only
tables of a fixed bound reach the driver: words and units above a share of all tokens, and
matrices of classes by classes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybridge.llm.common import LOWER, byte_texts, in_fold, read, texts, type_of
from waybridge.session import materialized

CLASSES = 32
#: words with at least this share of all tokens are looked up in every task (500,000 at most)
WORD_SHARE = 2e-6
#: words with at least this share are clustered one by one (33,334 at most) ...
UNIT_SHARE = 3e-5
#: ... and all others by their last three bytes, in so many units
ENDINGS = 1024
#: exchange steps; in each one every second unit may move
STEPS = 8
#: weight of the class's own frequency in a transition
BACKOFF = 0.05
#: the token that ends a text; no word is empty
END = b""


def tokens(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def word_counts(source: DataFrame) -> DataFrame:
    """(word, n) over all texts, one END per text; summed in each task before the shuffle."""

    def work(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        def rows(held: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())],
                ["word", "n"],
            )

        held: Counter = Counter()
        for batch in batches:
            for text in byte_texts(batch.column("text")):
                held.update(tokens(text))
            held[END] += batch.num_rows
            if len(held) > 200_000:
                yield rows(held)
                held = Counter()
        if held:
            yield rows(held)

    counts = source.select("text").mapInArrow(work, "word binary, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def _ending(word: bytes) -> int:
    import zlib

    return zlib.crc32(word[-3:]) % ENDINGS


def neighbours(source: DataFrame, own: dict[bytes, int]) -> DataFrame:
    """(u, around): per unit its neighbours as (side, v, n); side 1 follows, side 0 precedes.

    There are len(own) + ENDINGS units at most, and twice as many neighbours of each.
    """
    base = len(own)
    size = base + ENDINGS

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def rows(parts: list) -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(codes // size), pa.array(codes % size), pa.array(n, pa.int64())],
                ["u", "v", "n"],
            )

        end = own[END]
        parts, held = [], 0
        for batch in batches:
            for text in byte_texts(batch.column("text")):
                words = tokens(text)
                known = [own.get(w, -1) for w in words]
                units = [k if k >= 0 else base + _ending(w) for k, w in zip(known, words, strict=True)]
                line = np.array([end, *units, end], np.int64)
                parts.append(line[:-1] * size + line[1:])
                held += len(line)
            if held > 1_000_000:
                yield rows(parts)
                parts, held = [], 0
        if parts:
            yield rows(parts)

    pairs = source.select("text").mapInArrow(work, "u long, v long, n long")
    summed = pairs.groupBy("u", "v").agg(F.sum("n").alias("n"))
    both = summed.select(
        F.explode(
            F.array(
                F.struct(F.col("u").alias("u"), F.struct(F.lit(1).alias("side"), F.col("v").alias("v"), "n").alias("a")),
                F.struct(F.col("v").alias("u"), F.struct(F.lit(0).alias("side"), F.col("u").alias("v"), "n").alias("a")),
            )
        ).alias("r")
    )
    return both.groupBy("r.u").agg(F.collect_list("r.a").alias("around")).select("u", "around")


def _units(batches: Iterator) -> Iterator:
    """(unit, side, neighbour, number) arrays of every row of a ``neighbours`` table."""
    for batch in batches:
        units = batch.column("u").to_pylist()
        around = batch.column("around")
        for row, u in enumerate(units):
            values = around[row].values
            yield (u, *[values.field(f).to_numpy() for f in ("side", "v", "n")])


def best_class(left, right, self_n: int, mine: int, table):
    """The class that gains most for a unit, by the exact change of the model's likelihood.

    ``left`` and ``right`` count the unit's neighbours before and after it by class, itself
    left out; ``table`` counts class pairs with the unit in class ``mine``.
    """
    import numpy as np

    def f(x):
        return x * np.log(np.maximum(x, 1e-300))

    out = table.copy()
    out[mine, :] -= right
    out[:, mine] -= left
    out[mine, mine] -= self_n
    diagonal = np.diagonal(out)
    column = f(out + left[:, None]) - f(out)
    row = f(out + right[None, :]) - f(out)
    gain = column.sum(0) - np.diagonal(column) + row.sum(1) - np.diagonal(row)
    gain += f(diagonal + left + right + self_n) - f(diagonal)
    after, before = out.sum(1), out.sum(0)
    gain -= f(after + right.sum() + self_n) - f(after)
    gain -= f(before + left.sum() + self_n) - f(before)
    best = int(gain.argmax())
    return best if gain[best] > gain[mine] + 1e-9 else mine


def class_pairs(around: DataFrame, classes, k: int):
    """How often a unit of one class is followed by a unit of another, as a k by k table."""
    import numpy as np

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = np.zeros(k * k)
        for u, side, v, n in _units(batches):
            after = side == 1
            table += np.bincount(classes[u] * k + classes[v[after]], n[after], k * k)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int64()), pa.array(table[at].astype(np.int64))], ["at", "n"]
        )

    out = np.zeros(k * k)
    for r in around.mapInArrow(work, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(k, k)


def exchange(around: DataFrame, size: int, end: int, k: int = CLASSES, steps: int = STEPS):
    """(classes, table): a class for each of ``size`` units by exchange clustering.

    Starts from ranks of frequency dealt over the classes.  In each step every second unit
    moves to the class that raises the likelihood most, all judged against the same
    table; tasks work on units apart from each other.  END keeps class 0 for itself.
    """
    import numpy as np

    totals = around.select(
        "u", F.aggregate("around", F.lit(0).cast("long"), lambda s, a: s + a["n"]).alias("n")
    ).collect()
    order = sorted(totals, key=lambda r: (-r["n"], r["u"]))
    classes = np.ones(size, np.int64)
    for rank, r in enumerate(order):
        classes[r["u"]] = 1 + rank % (k - 1)
    classes[end] = 0
    for step in range(steps):
        table = class_pairs(around, classes, k)

        def work(batches: Iterator, step=step, table=table, classes=classes.copy()) -> Iterator:
            import pyarrow as pa

            units, moved = [], []
            for u, side, v, n in _units(batches):
                if u == end or u % 2 != step % 2:
                    continue
                other, after = v != u, side == 1
                left = np.bincount(classes[v[other & ~after]], n[other & ~after], k)
                right = np.bincount(classes[v[other & after]], n[other & after], k)
                mine = int(classes[u])
                found = best_class(left, right, int(n[~other & after].sum()), mine, table)
                if found not in (0, mine):
                    units.append(u)
                    moved.append(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(units, pa.int64()), pa.array(moved, pa.int64())], ["u", "c"]
            )

        for r in around.mapInArrow(work, "u long, c long").collect():
            classes[r["u"]] = r["c"]
    return classes, class_pairs(around, classes, k)


def class_model_scores(
    docs: DataFrame,
    train,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = CLASSES,
    steps: int = STEPS,
    word_share: float = WORD_SHARE,
    unit_share: float = UNIT_SHARE,
    backoff: float = BACKOFF,
) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for every whole text.

    ``train`` is a condition on ``id`` that names the rows to learn from.  ``base_score`` is
    the log10 probability under single words with half a count added; ``score`` under the
    class bigram model, with half a count added to each word within its class and transitions
    mixed with the classes' own frequencies.  Words outside the looked-up ones leave the
    scoring pass once per text and meet their counts in a join on the word, which no word
    dominates, for each has a small share of all tokens by definition.

    Null and empty texts are one END token.  Rows alike in id and text come out once.  With no
    training text every word is unknown and ``score`` equals ``base_score``.
    """
    import numpy as np

    source = texts(docs.withColumn("_th", F.xxhash64(text_col)), id_col, text_col, "_th")
    learn = source.filter(train)
    words = materialized(word_counts(learn), "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = total["n"], total["v"]
    known = words.filter(F.col("n") >= max(1.0, word_share * n_all)).collect()
    known.sort(key=lambda r: (-r["n"], bytes(r["word"])))
    core = {bytes(r["word"]): i for i, r in enumerate(known)}
    counts = np.array([r["n"] for r in known], float)
    own = {w: i for w, i in core.items() if counts[i] >= unit_share * n_all or w == END}
    own.setdefault(END, 0)
    own = {w: i for i, w in enumerate(own)}
    base, end = len(own), own[END]
    if n_all:
        around = materialized(neighbours(learn, own), "neighbours")
        classes, table = exchange(around, base + ENDINGS, end, k, steps)
    else:
        classes, table = np.zeros(base + ENDINGS, np.int64), np.zeros((k, k))

    def class_of(word: bytes) -> int:
        unit = own.get(word, -1)
        return int(classes[unit if unit >= 0 else base + _ending(word)])

    def sizes(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n, v = np.zeros(k, np.int64), np.zeros(k, np.int64)
        for batch in batches:
            at = [class_of(w) for w in batch.column("word").to_pylist()]
            np.add.at(n, at, batch.column("n").to_numpy())
            np.add.at(v, at, 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int64()), pa.array(n), pa.array(v)], ["c", "n", "v"])

    class_n, class_v = np.zeros(k), np.zeros(k)
    for r in words.mapInArrow(sizes, "c long, n long, v long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        class_n[r["c"]], class_v[r["c"]] = r["n"], r["v"]
    base_bottom = float(np.log10(n_all + 0.5 * (v_all + 1)))
    if n_all:
        share = (class_n + 0.5) / (class_n.sum() + 0.5 * k)
        seen = table.sum(1, keepdims=True)
        follow = np.where(seen > 0, (1 - backoff) * table / np.maximum(seen, 1) + backoff * share, share)
        step = np.log10(follow)
        bottom = np.log10(class_n + 0.5 * (class_v + 1))
    else:
        step, bottom = np.zeros((k, k)), np.full(k, base_bottom)
    top = np.log10(counts + 0.5)
    core_class = np.array([class_of(w) for w in core] or [0], np.int64)

    def score(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        serial = 0
        for batch in batches:
            row, word, times, n_tok, n_known, s_known, s_model = [], [], [], [], [], [], []
            for i, text in enumerate(byte_texts(batch.column("text"))):
                line = tokens(text)
                line.append(END)
                at = np.array([core.get(w, -1) for w in line], np.int64)
                rare_at = np.flatnonzero(at < 0).tolist()
                cls = core_class[at]
                for j in rare_at:
                    cls[j] = class_of(line[j])
                rare = Counter([line[j] for j in rare_at])
                before = np.concatenate([[classes[end]], cls[:-1]])
                # a word with a blank meets no count and spreads the rows of texts
                row.append(i)
                word.append(b" %d.%d" % (part, serial))
                serial += 1
                times.append(0)
                n_tok.append(len(line))
                n_known.append(len(line) - len(rare_at))
                s_known.append(float(top[at[at >= 0]].sum()))
                s_model.append(float((step[before, cls] - bottom[cls]).sum()))
                row += [i] * len(rare)
                word += rare.keys()
                times += rare.values()
                fill = [None] * len(rare)
                n_tok += fill
                n_known += fill
                s_known += fill
                s_model += fill
            where = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(where),
                    batch.column("_th").take(where),
                    pa.array(word, pa.binary()),
                    pa.array(times, pa.int32()),
                    pa.array(n_tok, pa.int64()),
                    pa.array(n_known, pa.int64()),
                    pa.array(s_known, pa.float64()),
                    pa.array(s_model, pa.float64()),
                ],
                ["id", "_th", "word", "times", "n_tok", "n_known", "s_known", "s_model"],
            )

    schema = (
        f"id {type_of(source, 'id')}, _th long, word binary, times int, n_tok long, n_known long, "
        "s_known double, s_model double"
    )
    parts = source.mapInArrow(score, schema)
    met = parts.join(words, "word", "left")
    count = F.coalesce("n", F.lit(0))
    copies = F.count("n_tok")
    rare_top = F.coalesce(F.sum(F.col("times") * F.log10(count + 0.5)), F.lit(0.0))
    per_text = met.groupBy("id", "_th").agg(
        F.max("n_tok").alias("n_tokens"),
        ((F.sum("n_known") + F.sum(F.when(count > 0, F.col("times")).otherwise(0))) / copies)
        .cast("long")
        .alias("n_known"),
        ((F.sum("s_known") + rare_top) / copies).alias("_top"),
        (F.sum("s_model") / copies).alias("_model"),
    )
    return per_text.select(
        "id",
        "n_tokens",
        "n_known",
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("_top") - F.col("n_tokens") * F.lit(base_bottom)).alias("base_score"),
        (F.col("_top") + F.col("_model")).alias("score"),
    )


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = class_model_scores(read(spark, sf_dir, "documents"), ~in_fold(F.col("id"), 5, 1))
    return found.select(
        F.col("id").alias("doc_id"),
        in_fold(F.col("id"), 5, 1).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )


QUERIES = {"op2_class_lm": op2_class_lm}
SQL: dict[str, str] = {}
