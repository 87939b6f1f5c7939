"""Removal of repeated passages against a count of all windows."""

import hashlib
import random
from collections import Counter

import pytest

from waybridge.llm import repeats


def _kept(texts, width=35):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - width + 1) if count[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out.append(b" ".join(x for j, x in enumerate(w) if j not in gone).decode())
    return out


def _found(spark, texts, **more):
    df = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, kind string, k1 int, lo int")
    got = repeats.drop_repeats(df.repartition(3), **more).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len((texts[r["id"]] or "").encode().split())
        assert r["n_words"] == n and r["n_removed"] == n - (len(r["kept"].split()) if more.get("form") != "sha256" else r["n_words"] - r["n_removed"])
    return [r["kept"] for r in sorted(got, key=lambda r: r["id"])]


def _passages(seed, vocabulary, docs=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdeé", k=6)) for _ in range(vocabulary)]
    base = [rnd.choices(words, k=200) for _ in range(4)]
    texts = []
    for _ in range(docs):
        parts = []
        for _ in range(rnd.randrange(5)):
            a = rnd.randrange(180)
            parts += rnd.choice(base)[a : a + rnd.choice([20, 34, 35, 36, 60, 120])]
            parts += rnd.choices(words, k=rnd.choice([0, 1, 10, 80]))
        texts.append(rnd.choice([" ", "\n", " \t "]).join(parts))
    return texts


@pytest.mark.parametrize(("seed", "vocabulary"), [(1, 400), (2, 6), (3, 2)])
def test_equal_to_a_count_of_all_windows(spark, seed, vocabulary):
    texts = _passages(seed, vocabulary)
    assert _found(spark, texts) == _kept(texts)


def test_odd_texts(spark):
    rnd = random.Random(4)
    unlike = " ".join(str(rnd.random()) for _ in range(120))
    texts = [
        None, "", " \n ", "few words", unlike, unlike, "lang " * 30_000, "a b " * 900, "a b " * 20, "é \x1f " * 36,
        " ".join(map(str, range(34))), " ".join(map(str, range(35))), "x " + " ".join(map(str, range(35))), "Case " * 34, "case " * 35,
    ]
    assert _found(spark, texts) == _kept(texts)
    assert _found(spark, texts, width=3) == _kept(texts, 3)
    hashed = _found(spark, texts, form="sha256")
    assert hashed == [hashlib.sha256(t.encode()).hexdigest() for t in _kept(texts)]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.drop_repeats(none).count() == 0


def test_pieces_of_long_texts_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 50)
    monkeypatch.setattr(repeats, "TOGETHER", 300)
    finder = repeats.Finder(35)
    texts = _passages(7, 300)
    known = {(i, i): (t.encode(), 1) for i, t in enumerate(texts)}
    rows = [r for columns in finder.rows(known) for r in zip(*(c.tolist() for c in columns), strict=True)]
    # every window stands in one region, or in a range of regions that repeat in their batch
    windows = sorted((r[1], r[2] + j) for r in rows if r[0] == repeats.COVERED or (r[0] == repeats.REGION and r[7] == 1) for j in range(r[3]))
    long = [len(t.split()) for t in texts if len(t.split()) >= 35]
    assert windows == [(i, p) for i, n in enumerate(long) for p in range(n - 34)]
    assert sorted(r[8] for r in rows if r[0] == repeats.TEXT) == [i for i, t in enumerate(texts) if len(t.split()) >= 35]


def test_rows_alike_and_null_ids_stay(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, "one " + text)], "doc_id long, text string")
    got = sorted((r["id"] is None, r["id"] or 0, r["kept"]) for r in repeats.drop_repeats(df).collect())
    assert got == [(False, 1, ""), (False, 1, ""), (False, 2, "one"), (True, 0, "")]


def test_windows_that_are_equal_have_equal_anchors():
    import numpy as np

    rnd = random.Random(9)
    vocabulary = [rnd.getrandbits(64) for _ in range(30)]
    base = rnd.choices(vocabulary, k=300)
    docs = []
    for _ in range(30):
        a = rnd.randrange(220)
        docs.append(rnd.choices(vocabulary, k=rnd.randrange(30)) + base[a : a + 70] + rnd.choices(vocabulary, k=rnd.randrange(30)))
    hashes = np.array([h for d in docs for h in d], np.uint64)
    first = np.zeros(len(hashes), bool)
    starts = np.cumsum([0, *map(len, docs)])[:-1]
    first[starts] = True
    windows = np.array([s + i for s, d in zip(starts, docs, strict=True) for i in range(len(d) - 34)])
    low, high, symbol = repeats.anchors(hashes, first, windows)
    seen = {}
    for w, *anchor, c in zip(windows.tolist(), (low - windows).tolist(), (high - windows).tolist(), symbol.tolist(), strict=True):
        assert 0 <= anchor[0] < anchor[1] <= 35
        assert seen.setdefault(hashes[w : w + 35].tobytes(), (anchor, c >> 32)) == (anchor, c >> 32)
    assert len(seen) < len(windows)


def test_windows_travel_with_96_bits():
    asked = repeats.Asked(3)
    asked.add(0, [b"a", b"b", b"c", b"a", b"b", b"c"], 0, 4, 1)
    _, lo, h1, h2, _, repeated, speaks = asked.taken()
    assert (h1.dtype, h2.dtype) == ("int64", "int32")
    assert lo[repeated].tolist() == [0, 3] and lo[speaks].tolist() == [0, 1, 2]


def test_names_alike_in_the_bits_that_are_counted_first(spark):
    rows = [(repeats.REGION, n, 0, 1, name, n, n, 1, 0, 0) for n, name in enumerate([5, 5 + 2**40, 9, 9])]
    got = repeats.compared(spark.createDataFrame(rows, repeats.FOUND)).collect()
    # the two regions named 9 differ and are compared; the others only look alike and are not
    assert sorted(r["text_no"] for r in got) == [2, 3]
