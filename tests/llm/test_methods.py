"""Operators against brute force, round trips and held-out accuracy on the small tables."""

import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from waybridge.llm import classlm, decontaminate, graph, htmltext, language, license, packing, quality, queries, simhash

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def _rows(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_masks_see_every_pair_within_the_radius():
    rnd = random.Random(1)
    for radius in (1, 2, 4):
        masks = [m & (2**64 - 1) for m in simhash.masks(radius)]
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(2000):
            bits = sum(1 << b for b in rnd.sample(range(64), radius))
            assert any(m & bits == 0 for m in masks)


def test_simhash_equals_brute_force(spark, docs):
    prints = {}
    for k, r in docs.items():
        words = (r["text"] or "").translate(LOWER).encode().split()
        runs = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in runs]
        prints[k] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    root = {k: k for k in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in _rows(spark, "op4_simhash")}
    assert got == {k: (f"{prints[k]:016x}", find(k)) for k in docs}


def test_large_buckets_are_cut_without_loss(spark):
    values = [random.Random(3).getrandbits(5) for _ in range(40)] + [1 << 40, 3 << 40]
    df = spark.createDataFrame([(v,) for v in set(values)], "fp long")
    whole = graph.components(simhash.covering_links(df, 2)).collect()
    cut = graph.components(simhash.covering_links(df, 2, block=4)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, cut))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_near_copies_are_caught_and_others_stay(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(400)]
    texts = {}
    for i in range(30):
        base = rnd.choices(words, k=300)
        texts[i] = " ".join(base)
        near = list(base)
        for at in rnd.sample(range(300), 3):
            near[at] = "changed"
        texts[100 + i] = " ".join(near)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()}
    assert {i for i in range(30)} <= kept and len(kept) <= 32
    small = simhash.near_duplicates(df, cell_words=500).select("id", "group").collect()
    assert sorted(map(tuple, small)) == sorted(
        map(tuple, simhash.near_duplicates(df).select("id", "group").collect())
    )


def test_licenses_equal_brute_force(spark, docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in _rows(spark, "op1_license_scan"):
        words = word.findall((docs[r["doc_id"]]["text"] or "").translate(LOWER))
        at, labels = [], set()
        for phrase, label in license.BASE:
            p = phrase.split()
            hits = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
            at += hits
            labels |= {label} if hits else set()
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (
            len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_long_template_with_changed_words(spark):
    text = "x " * 9 + "Permission is hereby kindly granted, free of charge, to any person obtaining a copy of this software today"
    df = spark.createDataFrame([(1, text), (2, "permission to any person")], "doc_id long, text string")
    got = {r["id"]: r["labels"] for r in license.license_scan(df).collect()}
    assert got == {1: "mit", 2: ""}


def test_language_model(spark, docs):
    counts = Counter()
    for k, r in docs.items():
        if zlib.crc32(str(k).encode()) % 5 != 1:
            counts.update([*classlm.tokens(r["text"].encode()), b""])
    n, v = sum(counts.values()), len(counts)
    base = score = 0.0
    for r in _rows(spark, "op2_class_lm"):
        line = [*classlm.tokens(docs[r["doc_id"]]["text"].encode()), b""]
        want = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in line)
        assert r["base_score"] == pytest.approx(want, rel=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(line), sum(w in counts for w in line), n)
        if r["held_out"]:
            base, score = base + r["base_score"], score + r["score"]
    assert score > base


def test_main_text_is_the_article(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in _rows(spark, "op3_main_text"):
        inside = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        parts = (re.sub(r"<[^>]*>", "", b.replace("<br>", " ")) for b in re.split(r"</?(?:p|h1)>", inside))
        want = "\n\n".join(" ".join(html.unescape(p).split()) for p in parts if html.unescape(p).strip())
        assert r["text"] == want and r["n_chars"] == len(want)


def test_parts_of_a_page_that_are_no_article():
    page = (
        "<html><body><header><p>Site name</p></header><div class='sidebar'><p>Other things to read</p></div>"
        "<article><h2>Head</h2><p>First <a href=x>linked</a> words of it.</p><aside>See also this</aside>"
        "<div class='ad-slot'>Buy now</div><form>Your mail</form><p>Last words of it.</p>"
        "<section id='comments'><p>I was here first</p></section></article><footer>Imprint</footer></body></html>"
    )
    tags = {"<html>": -3, "<body>": -3, "<header>": -3, "<div>": -1, "<article>": -0.1, "<p>": -0.1}
    assert htmltext.main_text(page, {"w": 2.0, "l": 1.0, "n": -1.0} | tags) == (
        "Head\n\nFirst linked words of it.\n\nLast words of it."
    )


def test_held_out_quality_and_language(spark, docs):
    sf = "/root/testdata/sf0.01"
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in quality.op6_quality(spark, sf).collect() if r["held_out"] and r["doc_id"] in known]
    assert np.mean([r["predicted"] == known[r["doc_id"]] for r in held]) >= 0.9
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in language.op9_language(spark, sf).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) >= 0.97


def test_changed_slots_are_found_and_mixed_ones_are_not(spark):
    item = "On Monday the farmer Olga sold 12 crates of apples and Olga kept 7 crates for the long winter at home."
    same = "Before. On Monday the farmer Petra sold 30 crates of apples and Petra kept 5 crates for the long winter at home. After."
    mixed = same.replace("and Petra", "and Heidi")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame([(1, same), (2, mixed), (3, "x " + item), (4, "Nothing of it here at all, but for a while")], "doc_id long, text string")
    got = {r["id"]: r["changed"] for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {1: True, 3: False}
    big = decontaminate.contaminated(df, bench, copied_rows=0).collect()
    assert {r["id"]: r["changed"] for r in big} == got


def test_packing_round_trip(spark, docs):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path(packing.VOCABULARY))
    ids = {k: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1] for k, r in docs.items()}
    rows = _rows(spark, "op10_packing")
    seen, places = Counter(), {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] <= 4096 and r["start"] == 4096 * r["piece"]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        seen[r["doc_id"]] += r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert seen == {k: len(v) for k, v in ids.items()}
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= math.ceil(sum(seen.values()) / 4096) + 1
    cut = packing.pack(packing.pieces(spark.read.parquet(f"{SF}/documents.parquet"), with_ids=True))
    for r in packing.sequences(cut).collect():
        assert 0 < len(r["ids"]) <= 4 * 4096


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=14), st.integers(1, 60))
def test_fullest_combination(lengths, room):
    counts = [lengths.count(n) for n in range(101)]
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums if s + n <= room}
    taken = packing.fullest(counts, room)
    assert sum(taken) == max(sums) and not Counter(taken) - Counter(lengths)


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=40))
def test_words_encode_as_the_whole_text_does(text):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    if not hasattr(test_words_encode_as_the_whole_text_does, "pair"):
        file = path(packing.VOCABULARY)
        test_words_encode_as_the_whole_text_does.pair = Tokenizer.from_file(file), packing.token_bytes(file)
    tokenizer, encode = test_words_encode_as_the_whole_text_does.pair
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert encode(text.encode()) == np.array(want, "<u4").tobytes()


def test_encoding_of_cased_and_combining_characters_equals_the_tokenizer():
    import random

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from waybridge.llm import packing

    rnd = random.Random(3)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    encode = packing.encoder(None)
    pool = [*"abcXYZ.,'!?019-éÉßİıΣσςÅåñ́̇̀ǅﬁ漢字ा　½²ªºⅧ_", "'s", "'LL", " ", "\n", "\t", "  "]
    texts = ["".join(rnd.choices(pool, k=rnd.randrange(1, 9))) for _ in range(50_000)] + ["İ.", "İ,\n", "Word.", "á."]
    for i in range(0, len(texts), 2_000):
        some = texts[i : i + 2_000]
        for text, got in zip(some, encode([t.encode() for t in some]), strict=True):
            want = tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(got, "<u4").tolist() == want, repr(text)
