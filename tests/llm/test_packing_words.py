import random

from waybridge.llm.packing import Recent, VOCABULARY, encoder


def test_distinct_words_are_asked_for_as_they_come():
    known = Recent(2)
    assert known.missing(["b", "a"]) == ["b", "a"]
    known.young.update(a=1, b=2, c=3)
    # the older generation answers, too, and what it answers is young again
    assert known.missing(["d", "a"]) == ["d"] and known.young == {"a": 1}


def test_ids_of_a_step_are_those_of_each_text_by_itself():
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    random.seed(7)
    some = "abZÉßΣσ.,!' \t\n\x0b\x0c\r\x1c\x85 i̇İ漢1\x00"
    texts = ["".join(random.choices(some, k=n % 30)) for n in range(600)] + ["", "  ", " a ", "Word, word. WORD"]
    plain = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    got = [np.frombuffer(b, "<u4").tolist() for b in encoder(None)([t.encode() for t in texts])]
    assert got == want


def test_a_worker_remembers_words_without_their_marks():
    import sys

    import public_tokenizers

    encode = encoder(None)
    list(encode([b"Wordling wordling. WORDLING, wordling"]))
    kept = vars(sys.modules["_encoded_words"])
    vocabulary = kept[public_tokenizers.path(VOCABULARY)]
    met = [w for table in vars(vocabulary).values() if isinstance(table, Recent) for w in table.young if b"wordling" in (w.encode() if isinstance(w, str) else w).lower()]
    assert met == ["wordling"]
