import random

import numpy as np

from tidemark.llm.pieces import Pieces, cut_at_spaces


def test_pieces_join_to_the_text():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(" \n\tab.é \x1c") for _ in range(rng.randrange(40)))
        parts = cut_at_spaces(text)
        assert "".join(parts) == text
        assert all(p[0] == " " and len(p) > 1 and not p[1].isspace() for p in parts[1:])


def test_a_small_store_gives_the_same_rows():
    rng = random.Random(2)
    encode = lambda ps: (np.array([ord(c) for p in ps for c in p], np.uint32), np.array([len(p) for p in ps], np.int64))
    store = Pieces(encode, most=20)
    for _ in range(60):
        texts = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.randrange(9))) for _ in range(5)]
        flat, counts = store.rows(texts)
        assert flat.tolist() == [ord(c) for t in texts for c in t] and counts.tolist() == [len(t) for t in texts]
        assert len(store.code) == len(store.lens) == len(store.starts)


def test_repeated_words_are_one_string_and_cuts_stay():
    rng = random.Random(3)
    texts = ["".join(rng.choice("  \n\tab.é \x1c") for _ in range(rng.randrange(40))) for _ in range(300)] + ["", " ", "a", "a  b", " a b"]
    place, strings, per = Pieces(None).pieces(texts)
    found, low = [strings[k] for k in place.tolist()], 0
    for text, n in zip(texts, per.tolist(), strict=True):
        assert [p for p in found[low : low + n] if p] == cut_at_spaces(text)
        low += n
    _, strings, per = Pieces(None).pieces(["one two three " * 1000] * 5)
    assert len(strings) < 20 and per.tolist() == [3000] * 5
