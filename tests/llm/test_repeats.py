import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from tidemark.llm import suffix_dedup as sd


def place(i, t):
    """Where a row stands: by id, then by the upper half of a hash of id and text, then by text."""
    i, t = 2**63 - 1 if i is None else i, (t or "").encode()
    return i, xxhash.xxh64_intdigest(t, xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42)) >> 32, t


def brute(rows, length):
    """By a dictionary of all strings: in the order of rows, then of starts."""
    docs = sorted({place(i, t) for i, t in rows})
    seen, out = set(), {}
    for i, _, t in docs:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            if s in seen:
                gone[p : p + length] = True
            seen.add(s)
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out[i, t] = (len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return Counter(((2**63 - 1 if i is None else i), *out[2**63 - 1 if i is None else i, (t or "").encode()]) for i, t in rows)


def result(df):
    return Counter((r._id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def planted(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randrange(3, 60)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(0, 25)), rng.choice(passages), text(rng.randrange(0, 9)), rng.choice(passages), "ab" * rng.randrange(0, 90)]
        rows.append((rng.randrange(50), " ".join(parts) if rng.random() > 0.1 else rows[-1][1] if rows else ""))
    return [*rows, rows[3], (None, rows[5][1])]


@pytest.mark.parametrize("seed,length,gram,hot", [(1, 100, 24, 512), (2, 20, 7, 512), (3, 20, 7, 3), (4, 100, 24, 2), (5, 12, 12, 512)])
def test_planted_repeats(spark, seed, length, gram, hot, monkeypatch):
    for name, value in (("CHUNK_BYTES", 3000), ("GROUP", 700), ("SEGMENT", 150), ("BATCH", 64), ("FAMILY", 300), ("HOT", hot)):
        monkeypatch.setattr(sd, name, value)
    rows = planted(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(sd.remove_repeats(docs, length, gram)) == brute(rows, length)


@pytest.mark.parametrize("name", ["docs", "odd", "none"])
def test_tables(request, name):
    docs = request.getfixturevalue(name)
    got = sd.remove_repeats(docs, keep_text=True)
    assert result(got) == brute([(r.doc_id, r.text) for r in docs.collect()], 100)
    for r in got.collect():
        assert len(r.kept.encode()) <= r.n_bytes - r.n_removed and (r.n_removed or hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256)
    sent = sd.remove_repeats(docs, along=docs["text"]).collect()
    assert all(r.n_bytes == len(r.along.encode()) and r.kept is None for r in sent)


def test_rows_without_an_id_are_many(spark, monkeypatch):
    """They are dealt to all chunks and keep one order, however many chunks there are."""
    monkeypatch.setattr(sd, "CHUNK_BYTES", 2000)
    rng = random.Random(9)
    shared = ["".join(rng.choice("abcdefgh ") for _ in range(130)) for _ in range(4)]
    rows = [(None if k % 3 else 7, shared[k % 4] + "".join(rng.choice("xyz ") for _ in range(60)) + shared[(k + 1) % 4]) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table, chunks = sd.chunk_table(sd.texts(docs.withColumn("along", docs["text"]), "along"))
    assert chunks > 8 and table.count() > chunks // 2
    assert result(sd.remove_repeats(docs)) == brute(rows, 100)


def test_levels_grow_geometrically():
    rng = np.random.default_rng(1)
    ids = np.arange(4000)
    levels = sd.Levels(ids, np.zeros(4000, np.int64), np.zeros(4000, np.int64))
    keys = rng.integers(97, 100, (4000, 8), dtype=np.uint8).view("S8").ravel()
    for low in range(0, 4000, 100):
        levels.add(keys[low : low + 100], ids[low : low + 100])
        sizes = [len(k) for k, _ in levels.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
        assert all((k[1:] > k[:-1]).all() for k, _ in levels.levels)
    first = {k: i for i, k in reversed(list(enumerate(keys.tolist())))}
    assert levels.late.tolist() == [first[k] != i for i, k in enumerate(keys.tolist())]


def test_words_are_numbered_by_falling_frequency():
    from tidemark.llm.automaton_dedup import numbered

    rng = random.Random(8)
    for group in (["", " \n", "a"], [""], ["".join(rng.choice(" \t\n\x0b\x0c\r\x1c\x85aé\x00b") for _ in range(rng.randrange(12))) for _ in range(500)]):
        words, numbers, counts = numbered(group)
        found = [t.encode().split() for t in group]
        assert [words[i] for i in numbers.tolist()] == [w for f in found for w in f] and counts.tolist() == [len(f) for f in found]
        assert len(set(words)) == len(words) and (np.diff(np.bincount(numbers, minlength=len(words))) <= 0).all()
