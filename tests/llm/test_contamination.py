import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import fmindex


def brute(words, items):
    hit, found = [False] * len(words), set()
    for item, text in items:
        own = fmindex.words_of(text)
        for k in range(max(1, len(own) - 12) if own else 0):
            w = own[k : k + 13]
            for p in range(len(words) - len(w) + 1):
                if words[p : p + len(w)] == w:
                    found |= {item} - {None}
                    hit[p : p + len(w)] = [True] * len(w)
    return hit, found


def test_random_shards_match_brute_force(monkeypatch):
    rng = random.Random(3)
    for trial in range(30):
        letters = "ab" if trial % 2 else "abcdefg"
        phrase = lambda n: " ".join(rng.choice(letters) for _ in range(n))
        items = [(k or None, phrase(rng.choice([0, 1, 3, 12, 13, 15, 20]))) for k in range(5)]
        texts = [phrase(rng.randrange(60)) + " " + rng.choice(items)[1] + " zz " + phrase(5) for _ in range(8)]
        docs = [fmindex.words_of(t) for t in texts]
        monkeypatch.setattr(fmindex, "SLICE", rng.choice([1, 7, 1 << 20]))
        sought = fmindex.Phrases([(i, b" ".join(fmindex.words_of(t))) for i, t in items])
        for words, (a, b, found) in zip(docs, fmindex.shard_hits(docs, sought), strict=True):
            hit, want = brute(words, items)
            got = np.zeros(len(words), bool)
            for s, e in zip(a, b, strict=True):
                got[s:e] = True
            assert got.tolist() == hit and found == sorted(want)


@pytest.mark.parametrize("name", ["docs", "odd", "none"])
@pytest.mark.parametrize("block", [4_000_000, 2_000])
def test_query_matches_brute_force(request, spark, sf, name, block, monkeypatch):
    monkeypatch.setattr(fmindex, "BLOCK_BYTES", block)
    monkeypatch.setattr(fmindex, "STRETCH", 5 if block < 10_000 else 20_000)
    docs = request.getfixturevalue(name)
    if name == "odd":
        bench = spark.createDataFrame([(1, "same text here"), (2, None), (3, ""), (None, "word"), (4, "word " * 20), (4, "漢字"), (5, "x" * 3000), (None, "word word lead")], "item_id long, text string")
    else:
        bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = sorted(((r._id, r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in fmindex.contamination(docs, bench).collect()), key=str)
    want = []
    for r in docs.collect():
        words = fmindex.words_of(r.text)
        hit, found = brute(words, items) if name != "docs" or r.doc_id % 4 == 0 else (None, None)
        want.append((2**63 - 1 if r.doc_id is None else r.doc_id, len(words), hit, found))
    for g, w in zip(got, sorted(want, key=str), strict=True):
        assert g[:2] == w[:2] and (w[2] is None or (g[2] == sum(w[2]) and g[3] == sorted(w[3])))


def test_digest_and_law(spark, sf):
    rows = fmindex.op5_fm_index_decontamination(spark, sf).collect()
    assert len(rows) == 200 and any(r.contaminated for r in rows)
    assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in rows)
    assert all(r.items_sha256 == hashlib.sha256(b"").hexdigest() for r in rows if not r.n_items)
