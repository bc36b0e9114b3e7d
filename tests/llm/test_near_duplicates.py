import hashlib
import random
import re

import pytest

from tidemark.llm import components as cc
from tidemark.llm import minhash


def sets_of(rows, words):
    out = []
    for r in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode().lower())
        n = min(words, len(w))
        out.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    return out


def brute(rows, words, percent):
    """Components of all pairs that reach the threshold: per row (doc_id, shingles, smallest id, whether it is the first by id and digest)."""
    sets, up = sets_of(rows, words), list(range(len(rows)))
    key = [(2**63 - 1 if r.doc_id is None else r.doc_id, hashlib.sha256((r.text or "").encode()).digest()) for r in rows]

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            p, q = sets[i], sets[j]
            if not p or not q or min(len(p), len(q)) * 100 < percent * max(len(p), len(q)):
                continue
            if 100 * len(p & q) >= percent * len(p | q):
                x, y = top(i), top(j)
                up[x] = y
    least = {}
    for i in range(len(rows)):
        least[top(i)] = min(least.get(top(i), key[i]), key[i])
    return [(r.doc_id, len(s), None if least[top(i)][0] == 2**63 - 1 else least[top(i)][0], key[i] == least[top(i)]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("name,words", [("docs", 2), ("docs", 5), ("odd", 2), ("none", 2), ("family", 2), ("unnamed", 2)])
@pytest.mark.parametrize("block", [2048, 8])
def test_matches_all_pairs(request, spark, name, words, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "FAMILY", block // 4 + 2)
    monkeypatch.setattr(minhash, "PIVOTS", 2)
    if name == "unnamed":  # copies without an id, and different texts with one id
        rng = random.Random(6)
        base = [" ".join(f"v{rng.randrange(80)}" for _ in range(40)) for _ in range(5)]
        rows = [(rng.choice([None, None, 3, 40 + k]), base[k % 5] + " " + rng.choice(["", "end", "tail"])) for k in range(60)]
        docs = spark.createDataFrame([*rows, rows[0], (None, None), (3, "")], "doc_id long, text string")
    elif name == "family":  # chains of small edits: neighbours are near, the ends are not
        rng, rows = random.Random(5), []
        for f in range(4):
            text = [f"w{rng.randrange(300)}" for _ in range(60)]
            for k in range(25):
                text = list(text)
                text[rng.randrange(60)] = f"w{rng.randrange(300)}"
                rows.append((1000 * f + k * 7 % 25, " ".join(text)))
        rng.shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
    else:
        docs = request.getfixturevalue(name)
    got = [(r._id if r._id != 2**63 - 1 else None, r.n_shingles, r.component_id, r.first) for r in minhash.near_duplicates(docs, words).collect()]
    assert sorted(got, key=str) == sorted(brute(docs.select("doc_id", "text").collect(), words, 80), key=str)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50, 120)] + [(7, k) for k in range(200, 400)] + [(9, 9), (8, 300), (1000, 999)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 50 for i in range(50, 121)}, **{k: 7 for k in (7, 8, *range(200, 400))}, 999: 999, 1000: 999}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_estimate_is_near_the_truth():
    words = [str(k) for k in range(400)]
    a, b = " ".join(words), " ".join(words[:360] + [f"x{k}" for k in range(40)])
    p, q = minhash.shingles(a, 2), minhash.shingles(b, 2)
    truth = len(set(p.tolist()) & set(q.tolist())) / len(set(p.tolist()) | set(q.tolist()))
    one, two = minhash.packed(minhash.minima(p)), minhash.packed(minhash.minima(q))
    assert abs(minhash.similarity(one, two[None])[0] - truth) < 0.15
    assert minhash.similarity(one, one[None])[0] == 1
