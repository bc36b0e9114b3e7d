import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from tidemark.llm import bilinear_lm, dictionary, word_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(params=["docs", "odd", "none"])
def rows(request, monkeypatch):
    if request.param == "docs":  # several chunks and groups in each task
        monkeypatch.setattr(dictionary, "CHUNK_BYTES", 30_000)
        monkeypatch.setattr(dictionary, "GROUP_BYTES", 5_000)
    return request.getfixturevalue(request.param)


def tool():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library(rows):
    exact = tool()
    want = []
    for r in rows.collect():
        ids = exact.encode_ordinary(r.text or "")
        want.append((2**63 - 1 if r.doc_id is None else r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = [tuple(r) for r in word_bpe.token_digests(rows, PATH, P.PATTERN).collect()]
    assert sorted(got) == sorted(want)


def test_round_trip(rows):
    ids = word_bpe.encode(rows, PATH, P.PATTERN)
    got = Counter((r["_id"], bytes(r["bytes"])) for r in word_bpe.decode(ids, PATH).collect())
    assert got == Counter((2**63 - 1 if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in rows.collect())


def test_base_scores_match_brute_force(rows):
    all_rows = rows.collect()
    split = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(w for r in all_rows if not held(r.doc_id) for w in split(r.text))
    n, v = sum(c.values()), len(c)
    want = sorted((2**63 - 1 if r.doc_id is None else r.doc_id, held(r.doc_id), len(split(r.text)), sum(c[w] > 0 for w in split(r.text)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in split(r.text)), 5)) for r in all_rows)
    out, total = bilinear_lm.scores(rows)
    got = out.collect()
    assert total == n
    assert sorted((r._id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert all(math.isfinite(r.score) for r in got)


@pytest.mark.parametrize(("table", "gain"), [("sf0.01", 0.3), ("sf0.1", 0.5)])
def test_model_beats_the_base_on_held_out_texts(spark, table, gain):
    """By `gain` log10 a token at least. On sf0.1 an interpolated bigram of all words gains 0.59."""
    rows = bilinear_lm.op3_log_bilinear_lm(spark, f"/root/testdata/{table}").where("held_out").collect()
    assert rows and sum(r.score for r in rows) > sum(r.base_score + gain * r.n_tokens for r in rows)


def test_probabilities_are_normalised_and_learn_a_pattern():
    text = np.tile([0, 1, 2, 3, 4], 400)
    starts = np.array([0, 1000])
    contexts = bilinear_lm.contexts_of(text, starts, 5)
    assert contexts[:, 0].tolist() == [5, 5, 5, 5] and contexts[:, 2].tolist() == [1, 0, 5, 5] and contexts[:, 1000].tolist() == [5, 5, 5, 5]
    model = bilinear_lm.LogBilinear(np.bincount(text, minlength=5).astype(float))
    rng = np.random.default_rng(1)
    for _ in range(60):
        model.step(text, contexts, rng)
    own = contexts[:, 100:110]
    all_cells = np.stack([model.logs(np.full(10, c), own) for c in range(5)])
    assert np.allclose(np.exp(all_cells).sum(0), 1, atol=1e-5)
    assert np.exp(model.logs(text[100:110], own)).min() > 0.8


def test_vocabulary_follows_the_corpus(spark, docs):
    table = dictionary.chunked(bilinear_lm.texts(docs), bilinear_lm.new_coder, lambda ids: ~bilinear_lm.held_out(ids))
    n, v, top, tokens, kinds = bilinear_lm.corpus_counts(table)
    c = Counter(w for r in docs.collect() if not bilinear_lm.held_out([r.doc_id])[0] for w in bilinear_lm.words_of(r.text or ""))
    assert (n, v) == (sum(c.values()), len(c)) and 0 < len(top) <= int(bilinear_lm.VECTORS * n**0.5)
    assert top == sorted(((w, k) for w, k in c.items() if k >= bilinear_lm.LEAST_COUNT), key=lambda x: (-x[1], x[0]))[: len(top)]
    assert tokens.sum() == n - sum(k for _, k in top) and kinds.sum() == v - len(top)


def test_scores_do_not_follow_cores_or_partitions(spark, docs, monkeypatch):
    """Several shards, averaged: the same from one partition and from seven, in chunks of other sizes."""
    monkeypatch.setattr(bilinear_lm, "SHARD_TOKENS", 1 << 13)
    monkeypatch.setattr(bilinear_lm, "SHARD_ROWS", 1)
    found = []
    for parts, size in ((1, 1 << 24), (7, 20_000)):
        monkeypatch.setattr(dictionary, "CHUNK_BYTES", size)
        found.append({r._id: (r.score, r.base_score) for r in bilinear_lm.scores(docs.repartition(parts))[0].collect()})
    assert found[0].keys() == found[1].keys() and all(found[0][i] == pytest.approx(found[1][i], rel=1e-6) for i in found[0])


def test_scores_follow_from_the_parameters(spark, docs, monkeypatch):
    """Every token's probability by plain loops over all alternatives, in doubles; repeated rows, null ids and texts of one word among them."""
    kept = []
    monkeypatch.setattr(bilinear_lm, "trained", lambda *a, own=bilinear_lm.trained: kept.append(own(*a)) or kept[-1])
    rows = docs.limit(40).select("doc_id", "text").union(spark.createDataFrame([(1, "twice"), (1, "twice"), (None, "no id"), (None, None)], "doc_id long, text string"))
    every = [(2**63 - 1 if r.doc_id is None else r.doc_id, bilinear_lm.words_of(r.text or "")) for r in rows.collect()]
    got = bilinear_lm.scores(spark.createDataFrame([(None if i == 2**63 - 1 else i, " ".join(w.decode() for w in own[:-1])) for i, own in every], "doc_id long, text string"))[0].collect()
    model, = kept
    held = lambda i: bool(bilinear_lm.held_out([i])[0])
    c = Counter(w for i, own in every if not held(i) for w in own)
    vectors = int(bilinear_lm.VECTORS * sum(c.values()) ** 0.5)
    top = sorted(((w, k) for w, k in c.items() if k >= bilinear_lm.LEAST_COUNT), key=lambda x: (-x[1], x[0]))[:vectors]
    number = {w: k for k, (w, _) in enumerate(top)}
    cell = lambda w: number.get(w, len(top) + zlib.crc32(w[-3:]) % bilinear_lm.ENDINGS)
    mass = Counter({len(top) + e: 1 for e in range(bilinear_lm.ENDINGS)})
    for w, k in c.items():
        if w not in number:
            mass[cell(w)] += k + 1
    seen, targets, groups, turn = (p.astype(np.float64) for p in model.parts(model.table))
    d, want = model.d, []
    for i, own in every:
        cells, total = [cell(w) for w in own], 0.0
        for t, w in enumerate(own):
            r = np.append(sum(seen[cells[t - k - 1] if t > k else model.n, :d] @ turn[k, :, :d] for k in range(model.order)), 1.0)
            g = model.group[cells[t]]
            inside = targets[model.edges[g] : model.edges[g + 1]] @ r
            total += (groups @ r)[g] - np.log(np.exp(groups @ r).sum()) + inside[model.inner[cells[t]]] - np.log(np.exp(inside).sum())
            total += 0.0 if w in number else math.log((c[w] + 1) / mass[cells[t]])
        want.append((i, total / math.log(10)))
    got, want = sorted((r._id, r.score) for r in got), sorted(want)
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([x for _, x in got], [x for _, x in want], rtol=1e-4, atol=1e-3)


def test_token_table(spark):
    assert word_bpe.token_table(spark, PATH).count() == 50_256


def test_sums_of_stretches_equal_plain_sums():
    """Stretches of one row, a few and many, in the order of the rows or another."""
    rng = np.random.default_rng(3)
    lens = np.array([1, 1, 2, 40, 1, 5, 6, 7, 300, 1, 3])
    first, own = np.cumsum(lens) - lens, np.repeat(np.arange(len(lens)), lens)
    rows = rng.normal(size=(len(own), 5)).astype(np.float32)
    for by in (None, rng.permutation(len(own))):
        want = np.zeros((len(lens), 5))
        np.add.at(want, own, rows if by is None else rows[by])
        assert np.allclose(bilinear_lm.segment_sums(rows, by, first), want, atol=1e-4)


def test_a_step_draws_noise_from_each_group_that_occurs():
    """Each group's noise is drawn from its own targets, and targets of groups without tokens in the batch stay as they are."""
    model = bilinear_lm.LogBilinear(np.arange(1, 401).astype(float))
    assert (model.row[np.argsort(model.row)] == np.arange(400)).all() and model.groups > 3
    for g in range(model.groups):
        low, high = model.reach_targets[model.edges[g]], model.reach_targets[model.edges[g + 1] - 1]
        assert g < low <= high <= g + 1 and high > g + 1 - 1e-9
    here = model.group < 2
    cells = np.resize(np.flatnonzero(here), 600)
    before = model.parts(model.table)[1].copy()
    model.step(cells, bilinear_lm.contexts_of(cells, np.array([0]), model.n), np.random.default_rng(2))
    changed = (model.parts(model.table)[1] != before).any(1)
    assert changed[model.row[here]].all() and not changed[model.row[~here]].any()
