"""Lexical search, repeated stretches of words and alignment of tokenizers against plain rewrites of their contracts."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest

from tidemark.llm import alignment, automaton_dedup, lexical_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def best(rows, items, top=10):
    docs = [(i, Counter(TERM.findall(lower(t or "")))) for i, t in rows]
    n = sum(bool(c) for _, c in docs)
    total = sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in docs:
            s = 0
            for w in set(TERM.findall(lower(text or ""))):
                if c[w]:
                    m = 100 - 90 + 90 * sum(c.values()) * n // total
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 8 * m))
            if s > 0:
                scores.append((-s, 2**63 - 1 if i is None else i))
        out += [(item, k + 1, None if d == 2**63 - 1 else d, -s) for k, (s, d) in enumerate(sorted(scores)[:top])]
    return Counter(out)


def ranked(df):
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("name", ["docs", "odd", "none"])
def test_search_of_tables(request, spark, sf, name):
    docs = request.getfixturevalue(name)
    items = spark.read.parquet(f"{sf}/benchmark.parquet").limit(15).unionByName(spark.createDataFrame([(None, "same text A123 word here"), (3, None), (4, " -- "), (5, "漢字 と word"), (5, "emoji 😀 x")], "item_id long, text string"))
    got = ranked(lexical_search.search(docs, items.withColumn("score", items["item_id"])))
    assert got == best([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


@pytest.mark.parametrize("seed", range(4))
def test_search_prunes_nothing(spark, seed, monkeypatch):
    """Many shards and blocks, few words, many ties: the bounds leave the results whole."""
    for name, value in (("SHARD_BYTES", 300), ("BLOCK_POSTINGS", 20), ("QUERY_BYTES", 150)):
        monkeypatch.setattr(lexical_search, name, value)
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(30)]
    text = lambda n: " ".join(words[min(29, int(rng.expovariate(0.2)))] for _ in range(n))
    rows = [(rng.randrange(80), text(rng.randrange(0, 12))) for _ in range(150)]
    items = [(k, text(rng.randrange(1, 9))) for k in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lexical_search.search(docs, spark.createDataFrame(items, "item_id long, text string"), 4)
    assert ranked(got) == best(rows, items, 4)


def repeats(rows, length):
    """By a dictionary of all windows: in the order of rows, then of starts."""
    order = sorted({(2**63 - 1 if i is None else i, t or "") for i, t in rows}, key=lambda r: (r[0], hash_of(r[1])))
    seen, out = set(), {}
    for i, t in order:
        words = t.encode().split()
        gone = [False] * len(words)
        for p in range(len(words) - length + 1):
            window = tuple(words[p : p + length])
            if window in seen:
                gone[p : p + length] = [True] * length
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[i, t] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return Counter((2**63 - 1 if i is None else i, *out[2**63 - 1 if i is None else i, t or ""]) for i, t in rows)


def hash_of(text):
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def removed(df):
    return Counter((r._id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("seed,length,gram,hot", [(1, 20, 5, 512), (2, 6, 2, 512), (3, 6, 3, 2), (4, 20, 5, 1), (5, 4, 4, 3)])
def test_planted_stretches(spark, seed, length, gram, hot, monkeypatch):
    for name, value in (("CHUNK_BYTES", 2500), ("GROUP", 200), ("SEGMENT", 60), ("SHARD_WORDS", 150), ("HOT", hot)):
        monkeypatch.setattr(automaton_dedup, name, value)
    rng = random.Random(seed)
    text = lambda n: rng.choice(" \t").join(rng.choice(["a", "b", "é", "cc", "dd\x00"]) for _ in range(n))
    passages = [text(rng.randrange(3, 60)) for _ in range(6)]
    rows = []
    for _ in range(60):
        parts = [text(rng.randrange(0, 25)), rng.choice(passages), text(rng.randrange(0, 9)), rng.choice(passages), "ab " * rng.randrange(0, 70)]
        rows.append((rng.randrange(50), " ".join(parts) if rng.random() > 0.1 else rows[-1][1] if rows else ""))
    rows += [rows[3], (None, rows[5][1]), (None, rows[6][1]), (9, None), (8, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert removed(automaton_dedup.remove_repeats(docs, length, gram)) == repeats(rows, length)


@pytest.mark.parametrize("name", ["docs", "odd", "none"])
def test_stretches_of_tables(request, name):
    docs = request.getfixturevalue(name)
    got = automaton_dedup.remove_repeats(docs, keep_text=True)
    assert removed(got) == repeats([(r.doc_id, r.text) for r in docs.collect()], 20)
    for r in got.collect():
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.spans) == r.n_removed


@pytest.mark.parametrize("seed", range(3))
def test_automaton_statistics(seed):
    rng = random.Random(seed)
    text = [rng.randrange(3) for _ in range(120)]
    other = [rng.randrange(4) for _ in range(60)]
    held, ends = automaton_dedup.SuffixAutomaton(text).statistics(other, 5)
    for p, (n, e) in enumerate(zip(held, ends, strict=True)):
        places = {m: [k for k in range(m, len(text) + 1) if text[k - m : k] == other[p + 1 - m : p + 1]] for m in range(1, min(5, p + 1) + 1)}
        most = max((m for m, found in places.items() if found), default=0)
        assert n == most and e == (places[most][0] - 1 if most else -1)


def test_anchors_of_many_stretches_are_dealt_by_window(spark, monkeypatch):
    """A common passage with a different neighbourhood in each document: what one part gets does not grow with the documents."""
    monkeypatch.setattr(automaton_dedup, "HOT", 8)
    rng = random.Random(1)
    passage = " ".join(f"p{k}" for k in range(25))
    rows = [(i, " ".join(f"x{rng.randrange(10**9)}" for _ in range(20)) + f" {passage} " + " ".join(f"y{rng.randrange(10**9)}" for _ in range(20))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r._id: r.n_removed for r in automaton_dedup.remove_repeats(docs).collect()}
    assert got == {i: 25 if i else 0 for i in range(200)}


FILES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN


def links(rows):
    pair = alignment.Pair(*FILES)
    out, per, holds = [], [], Counter()
    for i, t in rows:
        a, b, right = pair.encode(" " + t) if t else ([], [], False)
        if not right:
            a, b = [], []
        ends = [0, 0]
        stops = [set(), set()]
        for side, (ids, table) in enumerate(((a, pair.a_bytes), (b, pair.b_bytes))):
            for x in ids:
                ends[side] += len(table[x])
                stops[side].add(ends[side])
        groups = []
        for stop in sorted(stops[0] & stops[1]):
            taken = []
            for ids, table, had in ((a, pair.a_bytes, sum(len(g[0]) for g in groups)), (b, pair.b_bytes, sum(len(g[1]) for g in groups))):
                size, own = sum(len(table[x]) for x in ids[:had]), []
                for x in ids[had:]:
                    if size == stop:
                        break
                    size += len(table[x])
                    own.append(x)
                taken.append(own)
            groups.append(taken)
        linked = Counter((x, y) for own, other in groups for x in own for y in other)
        holds.update(set(linked))
        per.append(linked)
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((2**63 - 1 if i is None else i, len(a), len(b), len(groups), sum(linked.values()), said))
    top = defaultdict(int)
    for (x, _), n in holds.items():
        top[x] = max(top[x], n)
    return Counter((*o[:5], sum(n for (x, y), n in linked.items() if holds[x, y] == top[x]), sum(n * holds[p] for p, n in linked.items()), hashlib.sha256(o[5].encode()).hexdigest() if o[1] else "") for o, linked in zip(out, per, strict=True))


@pytest.mark.parametrize("name,chunk", [("docs", 60000), ("docs", 8000000), ("odd", 400), ("none", 400)])
def test_alignment_of_tables(request, name, chunk, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", chunk)
    docs = request.getfixturevalue(name)
    if name == "docs":
        docs = docs.limit(60)
    got = alignment.token_links(docs, *FILES)
    assert Counter(tuple(r) for r in got.collect()) == links([(r.doc_id, r.text) for r in docs.collect()])


def test_pieces_hold_what_their_texts_do(docs):
    """Merges by rank against the tokenizer's own file, large groups against small ones, and pieces whose bytes differ."""
    pair, store = alignment.Pair(*FILES), alignment.Store(*FILES)
    pieces = list(dict.fromkeys(p for r in docs.collect() for p in alignment.pieces_of(r.text))) + [" ", " ▁a", " x▁", "  two", " a\nb", " naïve", " слово", " 漢字", " <|endoftext|>", " " + "é漢" * 80, " " + "y" * 500, " <0x41>"]
    numbers = store.numbers(pieces * 2)
    table, keys, times = store.held.whole()
    ends = table[:, 4].cumsum()
    for p, n in zip(pieces, numbers.tolist(), strict=False):
        a, b, right = pair.encode(p)
        assert right == bool(table[n, 5])
        if right:
            assert table[n, :2].tolist() == [len(a), len(b)]
            said = [g.split("|") for g in store.held.names[n].split(";")]
            assert [int(x) for g in said for x in g[0].split(",")] == a and [int(x) for g in said for x in g[1].split(",")] == b and table[n, 2] == len(said)
            want = Counter(int(x) << 32 | int(y) for g in said for x in g[0].split(",") for y in g[1].split(","))
            got = Counter()
            for k, t in zip(keys[ends[n] - table[n, 4] : ends[n]].tolist(), times[ends[n] - table[n, 4] : ends[n]].tolist(), strict=True):
                got[k] += t
            assert got == want and table[n, 3] == sum(want.values())
    assert numbers[: len(pieces)].tolist() == numbers[len(pieces) :].tolist()


def test_owners_overlaps_and_cuts():
    a, b = alignment.owners([2, 1, 3]), alignment.owners([1, 2, 2, 1])
    assert a.tolist() == [0, 0, 1, 2, 2, 2] and b.tolist() == [0, 1, 1, 2, 2, 3]
    assert alignment.overlaps(a, b).tolist() == [[0, 0], [0, 1], [1, 1], [2, 2], [2, 3]] and alignment.cuts(a, b).tolist() == [3]


def test_aligned_outputs(spark, odd):
    pair = alignment.Pair(*FILES)
    for r in alignment.aligned(odd, *FILES).collect():
        if r.a:
            whole = b"".join(pair.a_bytes[i] for i in r.a)
            assert whole == b"".join(pair.b_bytes[i] for i in r.b) and r.cuts[-1] == len(whole)
            starts_a, starts_b = ([0], [0])
            for ids, table, starts in ((r.a, pair.a_bytes, starts_a), (r.b, pair.b_bytes, starts_b)):
                for i in ids:
                    starts.append(starts[-1] + len(table[i]))
            assert [(o.a, o.b) for o in r.overlaps] == [(x, y) for x in range(len(r.a)) for y in range(len(r.b)) if max(starts_a[x], starts_b[y]) < min(starts_a[x + 1], starts_b[y + 1])]
            assert r.cuts == sorted(set(starts_a[1:]) & set(starts_b[1:]))


def test_a_text_of_megabytes(spark):
    """One text of 6 MB through all three, with the constants in force."""
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(1_000_000))
    rows = [(1, long), (2, " ".join(long.split()[500:600])), (3, "short text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(automaton_dedup.remove_repeats(docs)) == repeats(rows, 20)
    assert ranked(lexical_search.search(docs, spark.createDataFrame([(7, rows[1][1])], "item_id long, text string"))) == best(rows, [(7, rows[1][1])])
    got = {r._id: r for r in alignment.token_links(docs, *FILES).collect()}
    a, b, right = alignment.Pair(*FILES).encode(" " + long)
    assert right and (got[1].n_a, got[1].n_b) == (len(a), len(b)) and got[3].n_a > 0
