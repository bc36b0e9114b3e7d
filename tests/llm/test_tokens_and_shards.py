import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import hilbert, simple8b


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=300), st.sampled_from([1, 7, 64, 2048]))
def test_words_round_trip(ids, block):
    ids = np.array(ids, np.uint64)
    parts = simple8b.pack(ids, block)
    assert (simple8b.unpack(*parts, len(ids), block) == ids).all()


def test_words_are_dense():
    words = simple8b.pack(np.arange(3000, dtype=np.uint64) + 33000)[0]
    assert len(words) <= 3000 / 3 + 2


def expected_ids(rows):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(b"".join(struct.pack("<I", x) for x in ids))))
        start += len(ids)
    return out


@pytest.mark.parametrize("name", ["docs", "odd", "none"])
def test_ids(request, name):
    docs = request.getfixturevalue(name)
    got = [tuple(r) for r in simple8b.read_ids(simple8b.write_ids(docs, P.path("byte_bpe_50k.json"))).selectExpr("if(_id = 9223372036854775807, null, _id)", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=str) == sorted(expected_ids([(r.doc_id, r.text) for r in docs.collect()]), key=str)


def test_added_tokens_in_texts(spark):
    """Alone, inside, glued to words, after spaces, and where pieces are joined to be encoded."""
    t = "<|endoftext|>"
    texts = [t, f"a{t}b", f"a {t} b", f" {t}", f"{t} ", f"word {t}{t} word", f"x  {t}  y", f"{t}x {t}y z{t}", "<|endoftext| >", f"é{t}é\n{t}", f"{t[:-1]}", " ".join(f"w{k}{t}" for k in range(600))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r) for r in simple8b.read_ids(simple8b.write_ids(docs, P.path("byte_bpe_50k.json"))).collect()]
    assert sorted(got) == sorted(expected_ids(list(enumerate(texts))))


def hilbert_plain(x, bits):
    """The textbook algorithm: transpose form, then interleaved."""
    x, n, q = list(x), len(x), 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    out = 0
    for b in reversed(range(bits)):
        for v in x:
            out = out * 2 + ((v ^ t) >> b & 1)
    return out


def test_curve_is_continuous_and_matches_textbook(spark):
    from pyspark.sql import functions as F

    cube = spark.range(512).select((F.col("id") % 8).alias("a"), (F.floor(F.col("id") / 8) % 8).alias("b"), F.floor(F.col("id") / 64).alias("c"))
    rows = hilbert.with_hilbert(cube, [F.col("a"), F.col("b"), F.col("c")], bits=3).orderBy("hilbert").collect()
    assert [r.hilbert for r in rows] == list(range(512))
    assert all(r.hilbert == hilbert_plain((r.a, r.b, r.c), 3) for r in rows)
    assert all(sum(abs(p[k] - q[k]) for k in "abc") == 1 for p, q in zip(rows, rows[1:], strict=False))


@pytest.mark.parametrize("name,shards", [("docs", 40), ("odd", 4), ("odd", 40), ("none", 40)])
def test_shards(request, name, shards):
    docs = request.getfixturevalue(name)
    rows = hilbert.hilbert_shards(docs, shards).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    by = Counter(r.shard for r in rows)
    if rows:
        assert max(by.values()) - min(by.get(s, 0) for s in range(shards)) <= 1 and set(by) <= set(range(shards))
    for s in by:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(by[s]))
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert all(a.hilbert <= b.hilbert for a, b in zip(ordered, ordered[1:], strict=False))


def test_shard_files_hold_everything_once(docs, tmp_path, spark):
    hilbert.write_shards(docs, str(tmp_path / "out"), 8)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 8


def test_shards_prune_on_every_dimension(spark):
    """Any language, source, and any twentieth of the ids or sizes lies in about half of the shards at most; a commoner value in its share and a fifth more."""
    sf, shards = "/root/testdata/sf0.1", 40
    meta = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "source")
    rows = hilbert.op8_hilbert_sharding(spark, sf).select("doc_id", "shard", "size").join(meta, "doc_id").collect()
    assert len(rows) == 10_000
    for name in ("lang", "source"):
        for value in {r[name] for r in rows}:
            own = [r.shard for r in rows if r[name] == value]
            assert len(set(own)) <= shards * max(0.55, len(own) / len(rows) + 0.2), (name, value)
    for name in ("doc_id", "size"):
        values = sorted(r[name] for r in rows)
        ends = [(min(v), max(v)) for k in range(shards) if (v := [r[name] for r in rows if r.shard == k])]
        for low in range(0, 10_000, 500):
            a, b = values[low], values[low + 499]
            assert sum(x <= b and y >= a for x, y in ends) <= 0.65 * shards, (name, low)


def test_categories_and_numbers_take_cells(spark):
    rows = [(k, "common" if k < 60 else None if k < 80 else f"rare{k}", float(k)) for k in range(100)]
    df = spark.createDataFrame([*rows, (100, "common", None)], "doc_id long, lang string, x double")
    cells = df.select("lang", "x", hilbert.category_cell(df, "lang").alias("a"), hilbert.number_cells(df, ["x"])[0].alias("b")).collect()
    assert {r.a for r in cells if r.lang == "common"} == {0} and {r.a for r in cells if r.lang is None} == {61 * 64 // 101}
    assert all(0 <= r.a < 64 and 0 <= r.b < 64 for r in cells) and len({r.b for r in cells}) == 64
    assert [r.b for r in cells if r.x is not None] == sorted(r.b for r in cells if r.x is not None)
