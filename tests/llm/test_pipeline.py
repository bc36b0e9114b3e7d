import hashlib
from collections import namedtuple

import numpy as np
import pytest
import tiktoken
from test_contamination import brute as brute_hits
from test_near_duplicates import brute as brute_groups
from test_repeats import place

import corpus_pipeline
from tidemark.llm import fmindex, string_kernel

Doc = namedtuple("Doc", "doc_id text lang source n_chars")


def removed(rows, length=100):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: place(r.doc_id, r.text)):
        t = r.text.encode()
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if t[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(t[p : p + length])
        if gone.any():
            rest = bytes(np.frombuffer(t, np.uint8)[~gone]).decode("utf-8", "ignore")
            r = r._replace(text=rest, n_chars=len(rest))
        if r.text or not gone.any():
            out.append(r)
    return out


def brute(rows, bench):
    rows = [r for r in rows if r.text is not None and any(c.isalpha() for c in r.text)]
    rows = removed(list({(r.doc_id, r.text): r for r, (*_, first) in zip(rows, brute_groups(rows, 5, 80), strict=True) if first}.values()))
    out = []
    for r in rows:
        words = fmindex.words_of(r.text)
        hit = sum(brute_hits(words, bench)[0])
        if not (hit and 20 * hit >= len(words)):
            out.append(r)
    return out


@pytest.mark.parametrize("kind", ["part", "odd", "unnamed"])
def test_pipeline_matches_brute_force(spark, sf, odd, kind, tmp_path):
    if kind == "part":
        docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 90 and n_chars < 6000")
    elif kind == "unnamed":  # rows without an id and rows that share one: clean, contaminated, copies, repeats of one passage
        item = next(r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect() if len(fmindex.words_of(r.text)) >= 20)
        passage = " ".join(f"passage{k}" for k in range(30))
        texts = ["a clean text of its own", item, passage + " first", "second " + passage + " é", " ".join(f"copy{k}" for k in range(60)), " ".join(f"copy{k}" for k in range(59))]
        rows = [(i, t, "en", "s", len(t)) for i in (None, 3, 4) for t in texts]
        docs = spark.createDataFrame([*rows, rows[0], rows[8], (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    else:
        docs = odd.where("doc_id is null or doc_id <> 5").select(*corpus_pipeline.COLUMNS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    import public_tokenizers as P

    from tidemark.llm.word_bpe import ranks

    tool = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = []
    for r in brute([Doc(*x) for x in docs.select(*corpus_pipeline.COLUMNS).collect()], bench):
        ids = tool.encode_ordinary(r.text)
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and got


def test_stages_keep_the_columns(spark, sf, docs):
    for name, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, docs.withColumn("_crc", docs["doc_id"]).withColumn("rest", docs["text"]), sf)
        assert out.columns == list(corpus_pipeline.COLUMNS) and 0 < out.count() <= docs.count(), name
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_empty(spark, docs, tmp_path, sf):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert string_kernel.fit(string_kernel.packed([]), []) is None


def test_decontamination_drops_only_contaminated_rows(spark, sf):
    """Of documents without an id, or with the same one, the clean stay."""
    bench = next(r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect() if len(fmindex.words_of(r.text)) >= 20)
    clean = "nothing of the sort stands here"
    rows = [(i, t, "en", "s", len(t)) for i in (None, 3, 4) for t in (clean, bench)][:5]
    out = corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), sf)
    assert sorted(map(tuple, out.collect()), key=str) == sorted((tuple(r) for r in rows if r[1] == clean), key=str)
