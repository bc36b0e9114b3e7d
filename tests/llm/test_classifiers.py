import zlib

import numpy as np

from tidemark.llm import pu_quality, string_kernel


def held(rows, m, k):
    return [r for r in rows if (zlib.crc32(str(r.doc_id).encode()) % m == k)]


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = string_kernel.op10_string_kernel_language(spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert [r.held_out for r in rows] == [zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows]
    own = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in own]) > 0.95


def test_language_odd_rows(odd, none):
    docs = odd.select("doc_id", "text", "lang")
    model = string_kernel.fit(*string_kernel.training_rows(docs))
    rows = string_kernel.identify(odd, model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        letters = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)
    assert string_kernel.identify(none, model).count() == 0
    assert string_kernel.fit(*string_kernel.training_rows(none)) is None
    assert {r.lang_pred for r in string_kernel.identify(docs, None).collect()} == {"und"}


def test_training_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, f"text number {k} of its kind", f"l{k % 40}") for k in range(2000)], "doc_id long, text string, lang string")
    spectra, langs = string_kernel.training_rows(docs, per_language=30, most=400)
    assert spectra.shape == (len(langs), string_kernel.BUCKETS // 8) and 250 < len(langs) < 550 and len(set(langs)) == 40
    assert (string_kernel.unpacked(string_kernel.packed(["abc", ""])) == string_kernel.presence(["abc", ""])).all()


def test_kernel_counts_shared_grams():
    k = string_kernel.kernel(string_kernel.presence(["abc", "xyz"]), string_kernel.presence(["abc", "abd", ""]))
    assert abs(k[0, 0] - 1) < 1e-6 and 0 < k[0, 1] < 1 and k[0, 2] == 0 and k[1, 0] == 0


def test_quality_held_out_accuracy(spark):
    """By ranks too: a good document scores above a bad one 99 times of 100."""
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = pu_quality.op4_pu_quality(spark, sf).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    own = [r for r in rows if r.held_out and r.doc_id in truth]
    right = np.mean([r.predicted == truth[r.doc_id] for r in own])
    good, bad = (np.array([r.score for r in own if truth[r.doc_id] == k]) for k in (1, 0))
    area = np.mean((good[:, None] > bad) + 0.5 * (good[:, None] == bad))
    print("quality", right, area)
    assert len(own) > 500 and right > 0.97 and area > 0.99


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(12)] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, text string")
    model = pu_quality.quality_model(odd, labels)
    assert pu_quality.scored(odd, model).count() == odd.count()
    assert pu_quality.scored(none, model).count() == 0
    assert pu_quality.quality_model(odd, labels.limit(0)) is None
    assert {r.score for r in pu_quality.scored(odd, None).collect()} == {0.5}


def test_risk_estimate_recovers_a_line():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (6000, pu_quality.SURFACE))
    good = x[:, 0] + x[:, 1] > -1
    model = pu_quality.fit(x[good][:1500], x, good.mean())
    assert np.mean((pu_quality.score(model, x) >= 0.5) == good) > 0.93
