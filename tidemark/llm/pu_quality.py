"""Quality scores by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1; the unlabelled set is web text of any kind. A small network is
trained to minimise the non-negative unbiased risk: prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)),
with a gradient step the other way where the bracket falls below zero. The class prior is estimated from the labels.

A text is described by SURFACE numbers (shares of bytes and marks, lengths, repetition, compressibility) and by its content: the shares of its
words, and of its byte trigrams, in BUCKETS hashed buckets each.

The model is fitted on bounded samples drawn by hash of id and text: POSITIVES and UNLABELLED rows on average (as in the method, the unlabelled rows are drawn from
all training texts, trusted positives among them); features are taken in tasks, and the driver gets one row of numbers for each. Scoring covers every whole text.

Defined results: null and empty texts are scored as empty; labels that are null or belong to no document teach nothing;
without positives every score is 0.5; a document labelled twice counts twice; equal texts get equal scores; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, documents, id_out, texts

POSITIVES = 3000
UNLABELLED = 6000
HIDDEN = 24
SURFACE = 38
BUCKETS = 64
WIDTH = SURFACE + 2 * BUCKETS
#: Byte classes counted as shares: lower, upper, digits, white space, sentence marks, other marks, above ASCII.
CLASSES = np.full(256, 5, np.int64)
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58], CLASSES[[9, 10, 11, 12, 13, 32]], CLASSES[[33, 39, 44, 46, 58, 59, 63]], CLASSES[128:] = 0, 1, 2, 3, 4, 6


def content(raw: bytes, words: list[str]) -> np.ndarray:
    """Root shares of a text's words and of its trigrams of bytes by hashed bucket."""
    out = np.zeros(2 * BUCKETS)
    if words:
        counts = Counter(words)
        bucket = np.fromiter((zlib.crc32(w.lower().encode()) % BUCKETS for w in counts), np.int64, len(counts))
        out[:BUCKETS] = np.bincount(bucket, weights=list(counts.values()), minlength=BUCKETS) / len(words)
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) > 2:
        gram = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761) >> np.uint32(26)
        out[BUCKETS:] = np.bincount(gram, minlength=BUCKETS) / len(gram)
    return np.sqrt(out)


def features(text: str) -> np.ndarray:
    return np.concatenate([surface(text), content(text.encode(), text.split())])


def surface(text: str) -> list[float]:
    """Shares and ratios of a whole text; empty texts give zeros."""
    raw = text.encode()
    n = len(raw)
    if not n:
        return [0.0] * SURFACE
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    classes = np.bincount(CLASSES, weights=seen, minlength=7) / n
    marks = seen[[33, 124, 35, 36, 37, 38, 42, 64, 44, 46, 10, 60, 61, 95, 47]] / n
    words = text.split()
    m = max(1, len(words))
    lens = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, m - 1)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / m
    lines = text.split("\n")
    top = counts.most_common(1)[0][1] / m if words else 0.0
    packed = len(zlib.compress(raw, 1)) / (n + 20)
    capitals = sum(w.isupper() for w in counts) / max(1, len(counts))
    return [
        np.log1p(n) / 10, *classes, *marks, lens.mean() / 10, lens.std() / 10, lens.max() / 1000, len(counts) / m, pairs, again, top, packed, capitals,
        len(set(lines)) / len(lines), m / len(lines) / 100, np.log1p(m) / 10, np.log1p(len(lines)) / 10, seen[:9].sum() / n, float(words[0][:1].isupper()) if words else 0.0,
    ]


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, batch: int = 512, rate: float = 5e-3) -> tuple[np.ndarray, ...] | None:
    """Scaling and network weights by Adam on the non-negative risk with the sigmoid loss."""
    if not len(positives) or not len(unlabelled):
        return None
    rng = np.random.default_rng(7)
    both = np.concatenate([positives, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    squash = lambda x: np.clip((x - mean) / scale, -6, 6)
    p, u = squash(positives), squash(unlabelled)
    weights = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, (HIDDEN, 1)), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]

    def forward(x):
        h = np.maximum(x @ weights[0] + weights[1], 0)
        return h, (h @ weights[2] + weights[3])[:, 0]

    def back(x, h, dg):
        dh = dg[:, None] * weights[2][:, 0] * (h > 0)
        return [x.T @ dh, dh.sum(0), h.T @ dg[:, None], dg.sum(keepdims=True)]

    for step in range(1, steps + 1):
        xp, xu = p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)]
        (hp, gp), (hu, gu) = forward(xp), forward(xu)
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))  # the loss of a positive is sigmoid(-g), of a negative sigmoid(g)
        slope_p, slope_u = sp * (1 - sp) / batch, su * (1 - su) / batch
        negative = su.mean() - prior * sp.mean()
        if negative >= 0:
            grads = [a + b for a, b in zip(back(xp, hp, -2 * prior * slope_p), back(xu, hu, slope_u), strict=True)]
        else:
            grads = [a + b for a, b in zip(back(xp, hp, prior * slope_p), back(xu, hu, -slope_u), strict=True)]
        for k, g in enumerate(grads):
            g = g + 1e-4 * weights[k]
            first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
            weights[k] = weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return mean, scale, *weights


def score(model: tuple[np.ndarray, ...] | None, rows: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(rows), 0.5)
    mean, scale, w1, b1, w2, b2 = model
    x = np.clip((rows - mean) / scale, -6, 6)
    return 1 / (1 + np.exp(-(np.maximum(x @ w1 + b1, 0) @ w2 + b2)[:, 0]))


def sampled(rows: DataFrame, n: int, most: int, seed: int) -> DataFrame:
    """About `most` of n rows, by a hash of the text."""
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), "_id", "text"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(1, n))))


def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(-1, WIDTH)
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary())], names=["row"])


def matrix(rows: DataFrame) -> np.ndarray:
    """Features of a sample, in an order of their own."""
    found = sorted(bytes(r["row"]) for r in rows.select("text").mapInArrow(described, "row binary").collect())
    return np.frombuffer(b"".join(found)).reshape(len(found), WIDTH)


def quality_model(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, ...] | None:
    """Learns from whole texts whose ids fall in the training share; labels from that share alone."""
    train = docs.where(crc_mod("doc_id", 3) != 1)
    own = labels.where((crc_mod("doc_id", 3) != 1) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), "quality")
    n, n_pos = own.agg(F.count("*"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0))).first()
    if not n or not n_pos:
        return None
    prior = min(0.98, max(0.02, n_pos / n))
    trusted = sampled(texts(train).join(own.where("quality = 1").select("_id"), "_id"), n_pos, positives, 1)
    web = sampled(texts(train), train.count(), unlabelled, 2)
    return fit(matrix(trusted), matrix(web), prior)


def scored(docs: DataFrame, model: tuple[np.ndarray, ...] | None) -> DataFrame:
    """(_id, score) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(score(model, rows))], names=["_id", "score"])

    return texts(docs).mapInArrow(run, "_id long, score double")


def op4_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = quality_model(docs, documents(spark, sf_dir, "doc_id", "quality", table="labels"))
    out = scored(docs, model).select(id_out(), "score")
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
