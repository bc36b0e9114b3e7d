"""Language identification with a string kernel.

A text's blended spectrum is the set of its byte n-grams of 1 to 3 bytes (lower-cased), hashed to BUCKETS presence
bits; the kernel of two texts is the number of bits they share over the root of the product of their counts. LANDMARKS training
texts span the Nyström approximation; kernel ridge regression, one language against the rest, is solved in its
feature space. Whole batches of texts are scored by two matrix products: presence times landmark presence, and kernel
times weights.

The model is fitted on a bounded sample, PER_LANGUAGE labelled texts of each language on average and MOST_TEXTS in all, drawn by hash of id and text;
their spectra are taken in tasks, and the driver gets BUCKETS bits of each.

Defined results: texts of any length are read whole; of equal regressions the alphabetically first language is taken; null texts and texts without a letter are `und` with score 0; so is every text if there is nothing to
learn from; rows without a language teach nothing; equal texts get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, documents, id_col, id_out, release

BUCKETS = 1 << 14
LANDMARKS = 192
PER_LANGUAGE = 500
MOST_TEXTS = 20_000
RIDGE = 1e-2
BATCH = 128
MOST_BROADCAST = 10_000


def presence(texts: list[str], buckets: int = BUCKETS) -> np.ndarray:
    """One row a text: which hashed n-grams occur."""
    out = np.zeros((len(texts), buckets), np.float32)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    for i, t in enumerate(texts):
        b = np.frombuffer(t.lower().encode(), np.uint8).astype(np.uint32)
        for n in (1, 2, 3):
            if len(b) < n:
                break
            gram = b[: len(b) - n + 1]
            for k in range(1, n):
                gram = gram << np.uint32(8) | b[k : len(b) - n + 1 + k]
            out[i, (gram + np.uint32(n << 24)) * np.uint32(2654435761) >> shift] = 1
    return out


def kernel(rows: np.ndarray, marks: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.maximum(rows.sum(1), 1)[:, None] * np.maximum(marks.sum(1), 1)[None])
    return (rows @ marks.T) / norm


def packed(texts: list[str]) -> np.ndarray:
    """Presence as bits."""
    return np.packbits(presence(texts).astype(bool), axis=1)


def unpacked(rows: np.ndarray) -> np.ndarray:
    return np.unpackbits(rows, axis=1).astype(np.float32)


def fit(spectra: np.ndarray, langs: list[str], landmarks: int = LANDMARKS) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """(languages, landmark presence, weights) from packed spectra, or None without any."""
    names = sorted(set(langs))
    if not names:
        return None
    by = {x: [i for i, l in enumerate(langs) if l == x] for x in names}
    share = max(1, landmarks // len(names))
    marks = unpacked(spectra[[i for x in names for i in by[x][:share]][: max(landmarks, len(names))]])
    k_mm = kernel(marks, marks).astype(np.float64)
    values, vectors = np.linalg.eigh(k_mm)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    z = np.concatenate([kernel(unpacked(spectra[i : i + BATCH]), marks) for i in range(0, len(spectra), BATCH)]) @ root
    z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    y = np.array([[1.0 if l == x else -1.0 for x in names] for l in langs])
    balance = np.array([len(langs) / (len(names) * len(by[l])) for l in langs])[:, None]
    b = np.linalg.solve(z.T @ (z * balance) + RIDGE * np.eye(z.shape[1]), z.T @ (y * balance))
    return names, marks.astype(np.uint8), np.concatenate([root @ b[:-1], b[-1:]]).astype(np.float32)


def score(model: tuple[list[str], np.ndarray, np.ndarray], texts: list[str], marks: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Best language and its share of the softmax of the regressions."""
    names, _, weights = model
    margins = kernel(presence(texts), marks) @ weights[:-1] + weights[-1]
    best = margins.argmax(1)
    e = np.exp(4 * (margins - margins.max(1, keepdims=True)))
    return [names[i] for i in best], (1 / e.sum(1)).astype(np.float64)


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST_TEXTS) -> tuple[np.ndarray, list[str]]:
    """Packed spectra and languages of about per_language texts each, `most` in all, evenly by a hash of id and text."""
    rows = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)).alias("_r"))
    counts = rows.groupBy("lang").count()
    languages = counts.count()
    rates = counts.select(F.col("lang").alias("_l"), (F.lit(min(per_language, most / max(1, languages)) * 1_000_000) / F.col("count")).alias("_rate"))
    if languages <= MOST_BROADCAST:  # a row a language; texts stay where they are
        rates = F.broadcast(rates)

    def spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BATCH):
                part = batch.slice(low, BATCH)
                bits = packed(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("_r"), part.column("lang"), pa.array([b.tobytes() for b in bits], pa.binary())], names=["r", "lang", "bits"])

    drawn = rows.join(rates, F.col("lang") == F.col("_l")).where("_r <= _rate").select("_r", "lang", "text")
    got = sorted((r["r"], r["lang"], bytes(r["bits"])) for r in drawn.mapInArrow(spectra, "r long, lang string, bits binary").collect())
    return np.frombuffer(b"".join(b for _, _, b in got), np.uint8).reshape(len(got), BUCKETS // 8), [lang for _, lang, _ in got]


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray] | None) -> DataFrame:
    """Adds lang_pred and score to the rows of docs (any columns; `text` is read)."""
    own = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = None if model is None else model[1].astype(np.float32)
        for batch in batches:
            for low in range(0, batch.num_rows, BATCH):
                part = batch.slice(low, BATCH)
                texts = part.column("text").to_pylist()
                lettered = [i for i, t in enumerate(texts) if t is not None and any(c.isalpha() for c in t)]
                langs, scores = ["und"] * len(texts), np.zeros(len(texts))
                if lettered and model is not None:
                    found, s = score(model, [texts[i] for i in lettered], marks)
                    scores[lettered] = s
                    for i, l in zip(lettered, found, strict=True):
                        langs[i] = l
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in own], pa.array(langs, pa.string()), pa.array(scores)], names=[*[f.name for f in own], "lang_pred", "score"])
            release()

    return docs.select([docs[f.name] for f in own]).mapInArrow(run, schema)


def op10_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang").withColumn("_held", crc_mod("doc_id", 5) == 0)
    model = fit(*training_rows(docs.where("not _held")))
    return identify(docs.select(id_col(), "text", "_held"), model).select(id_out(), F.col("_held").alias("held_out"), "lang_pred", "score")
