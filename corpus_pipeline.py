"""From raw documents to token digests: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents; the last returns a row of digests for each
document that is left. run() writes each stage's result to the shared folder and rereads it. SQL cannot express the stages (kernel
regression, hashed signatures, byte-level BPE), so ORACLE_SQL is None and tests compare run() with a brute-force version.

Defined results, in every stage: the text decides, so rows are told apart by id and sha256 of the text; rows without an id, and rows that share one,
stand or fall singly. Equal (id, text) rows are one document: the near-duplicates keep one of them. Null texts are empty, very long texts are read whole, an
empty table gives no rows, and columns beyond those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import fmindex, minhash, string_kernel, suffix_dedup, word_bpe
from tidemark.llm.common import NO_ID, crc_mod, cut, drop_cut

#: Rows of an id and a digest (below 100 MB in a task's table) that go to all tasks; more are joined by a shuffle of the texts.
BROADCAST_ROWS = 1_000_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def digest() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)


def with_keys(docs: DataFrame) -> DataFrame:
    """Adds the key of a row: _id and _digest."""
    return docs.select(*COLUMNS).withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("_digest", digest())


def small(keys: DataFrame) -> DataFrame:
    """A written table of keys, sent to all tasks if its rows are few, so that texts are not shuffled."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is found (no text, or no letter) and sets lang to the language predicted for the rest.

    Without labelled training texts there is nothing to predict: documents with a letter stay as they are.
    """
    docs = docs.select(*COLUMNS)
    model = string_kernel.fit(*string_kernel.training_rows(docs.where(crc_mod("doc_id", 5) != 0)))
    found = string_kernel.identify(docs, model)
    letters = F.col("text").rlike(r"\p{L}")
    kept = found.where(F.col("lang_pred") != "und") if model is not None else found.where(letters)
    return kept.select("doc_id", "text", (F.col("lang_pred") if model is not None else F.col("lang")).alias("lang"), "source", "n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document, by id and then by digest, of each group of near-duplicates: five words, similarity 0.8.

    Documents without an id come last. Equal rows leave one, of which the smallest (lang, source, n_chars) is taken.
    """
    groups = minhash.near_duplicates(docs)
    gone = cut(groups.where("not first").select(F.col("_id").alias("i"), F.col("digest").alias("d")).distinct(), "gone")
    keys, gone = with_keys(docs), small(gone)
    left = keys.join(gone, (keys["_id"] == gone["i"]) & (F.unhex(keys["_digest"]) == gone["d"]), "left_anti")
    again = cut(groups.where("first").groupBy("_id", F.lower(F.hex("digest")).alias("_digest")).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "again")
    if again.isEmpty():
        return left.select(*COLUMNS)
    again = small(again)
    ones, many = left.join(again, ["_id", "_digest"], "left_anti"), left.join(again, ["_id", "_digest"], "left_semi")
    least = F.min(F.struct("lang", "source", "n_chars"))
    kept = many.groupBy("doc_id", "_id", "_digest").agg(F.first("text").alias("text"), least.alias("m"))
    return ones.select(*COLUMNS).unionByName(kept.select("doc_id", "text", "m.lang", "m.source", "m.n_chars"))


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes strings of 100 bytes that occur earlier; bytes of characters cut in two go too, and documents left without text. n_chars is counted anew."""
    docs = docs.select(*COLUMNS)
    others = [f for f in docs.schema.fields if f.name != "text"]
    found = suffix_dedup.remove_repeats(docs, keep_text=True, along=F.to_json(F.struct(*[f.name for f in others])))
    kept = found.where("n_removed = 0 or kept <> ''").select("n_removed", F.col("kept").alias("text"), F.from_json("along", T.StructType(others)).alias("o"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("o.n_chars"))
    return kept.select("o.doc_id", "text", "o.lang", "o.source", n_chars.alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more of the words lie inside occurrences of benchmark phrases."""
    found = fmindex.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = cut(found.where(fmindex.contaminated()).select("_id", F.col("sha256").alias("_digest")).distinct(), "contaminated")
    return with_keys(docs).join(small(bad), ["_id", "_digest"], "left_anti").select(*COLUMNS)


def token_digests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes what is left: a row of digests for each document."""
    import public_tokenizers as P

    out = word_bpe.token_digests(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    return out.select(F.when(F.col("_id") != NO_ID, F.col("_id")).alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("repeat_removal", repeat_removal),
    ("decontamination", decontamination),
    ("token_digests", token_digests),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        drop_cut(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
