"""The tables' rows as items, predictions and frames; the same views in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import scoring
from tidemark.sources.tables import table


def items(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", "quality")
    known, span = F.col("quality") == 1, F.col("n_chars") % 60
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("source").alias("episode_id"), F.col("lang").alias("question_type"), known.alias("known"), F.when(known, F.col("doc_id") % 3).otherwise(3).alias("answer"),
        F.lit(3).alias("abstention_index"), (1 + F.col("n_chars") % 10).alias("change_intensity"), span.alias("query_time"), (span - F.col("doc_id") % 20).alias("span_end"), "text", "n_chars",
    )


def preds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 11 != 0, (F.col("doc_id") * 7 + F.col("n_chars")) % 4).alias("pred_index"))


def outs(spark: SparkSession, sf: str) -> DataFrame:
    own = items(spark, sf)
    return scoring.outcomes(own, preds(spark, sf).join(own.select("id"), "id", "left_semi"))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    t = F.floor((at - F.min(at).over(W.partitionBy("user_id"))) / 1_000_000)
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("episode"), "event_type", "value", t.alias("t"))


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders")


SQL = """WITH items AS (
  SELECT d.doc_id AS id, d.source AS episode_id, d.lang AS question_type, l.quality = 1 AS known, CASE WHEN l.quality = 1 THEN d.doc_id % 3 ELSE 3 END AS answer,
    1 + d.n_chars % 10 AS change_intensity, d.n_chars % 60 AS query_time, d.n_chars % 60 - d.doc_id % 20 AS span_end, d.text AS text, d.n_chars AS n_chars
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
preds AS (SELECT doc_id AS id, CASE WHEN doc_id % 11 <> 0 THEN (doc_id * 7 + n_chars) % 4 END AS pred_index FROM documents),
outs AS (SELECT i.*, p.pred_index, coalesce(p.pred_index = 3, false) AS abstained, p.pred_index IS NULL AS invalid, coalesce(p.pred_index = i.answer, false) AS correct,
    CASE WHEN p.pred_index = 3 THEN 0 WHEN p.pred_index = i.answer THEN 1 ELSE -1 END AS er FROM items i JOIN preds p ON i.id = p.id),
frames AS (SELECT event_id AS seq, user_id AS episode, event_type, value, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 1000000 AS t FROM events)
"""
