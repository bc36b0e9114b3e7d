"""Streams of frames and events. Sources are ordered, so the watermark is zero and late rows are dropped, as batch queries never see them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """The events table as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str, *by: str, delay: str = "0 seconds") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), *by).agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, gap: str, key: str, delay: str = "0 seconds") -> DataFrame:
    """Spans of events no further apart than a gap."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))


def windows_kept(events: DataFrame, key: str, value: str, capacity: int) -> DataFrame:
    """After each batch and key: the last `capacity` values, how many came and how many are gone. State holds the capacity, never the stream."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, seen = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        own = pd.concat(list(parts)).sort_values("seq")[value].tolist()
        seen += len(own)
        kept = (kept + own)[-capacity:] if capacity > 0 else kept + own
        state.update((kept, seen))
        yield pd.DataFrame({"episode": [k[0]], "kept": [kept], "seen": [seen], "evicted": [max(0, seen - capacity) if capacity > 0 else 0]})

    rows = events.select(F.col(key).alias("episode"), F.col("event_id").alias("seq"), F.col(value).cast("double").alias(value))
    return rows.groupBy("episode").applyInPandasWithState(step, "episode long, kept array<double>, seen long, evicted long", "kept array<double>, seen long", "update", GroupStateTimeout.NoTimeout)


def run_to_memory(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs all there is and returns what came out."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def prefix_frames(frames: DataFrame, asks: DataFrame, key: str) -> DataFrame:
    """Frames newly seen at each ask: after the ask before, up to this one. A frame belongs to the first ask at or after it: one window over both, in the order of time."""
    own, more = [c for c in frames.columns if c != key], [c for c in asks.columns if c != key]
    kind = lambda df, names: df.select(F.struct(*names).alias("s")).schema["s"].dataType
    a = frames.select(key, F.col("t").cast("double").alias("_t"), F.lit(0).alias("_k"), F.lit(None).cast(asks.schema["id"].dataType).alias("_i"), F.struct(*own).alias("_f"), F.lit(None).cast(kind(asks, more)).alias("_a"))
    b = asks.select(key, (F.col("query_time") + 1e-6).cast("double").alias("_t"), F.lit(1).alias("_k"), F.col("id").alias("_i"), F.lit(None).cast(kind(frames, own)).alias("_f"), F.struct(*more).alias("_a"))
    w = W.partitionBy(key).orderBy("_t", "_k", "_i")
    both = a.unionByName(b).withColumn("_n", F.first("_a", True).over(w.rowsBetween(0, W.unboundedFollowing))).where("_k = 0 and _n is not null")
    return both.select(key, "_f.*", *[F.col(f"_n.{c}").alias(c) for c in more if c not in own])


def audit(rows: DataFrame, leaks: Column) -> DataFrame:
    return rows.agg(F.countDistinct("episode").alias("episodes"), F.max("seen").alias("most_seen"), F.sum("evicted").alias("evictions"), F.count_if(leaks).alias("leaks"))
