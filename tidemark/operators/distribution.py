"""Shares, marginals, comparisons and fingerprints of datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shares(rows: DataFrame, key: Column) -> DataFrame:
    """Percent of the rows with each value."""
    counts = rows.groupBy(key.alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()), 6))


def marginals(rows: DataFrame, *fields: str) -> DataFrame:
    """Counts of the values of several fields, in one pass."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return rows.select(F.inline(pairs)).groupBy("field", "value").agg(F.count("*").alias("n"))


def numeric_profile(rows: DataFrame, *fields: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields])
    return rows.select(F.inline(pairs)).groupBy("field").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.round(F.avg("v"), 6).alias("mean"))


def compared(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Shares of each value on both sides and their difference in percentage points."""
    part = lambda df, name: df.groupBy(key).agg(F.count("*").alias("n")).select(key, (F.col("n") / F.sum("n").over(W.partitionBy())).alias(name))
    both = part(first, "p").join(part(second, "q"), key, "full").na.fill(0.0, ["p", "q"])
    return both.select(key, F.round("p", 6).alias("p"), F.round("q", 6).alias("q"), F.round((F.col("q") - F.col("p")) * 100, 6).alias("shift"))


def total_variation(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    return compared(first, second, key).agg(F.round(F.sum(F.abs(F.col("p") - F.col("q"))) / 2, 5).alias("tv"), F.round(F.max(F.abs("shift")), 4).alias("max_shift"))


def fingerprint(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """Digest of whole rows, rows and distinct ids, whatever the order of rows: the sum of 60 bits of each row's SHA-256, so nothing is gathered.

    A row is its columns (all of them, by name, if none are given) as text, nulls told apart from empty texts.
    """
    own = columns or tuple(sorted(rows.columns))
    text = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in own])
    number = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    total = F.coalesce(F.sum(number.cast("decimal(28,0)")), F.lit(0))
    return rows.agg(F.sha2(total.cast("decimal(38,0)").cast("string"), 256).alias("digest"), F.count("*").alias("rows"), F.countDistinct(name).alias("ids"))


def tallies(rows: DataFrame, labels: Column, *by: str) -> DataFrame:
    """Counts of multi-valued labels."""
    return rows.select(*by, F.explode(F.array_distinct(labels)).alias("label")).groupBy(*by, "label").agg(F.count("*").alias("n"))


def combinations(rows: DataFrame, labels: Column) -> DataFrame:
    return rows.groupBy(F.array_join(F.array_sort(labels), "+").alias("combination")).agg(F.count("*").alias("n"))


def release_statistics(rows: DataFrame, by: str) -> DataFrame:
    """Counts and means of each subset and of all (subset null)."""
    mean = lambda c: F.round(F.avg(c), 6)
    return rows.rollup(by).agg(F.count("*").alias("n"), F.countDistinct("episode_id").alias("episodes"), F.count_if("known").alias("n_known"), mean("query_time").alias("mean_time"), mean(F.when(F.col("span_end") > 0, F.col("span_end"))).alias("mean_span_end"), F.max("change_intensity").alias("max_intensity"))
