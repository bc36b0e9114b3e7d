"""Contracts as named conditions on rows, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def violations(rows: DataFrame, rules: dict[str, Column], key: str = "id") -> DataFrame:
    """(id, rule) for each condition that a row doesn't meet; null counts as not met. One pass for all rules."""
    checks = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, c in rules.items()])
    return rows.select(key, F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("rule"))


def report(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, failures, passed), rules without failures included."""
    counts = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"r{k}") for k, c in enumerate(rules.values())])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{k}").alias("failures"), (F.col(f"r{k}") == 0).alias("passed")) for k, name in enumerate(rules)])))


def gate(checks: DataFrame) -> DataFrame:
    return checks.agg(F.bool_and("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def contiguous(segments: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Half-open segments that don't start where the one before ends."""
    w = W.partitionBy(key).orderBy(start, end)
    return segments.withColumn("expected", F.lag(end).over(w)).where(F.col("expected").isNotNull() & (F.col("expected") != F.col(start)))


def separate(a_start: Column, a_end: Column, b_start: Column, b_end: Column, gap: float = 0.05) -> Column:
    return (a_end + gap < b_start) | (b_end + gap < a_start)


def balance_deviation(rows: DataFrame, strata: list[str], position: str) -> DataFrame:
    """Per stratum the difference between the commonest and rarest position that occurs."""
    counts = rows.groupBy(*strata, position).agg(F.count("*").alias("n"))
    return counts.groupBy(*strata).agg((F.max("n") - F.min("n")).alias("deviation"), F.count("*").alias("positions"))


def within_limits(report_rows: DataFrame, limits: dict[str, float]) -> DataFrame:
    """(name, value, limit, passed); a metric without a limit passes."""
    limit = F.coalesce(*[F.when(F.col("name") == k, F.lit(float(v))) for k, v in limits.items()], F.lit(float("inf")))
    return report_rows.withColumn("limit", limit).withColumn("passed", F.col("value") <= F.col("limit"))


def execution_drift(planned: DataFrame, done: DataFrame, key: str, most: float) -> DataFrame:
    """Events whose start moved by more than a tolerance, or that are on one side only."""
    both = planned.select(key, F.col("start").alias("planned")).join(done.select(key, F.col("start").alias("done")), key, "full")
    return both.withColumn("drift", F.abs(F.col("done") - F.col("planned"))).where(F.col("drift").isNull() | (F.col("drift") > most))
