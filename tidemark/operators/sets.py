"""Unions, dedup, reconciliation and upserts of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_of(named: dict[str, DataFrame]) -> DataFrame:
    """Records of several sources, with the source's name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("subset", F.lit(k)) for k, df in named.items()])


def last_wins(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key, by an aggregate and not a window, so that partial results combine before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}") for c in rest])


def unique_or_error(rows: DataFrame, key: str) -> DataFrame:
    """The rows; an id that repeats is an error when they are read."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    checked = F.when(F.col("_n") == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("repeated id "), F.col(key).cast("string"))))
    return rows.join(counts, key).withColumn(key, checked).drop("_n")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids of one side only."""
    missing = left.select(key).join(right.select(key), key, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(right.select(key).join(left.select(key), key, "left_anti").withColumn("side", F.lit("extra")))


def replaced(rows: DataFrame, new: DataFrame, old: Column) -> DataFrame:
    """Without the old ones, with the new."""
    return rows.where(~old | old.isNull()).unionByName(new)


def upsert(have: DataFrame, come: DataFrame, key: str) -> DataFrame:
    """What comes replaces what is there, unless that is accepted and it isn't."""
    a, b = have.select(key, F.struct(*[c for c in have.columns if c != key]).alias("a")), come.select(key, F.struct(*[c for c in have.columns if c != key]).alias("b"))
    both = a.join(b, key, "full")
    pick = F.when(F.col("b").isNull(), F.col("a")).when(F.col("a").isNull(), F.col("b")).when(F.col("a.accepted") & ~F.col("b.accepted"), F.col("a")).otherwise(F.col("b"))
    return both.select(key, pick.alias("r")).select(key, "r.*")


def applied_edits(rows: DataFrame, edits: DataFrame, text: str) -> DataFrame:
    """Replaces exact old texts, in order of the edits; each applied edit is kept in a trail. Edits of an unknown id are an error."""
    lists = edits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "old", "new"))).alias("_e"))
    have = F.coalesce("_e", F.array().cast("array<struct<seq: bigint, old: string, new: string>>"))
    both = rows.withColumn("_there", F.lit(True)).join(lists, "id", "full")
    there = F.when(F.col("_there"), have).otherwise(F.raise_error(F.concat(F.lit("edit of an unknown id: "), F.col("id").cast("string"))))
    out = both.withColumn("_e", there).drop("_there")
    edited = F.aggregate("_e", F.col(text), lambda t, e: F.replace(t, e["old"], e["new"]))
    return out.withColumn("trail", F.transform(F.filter("_e", lambda e: F.contains(F.col(text), e["old"])), lambda e: e["seq"])).withColumn(text, edited).drop("_e")
