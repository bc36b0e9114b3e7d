"""Runs that are taken up again, limited, or reported in short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending(rows: DataFrame, done: DataFrame, signature: str, key: str = "id") -> DataFrame:
    """Rows without a result yet. A result under another signature than this run's is an error."""
    same = F.when(F.col("signature") == signature, F.col(key)).otherwise(F.raise_error(F.lit("existing results use a different configuration")))
    return rows.join(done.select(same.alias(key)), key, "left_anti")


def first_rows(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows of a stated order."""
    return rows.orderBy(*order).limit(n)


def some_groups(rows: DataFrame, group: str, n: int, seed: int) -> DataFrame:
    """All rows of n groups, drawn by a hash of the seed and the group."""
    drawn = rows.select(group).distinct().orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), group)), group).limit(n)
    return rows.join(drawn, group, "left_semi")


def compacted(results: DataFrame, keep: list[str], signature: str, keys: list[str]) -> DataFrame:
    """Those of the columns that are there, and some keys of the JSON signature (null where absent)."""
    told = F.struct(*[F.get_json_object(F.coalesce(F.col(signature), F.lit("{}")), f"$.{k}").alias(k) for k in keys])
    return results.select(*[c for c in keep if c in results.columns], told.alias("signature"))
