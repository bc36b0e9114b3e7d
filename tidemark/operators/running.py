"""Ranks and running sums over a whole table, without a window that holds all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.tables import checkpointed


def cumulated(rows: DataFrame, order: list[Column], **values: Column) -> DataFrame:
    """Adds, for each value, its running sum in this order (the row itself included); the order must be total.

    Rows are dealt by range, summed within each range, and what the ranges before hold is added: one number a range and value.
    """
    placed = rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    for name, value in values.items():
        placed = placed.withColumn(name, value.cast("double") if name.startswith("real_") else value.cast("long"))
    placed = checkpointed(placed)
    sums = placed.groupBy("_p").agg(*[F.sum(name).alias(name) for name in values])
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("_p", *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_{name}") for name in values])
    own = W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = placed.join(F.broadcast(offsets), "_p")
    return out.select(*rows.columns, *[(F.sum(name).over(own) + F.col(f"_{name}")).alias(name) for name in values])
