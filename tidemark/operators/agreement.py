"""Agreement of annotators and decisions on relabelling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cohen(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Kappa of two raters' columns; 1 where chance agreement is 1."""
    n = rows.count()
    po = rows.agg(F.avg(F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)).alias("po"))
    p, q = rows.groupBy(F.col(a).alias("c")).agg((F.count("*") / n).alias("p")), rows.groupBy(F.col(b).alias("c")).agg((F.count("*") / n).alias("q"))
    pe = p.join(q, "c").agg(F.coalesce(F.sum(F.col("p") * F.col("q")), F.lit(0.0)).alias("pe"))
    kappa = F.when(F.col("pe") == 1, F.lit(1.0)).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return po.crossJoin(pe).select(F.round("po", 6).alias("agreement"), F.round(kappa, 6).alias("kappa"))  # one row each


def fleiss(rows: DataFrame, raters: list[str]) -> DataFrame:
    """Kappa of a fixed number of raters."""
    r = len(raters)
    long = rows.select("id", F.explode(F.array(*raters)).alias("c"))
    counts = long.groupBy("id", "c").agg(F.count("*").alias("k"))
    per = counts.groupBy("id").agg(((F.sum(F.col("k") * F.col("k")) - r) / (r * (r - 1))).alias("p"))
    total = long.count()
    pe = long.groupBy("c").agg((F.count("*") / total).alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("pe"))
    kappa = F.when(F.col("pe") == 1, F.lit(1.0)).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return per.agg(F.avg("p").alias("po"), F.count("*").alias("n")).crossJoin(pe).select("n", F.round(kappa, 6).alias("kappa"))


def majority(raters: list[str]) -> Column:
    """The commonest of the ratings; of equals, the one given first."""
    values = F.array(*raters)
    ranked = F.transform(F.array_distinct(values), lambda v: F.struct((-F.size(F.filter(values, lambda x: x == v))).alias("n"), F.array_position(values, v).alias("at"), v.alias("v")))
    return F.array_min(ranked)["v"]


def report(rows: DataFrame, raters: list[str]) -> DataFrame:
    """Counts of full agreement, of two against one, and of rows to be adjudicated."""
    kinds = F.size(F.array_distinct(F.array(*raters)))
    return rows.agg(F.count("*").alias("n"), F.count_if(kinds == 1).alias("all_agree"), F.count_if(kinds == 2).alias("two_kinds"), F.count_if(kinds > 2).alias("adjudicate"))


def inner_all(sheets: list[DataFrame], key: str = "id") -> DataFrame:
    """Rows of ids that every sheet has."""
    return reduce(lambda a, b: a.join(b, key), sheets)


def decision(status: Column, first: Column, second: Column, strict: bool) -> Column:
    """keep, relabel, or - where annotators differ - adjudicate (drop, if strict). A missing second annotator agrees."""
    agreed = second.isNull() | (first == second)
    return F.when(~agreed, F.lit("drop" if strict else "adjudicate")).when(first == status, F.lit("keep")).otherwise(F.lit("relabel"))
