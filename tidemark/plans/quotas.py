"""Queries that select with quotas and place answers: a year's line items are a batch's candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import quotas
from tidemark.plans.registry import registry
from tidemark.sources.tables import table

QUERIES, ORACLES, query = registry()

TYPES = ["a", "b", "c", "d"]
QUOTAS = {(t, "known"): 10 for t in TYPES} | {("a", "uncertain"): 3, ("b", "uncertain"): 3, ("c", "uncertain"): 2, ("d", "uncertain"): 2}
TARGETS = {f"time {k}": 10.0 for k in range(5)} | {f"intensity {k}": n for k, n in enumerate((20.0, 15.0, 10.0, 5.0))}


def candidates(spark, sf):
    """One candidate a line item (repeated numbers once): year of shipping, five episodes, four types, a tenth uncertain, twenty facts."""
    l = table(spark, sf, "lineitem")
    number = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    status = F.when(F.col("l_partkey") % 10 == 0, "uncertain").otherwise("known")
    marks = F.array(F.concat(F.lit("time "), F.floor(F.col("l_quantity") / 10.2).cast("long").cast("string")), F.concat(F.lit("intensity "), (F.col("l_orderkey") % 4).cast("string")))
    rows = l.select(F.year(F.col("l_shipdate").cast("timestamp")).cast("long").alias("batch"), number.alias("id"), (F.col("l_suppkey") % 5).cast("string").alias("episode"), F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("l_partkey") % 7 % 4 + 1).cast("int")).alias("type"), status.alias("status"), (F.col("l_partkey") % 20).cast("string").alias("fact"), marks.alias("marks"))
    return rows.groupBy("batch", "id").agg(F.min(F.struct("episode", "type", "status", "fact", "marks")).alias("m")).select("batch", "id", "m.*", F.lit(0.0).alias("cost"))


def selected(spark, sf):
    return quotas.quota_selection(candidates(spark, sf), QUOTAS, TARGETS, dict.fromkeys(TARGETS, 1.0), 10, {"known": (7, 9), "uncertain": (1, 3)}, 4)


@query()
def quota_batches(spark, sf):
    """Fifty candidates of each year: exact quotas of type and status, ten an episode, a fact once."""
    return selected(spark, sf)[0]


@query()
def quota_marginals(spark, sf):
    """How far the soft marginals of each year's selection are from their targets."""
    return selected(spark, sf)[1].select("batch", "mark", F.round("target", 6).alias("target"), F.col("actual").cast("long").alias("actual"), F.round(F.abs(F.col("actual") - F.col("target")), 6).alias("off"))


@query(""", d AS (SELECT source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY ALL), p AS (SELECT source, lang, n, range AS position FROM d CROSS JOIN range(4))
SELECT source, lang, n, min(n // 4) AS least, max((n + 3) // 4) AS most FROM p GROUP BY ALL""")
def position_bounds(spark, sf):
    """Answer positions of documents as questions, a source a batch: least and most uses of a position in each language, as counted; the bounds say that these are the quotients rounded down and up."""
    docs = table(spark, sf, "documents").where("source is not null").select(F.col("source").alias("batch"), F.col("doc_id").alias("id"), "lang", (F.col("n_chars") % 2).alias("status"), (F.col("n_chars") % 13).alias("episode"))
    found = quotas.balanced_positions(docs, ["lang", "status"], ["episode"])
    each = found.groupBy("batch", "lang").agg(F.count("*").alias("n"), *[F.count_if(F.col("position") == p).alias(f"p{p}") for p in range(4)])
    low, high = F.floor(F.col("n") / 4), F.ceil(F.col("n") / 4)
    # a position's count lies at either bound; both are reached unless they are one
    least, most = F.least(*[f"p{p}" for p in range(4)]), F.greatest(*[f"p{p}" for p in range(4)])
    return each.select(F.col("batch").alias("source"), "lang", "n", F.when(least >= low, low).otherwise(least).alias("least"), F.when(most <= high, high).otherwise(most).alias("most"))
