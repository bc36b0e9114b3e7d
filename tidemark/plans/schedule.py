"""Queries that deal question types to episodes: orders are episodes, those of a priority a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.schedule import episode_types
from tidemark.plans.registry import registry
from tidemark.sources.tables import table

QUERIES, ORACLES, query = registry()

TYPES = ["action", "count", "duration", "order", "place", "state"]
DEALT = f"""WITH e AS (SELECT DISTINCT o_orderpriority AS batch, o_orderkey AS episode FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderkey IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY sha256('7 ' || batch || ' ' || episode), episode) - 1 AS place, count(*) OVER (PARTITION BY batch) AS n FROM e),
q AS (SELECT batch, n, type, 2 * n - n // (k + 3) AS quota FROM (SELECT DISTINCT batch, n FROM r), (VALUES {", ".join(f"('{t}', {k})" for k, t in enumerate(TYPES))}) t(type, k)),
o AS (SELECT *, coalesce(sum(quota % n) OVER (PARTITION BY batch ORDER BY type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM q),
c AS (SELECT r.batch, r.episode, o.type, o.quota // o.n + CASE WHEN ((r.place - o.start) % o.n + o.n) % o.n < o.quota % o.n THEN 1 ELSE 0 END AS times FROM r JOIN o USING (batch)),
x AS (SELECT batch, episode, type, unnest(range(times::BIGINT)) AS copy FROM c)
"""


def dealt(spark, sf):
    """Each order's types; the quota of type k is twice the orders of the priority, less one in k + 3."""
    episodes = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("batch"), F.col("o_orderkey").alias("episode"))
    sizes = episodes.where("batch is not null and episode is not null").groupBy("batch").agg(F.count_distinct("episode").alias("n"))
    quotas = sizes.select("batch", "n", F.posexplode(F.array(*[F.lit(t) for t in TYPES])).alias("k", "type")).select("batch", "type", (2 * F.col("n") - F.floor(F.col("n") / (F.col("k") + 3))).cast("long").alias("quota"))
    return episode_types(episodes, quotas, seed=7)


@query(DEALT + "SELECT batch, episode, row_number() OVER (PARTITION BY batch, episode ORDER BY sha256('7 ' || batch || ' ' || episode || ' ' || type || ' ' || copy), type) AS position, type FROM x")
def episode_type_schedule(spark, sf):
    """Types of all orders, in their positions."""
    return dealt(spark, sf)


@query(DEALT + """, y AS (SELECT batch, episode, type, count(*) AS times FROM x GROUP BY ALL), z AS (SELECT batch, episode, sum(times) AS questions FROM y GROUP BY ALL)
SELECT batch, type, sum(times)::BIGINT AS total, min(times) AS fewest, max(times) AS most, min(questions)::BIGINT AS shortest, max(questions)::BIGINT AS longest FROM y JOIN z USING (batch, episode) GROUP BY ALL""")
def episode_type_balance(spark, sf):
    """For each priority and type, its total, its least and most in an order, and the lengths of orders."""
    times = dealt(spark, sf).groupBy("batch", "episode", "type").agg(F.count("*").alias("times"))
    whole = times.groupBy("batch", "episode").agg(F.sum("times").alias("questions"), F.collect_list(F.struct("type", "times")).alias("own")).select("batch", "questions", F.inline("own"))
    return whole.groupBy("batch", "type").agg(F.sum("times").alias("total"), F.min("times").alias("fewest"), F.max("times").alias("most"), F.min("questions").alias("shortest"), F.max("questions").alias("longest"))
