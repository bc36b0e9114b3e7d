"""Question types dealt to episodes: exact quotas of each batch, episodes of nearly equal length, every type in every episode.

Each type is dealt to all episodes of its batch as often as its quota allows; what is left of it goes to episodes in a fixed circle, where the type
before stopped. So a type's counts differ by one at most between episodes, and so do the episodes' lengths: whenever the bounds can be met at all, they are.
An episode's place in the circle is its rank by hash, found range by range, and its types follow from that place alone.

Defined results: episodes without batch or id are ignored, repeated ones count once; quotas without batch, type or number are ignored, those of a type
repeated add up, those of a batch without episodes give nothing; a batch without quotas, or whose quotas don't fit the bounds, is an error; no episodes give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.running import cumulated
from tidemark.sources.tables import checkpointed


def episode_types(episodes: DataFrame, quotas: DataFrame, low: int = 10, high: int = 12, least: int = 1, most: int = 3, seed: int = 0) -> DataFrame:
    """(batch, episode, position from 1, type) of episodes (batch, episode) and quotas (batch, type, quota).

    An episode gets low to high questions, each type least to most times, in an order drawn from seed, batch and episode.
    """
    drawn = lambda *more: F.sha2(F.concat_ws(" ", F.lit(str(seed)), *[F.col(c).cast("string") for c in ("batch", "episode")], *more), 256)
    own = episodes.where("batch is not null and episode is not null").select("batch", "episode").distinct().withColumn("draw", drawn())
    placed = cumulated(own, [F.col("batch"), F.col("draw"), F.col("episode")], place=F.lit(1))
    sizes = placed.groupBy("batch").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    wanted = quotas.where("batch is not null and type is not null and quota is not null").groupBy("batch", "type").agg(F.sum("quota").cast("long").alias("quota"))
    wanted = wanted.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("type", "quota"))).alias("types"))
    n, total = F.col("n"), F.aggregate("types", F.lit(0).cast("long"), lambda a, t: a + t.quota)
    fault = (
        F.when(F.col("types").isNull(), F.lit("there are no quotas"))
        .when((total < low * n) | (total > high * n), F.format_string(f"%d questions for %d episodes of {low} to {high}", total, n))
        .when(F.exists("types", lambda t: (t.quota < least * n) | (t.quota > most * n)), F.format_string(f"a type cannot be {least} to {most} times in each of %d episodes", n))
    )
    rest = lambda t: t.quota % F.col("n")
    before = lambda k: F.aggregate(F.slice("types", F.lit(1), k), F.lit(0).cast("long"), lambda a, t: a + rest(t))
    circle = F.transform("types", lambda t, k: F.struct(t.type.alias("type"), F.floor(t.quota / F.col("n")).cast("long").alias("each"), rest(t).alias("more"), before(k).alias("start")))
    plan = F.when(fault.isNull(), circle).otherwise(F.raise_error(F.concat(F.lit("batch "), F.col("batch").cast("string"), F.lit(": "), fault)))
    plans = sizes.join(wanted, "batch", "left").select("batch", "n", "first", plan.alias("plan"))
    plans = checkpointed(plans)  # of a known size: where batches are few, it is sent to all tasks, and their episodes stay spread
    at = F.col("place") - F.col("first")
    times = lambda t: t.each + F.when(F.pmod(at - t.start, F.col("n")) < t.more, 1).otherwise(0)
    copies = F.flatten(F.transform("plan", lambda t: F.transform(F.filter(F.sequence(F.lit(0).cast("long"), times(t)), lambda c: c < times(t)), lambda c: F.struct(drawn(t.type.cast("string"), c.cast("string")).alias("draw"), t.type.alias("type")))))
    return placed.join(plans, "batch").select("batch", "episode", F.posexplode(F.array_sort(copies)).alias("k", "slot")).select("batch", "episode", (F.col("k") + 1).cast("long").alias("position"), "slot.type")
