"""Samples, quotas, balancing and orders that are exact and repeatable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.tables import checkpointed


def hash_ranked(rows: DataFrame, strata: list[str], salt: str) -> DataFrame:
    """Place of each row in its stratum by the hash of `salt:id`."""
    h = F.sha2(F.concat(F.lit(salt + ":"), F.col("id").cast("string")), 256)
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*strata).orderBy(h)).cast("long"))


def stratified(rows: DataFrame, strata: list[str], share: float, salt: str = "iaa") -> DataFrame:
    """max(1, round half even of n * share) rows of each stratum."""
    sizes = rows.groupBy(*strata).agg(F.greatest(F.lit(1), F.bround(F.count("*") * F.lit(share))).cast("long").alias("quota"))
    return hash_ranked(rows, strata, salt).join(sizes, strata).where("place <= quota")


def balanced_bins(rows: DataFrame, width: float, salt: str = "bin") -> DataFrame:
    """As many known as uncertain rows of each bin of query time."""
    binned = rows.withColumn("bin", F.floor(F.col("query_time") / width))
    sizes = binned.groupBy("bin").agg(F.least(F.count_if("known"), F.count_if(~F.col("known"))).alias("quota"))
    return hash_ranked(binned, ["bin", "known"], salt).join(sizes, "bin").where("place <= quota")


def audit_sample(rows: DataFrame, agrees: Column, share: float, salt: str = "audit") -> DataFrame:
    """All disagreements and a rounded share of agreements."""
    own = rows.withColumn("agrees", agrees)
    n = F.bround(F.count("*").over(W.partitionBy("agrees")) * F.lit(share))
    return hash_ranked(own, ["agrees"], salt).withColumn("_n", n).where("not agrees or place <= _n").drop("_n")


def largest_remainder(groups: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Apportions a total by weights: whole parts, then the rest by remainder, weight and key, all descending. One row a group."""
    exact = F.lit(total) * F.col(weight) / F.sum(weight).over(W.partitionBy())
    parts = groups.withColumn("_e", exact).withColumn("_f", F.floor("_e")).withColumn("_left", F.lit(total) - F.sum("_f").over(W.partitionBy()))
    rank = F.row_number().over(W.orderBy(F.desc(F.round(F.col("_e") - F.col("_f"), 9)), F.desc(weight), F.desc(key)))
    return parts.select(key, (F.col("_f") + F.when(rank <= F.col("_left"), 1).otherwise(0)).cast("long").alias("quota"))


def round_robin_chunks(rows: DataFrame, key: str, chunks: int) -> DataFrame:
    """Groups dealt out in order: group number modulo chunks. Groups are numbered on their own, one row each."""
    numbers = rows.select(key).distinct().withColumn("chunk", F.pmod(F.row_number().over(W.orderBy(key)) - 1, F.lit(chunks)).cast("long"))
    return rows.join(numbers, key)


def interleaved(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """First rows of all groups, then second rows, and so on: adds turn."""
    return rows.withColumn("turn", F.row_number().over(W.partitionBy(key).orderBy(*order)).cast("long"))


def spread_indices(total: Column, chosen: Column) -> Column:
    """floor((i + 1/2) * total / chosen) for each i."""
    return F.transform(F.sequence(F.lit(0), chosen - 1), lambda i: F.floor((i + 0.5) * total / chosen))


def near_partition(total: Column, parts: Column) -> Column:
    """Sizes that differ by one at most, the larger ones spread evenly."""
    cut = lambda i: F.floor(i * total / parts)
    return F.transform(F.sequence(F.lit(1), parts), lambda i: (cut(i) - cut(i - 1)).cast("long"))


def best_by(rows: DataFrame, key: str, choice: str, *score: Column) -> DataFrame:
    """Per key, the choice of the largest score."""
    return rows.groupBy(key).agg(F.max_by(choice, F.struct(*score, F.col(choice))).alias(choice))


def greedy_cover(rows: DataFrame, key: str, cell: str, most: int) -> DataFrame:
    """Groups chosen one by one, each for the most cells that none before has; ties by name. Order matters, so the driver asks for one group a turn."""
    cells = checkpointed(rows.select(key, cell).distinct())
    chosen: list[tuple] = []
    left = cells
    for turn in range(most):
        best = left.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(1).first()
        if best is None:
            break
        chosen.append((best[key], turn + 1, best["n"]))
        covered = cells.where(F.col(key) == best[key]).select(cell)
        left = checkpointed(left.join(covered, cell, "left_anti"))
    return rows.sparkSession.createDataFrame(chosen, f"{key} {dict(rows.dtypes)[key]}, turn long, gained long")


def folded(rows: DataFrame, key: str, order: list[str], schema: str, fold: Callable) -> DataFrame:
    """A sequential choice in each group: fold(list of rows in order) gives rows. For rules in which every step depends on the last."""

    def run(part):
        import pandas as pd

        out = fold(part.sort_values(order).to_dict("records"))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return rows.groupBy(key).applyInPandas(run, schema)


def packed_visits(budget: float, most: int):
    """Takes visits in order while they fit the budget; the last one is cut short if three seconds of it fit."""

    def fold(rows: list[dict]) -> list[dict]:
        left, out = budget, []
        for r in rows:
            size = r["end"] - r["start"]
            if len(out) == most or left < 3:
                break
            if size < 3:
                continue
            size = min(size, left)
            out.append({**r, "end": r["start"] + size})
            left -= size
        return out

    return fold


def capped_cycle(most_per_episode: int, need: int):
    """Cycles over answers, each in hash order, with a cap on episodes."""

    def fold(rows: list[dict]) -> list[dict]:
        pools: dict = {}
        for r in rows:
            pools.setdefault(r["answer"], []).append(r)
        used: dict = {}
        out: list[dict] = []
        while len(out) < need and any(pools.values()):
            for answer in sorted(pools):
                while pools[answer]:
                    r = pools[answer].pop(0)
                    if used.get(r["episode_id"], 0) < most_per_episode:
                        used[r["episode_id"]] = used.get(r["episode_id"], 0) + 1
                        out.append(r)
                        break
                if len(out) == need:
                    break
        return out

    return fold


def balanced_positions(rows: DataFrame, strata: list[str], options: int) -> DataFrame:
    """Answer positions by the row's place in its stratum: each position as often as any other, within one."""
    return rows.withColumn("position", F.pmod(F.row_number().over(W.partitionBy(*strata).orderBy("id")) - 1, F.lit(options)).cast("long"))
