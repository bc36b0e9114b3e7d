"""Scene graphs (nodes and edges), actors and programs of events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def supports(edges: DataFrame, nodes: DataFrame, surface: str = "SURFACES") -> DataFrame:
    """(node, support): what each node lies on, if that is a surface."""
    return edges.where("relation = 'ON'").join(nodes.where(F.array_contains("properties", surface)).select(F.col("id").alias("to_id")), "to_id").select(F.col("from_id").alias("node"), F.col("to_id").alias("support"))


def in_closed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes inside something closed."""
    closed = nodes.where(F.array_contains("states", "CLOSED")).select(F.col("id").alias("to_id"))
    return edges.where("relation = 'INSIDE'").join(closed, "to_id", "left_semi").select(F.col("from_id").alias("node")).distinct()


def capabilities(nodes: DataFrame, by: str) -> DataFrame:
    """Per room: counts of closed things that open, switches that are off, and surfaces."""
    has = lambda c, v: F.array_contains(c, v)
    return nodes.groupBy(by).agg(
        F.count_if(has("properties", "CAN_OPEN") & has("states", "CLOSED")).alias("closed"), F.count_if(has("properties", "HAS_SWITCH") & has("states", "OFF")).alias("off"), F.count_if(has("properties", "SURFACES")).alias("surfaces"), F.count("*").alias("n")
    )


def near_pairs(actors: DataFrame, frame: str, name: str, x: str, y: str, least: float) -> DataFrame:
    """Pairs of actors in a frame closer than allowed. Frames are the equal key; actors in a frame are few."""
    a = actors.select(frame, F.col(name).alias("a"), F.col(x).alias("ax"), F.col(y).alias("ay"))
    b = actors.select(frame, F.col(name).alias("b"), F.col(x).alias("bx"), F.col(y).alias("by"))
    return a.join(b, frame).where("a < b").withColumn("distance", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))).where(F.col("distance") < least).select(frame, "a", "b", F.round("distance", 4).alias("distance"))


def matched_nodes(before: DataFrame, after: DataFrame, kind: str, x: str, within: float = 0.15) -> DataFrame:
    """Added nodes with those of their class within a distance: how many there are, and the smallest.

    Nodes of a class in one place are one row with their number and smallest id. A node's reach ends in two stretches of a class as wide as the distance and covers those between, so it needs running counts and
    minima from either end of a stretch, and no pairs. Nodes without class or a finite place match nothing.
    """

    def bounds(x: pd.Series) -> pd.DataFrame:
        """The farthest numbers whose difference, as computed, is within the distance."""
        out = {}
        for name, way in (("low", -1), ("high", 1)):
            v = x.to_numpy(float)
            inside, outside = v.copy(), v + way * 2 * within
            while True:  # halved until no number lies between
                at = inside + (outside - inside) / 2
                if not ((at != inside) & (at != outside)).any():
                    break
                met = np.abs(v - at) <= within
                inside, outside = np.where(met, at, inside), np.where(met, outside, at)
            out[name] = inside
        return pd.DataFrame(out)

    reach = F.pandas_udf(bounds, "low double, high double")
    real = lambda rows: rows.select(F.col(kind).alias("_k"), F.col(x).cast("double").alias("_x"), "id").where("_k is not null and abs(_x) < double('inf')")
    block, none = lambda c: F.floor(F.col(c) / within), F.lit(None)
    own = real(after).groupBy("_k", "_x").agg(F.count("*").alias("n"), F.min("id").alias("found"))
    own = own.select("_k", block("_x").alias("_b"), F.col("_x").alias("at"), F.lit(0).alias("role"), none.cast("double").alias("_x"), "n", "found")
    asked = real(before).select("_k", "_x").distinct().withColumn("r", reach("_x")).select("_k", "_x", "r.*").withColumn("first", block("low")).withColumn("last", block("high"))
    asked = asked.select("*", F.explode(F.sequence("first", "last")).alias("_b"))
    rest = ["_x", F.lit(0).cast("long").alias("n"), none.cast(after.schema["id"].dataType).alias("found")]
    parts = []
    for rows, at, order in (
        (asked.where("_b = first and first < last"), F.col("low"), F.desc("at")),
        (asked.where("_b > first or first = last"), F.when(F.col("_b") < F.col("last"), F.lit(float("inf"))).otherwise(F.col("high")), F.asc("at")),
    ):
        rows = own.unionByName(rows.select("_k", "_b", at.alias("at"), F.lit(1).alias("role"), *rest))
        w = W.partitionBy("_k", "_b").orderBy(order, "role").rowsBetween(W.unboundedPreceding, 0)
        parts.append(rows.select("_k", "_x", "role", F.sum("n").over(w).alias("n"), F.min("found").over(w).alias("found")).where("role = 1"))
    hit = parts[0].unionByName(parts[1]).groupBy("_k", "_x").agg(F.sum("n").alias("n"), F.min("found").alias("found")).where("n > 0")
    return real(before).join(hit, ["_k", "_x"]).groupBy("id").agg(F.sum("n").alias("matches"), F.min("found").alias("found"))


def dependencies_met(program: DataFrame, key: str, order: str, needs: str, name: str) -> DataFrame:
    """Events whose needed event doesn't come before them."""
    done = program.select(F.col(key).alias("_k"), F.col(name).alias("_n"), F.col(order).alias("_o"))
    return program.where(F.col(needs).isNotNull()).join(done, (F.col(key) == F.col("_k")) & (F.col(needs) == F.col("_n")) & (F.col("_o") < F.col(order)), "left_anti")


def state_legal(events: DataFrame, key: list[str], order: list[str], before: str, after: str) -> DataFrame:
    """Events whose state before isn't the state the last event of the object left."""
    w = W.partitionBy(*key).orderBy(*order)
    return events.withColumn("left", F.lag(after).over(w)).where(F.col("left").isNotNull() & (F.col("left") != F.col(before)))


def hands(events: DataFrame, key: str, order: list[str], takes: Column, puts: Column) -> DataFrame:
    """Running count of things held, with the least and most and what is left at the end."""
    held = F.sum(F.when(takes, 1).when(puts, -1).otherwise(0)).over(W.partitionBy(key).orderBy(*order))
    return events.withColumn("_h", held).withColumn("_last", F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(o) for o in order])) == 1).groupBy(key).agg(F.min("_h").alias("least"), F.max("_h").alias("most"), F.max(F.when(F.col("_last"), F.col("_h"))).alias("end"))


def spacing(events: DataFrame, key: str, t: str, tie: str, target: float, tolerance: float) -> DataFrame:
    """Gaps that are off the target by more than the tolerance."""
    gap = F.lead(t).over(W.partitionBy(key).orderBy(t, tie)) - F.col(t)
    return events.withColumn("gap", gap).where(F.abs(F.col("gap") - target) > tolerance)


def observer_commands(script: DataFrame, allowed: list[str]) -> DataFrame:
    """Commands of rows such as `<char0> [walk] <a> | <char1> [grab] <b>`: (row, actor, verb), with what breaks the rules."""
    each = script.select("row", F.explode(F.split("text", r"\|")).alias("c")).select("row", F.regexp_extract("c", r"<char(\d+)>", 1).cast("long").alias("actor"), F.lower(F.regexp_extract("c", r"\[(\w+)\]", 1)).alias("verb"))
    many = F.count("*").over(W.partitionBy("row", "actor"))
    return each.withColumn("fault", F.when(many > 1, "two commands").when((F.col("actor") == 0) & ~F.col("verb").isin(allowed), "not allowed"))


def contained(visits: DataFrame, segments: DataFrame, key: str, width: float) -> DataFrame:
    """Each visit with the first segment that holds all of it. Segments are spread over buckets of `width`, so a visit meets those that hold its start only."""
    s = segments.select(key, F.col("seq").alias("segment"), F.col("start").alias("_a"), F.col("end").alias("_b")).where("_a <= _b").withColumn("_c", F.explode(F.sequence(F.floor(F.col("_a") / width), F.floor(F.col("_b") / width))))
    return visits.withColumn("_c", F.floor(F.col("start") / width)).join(s, [key, "_c"]).where("start >= _a and end <= _b").groupBy("seq").agg(F.min("segment").alias("segment"))


def order_pairs(events: DataFrame, key: str, name: str, t: str, least: float) -> DataFrame:
    """Unordered pairs of an episode's things whose first times are far enough apart, with which came first."""
    first = events.groupBy(key, name).agg(F.min(t).alias("t"))
    a, b = first.select(key, F.col(name).alias("x"), F.col("t").alias("tx")), first.select(key, F.col(name).alias("y"), F.col("t").alias("ty"))
    return a.join(b, key).where("x < y").where(F.abs(F.col("tx") - F.col("ty")) >= least).select(key, "x", "y", F.when(F.col("tx") < F.col("ty"), F.col("x")).otherwise(F.col("y")).alias("first"))


def attempts(rows: DataFrame, key: str, state: str, order: str) -> DataFrame:
    """Latest state, tries and whether any was accepted."""
    return rows.groupBy(key).agg(F.max_by(state, order).alias("latest"), F.count("*").alias("tries"), F.bool_or(F.col(state) == "accepted").alias("accepted"))
