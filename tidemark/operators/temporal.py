"""Ordered events and frames: gaps, islands, pairs, as-of lookups, prefixes, windows and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def over(key: str, *order: str):
    return W.partitionBy(key).orderBy(*order)


def gaps(events: DataFrame, key: str, t: str, tie: str) -> DataFrame:
    """Each event with the time to the next of its key."""
    return events.withColumn("gap", F.lead(t).over(over(key, t, tie)) - F.col(t))


def islands(events: DataFrame, key: str, order: list[str], on: Column) -> DataFrame:
    """Maximal runs of rows where `on` holds: (key, run, first, last row numbers, length)."""
    w = over(key, *order)
    numbered = events.withColumn("_n", F.row_number().over(w)).where(on)
    runs = numbered.withColumn("_g", F.col("_n") - F.row_number().over(w))
    return runs.groupBy(key, "_g").agg(F.min("_n").cast("long").alias("first"), F.max("_n").cast("long").alias("last"), F.count("*").alias("length")).drop("_g")


def eroded(runs: DataFrame, margin: int, least: int) -> DataFrame:
    """Runs shrunk at both ends, those still long enough."""
    out = runs.withColumn("first", F.col("first") + margin).withColumn("last", F.col("last") - margin)
    return out.withColumn("length", F.col("last") - F.col("first") + 1).where(F.col("length") >= least)


def longest_run(runs: DataFrame, key: str) -> DataFrame:
    return runs.groupBy(key).agg(F.max("length").alias("longest"))


def coalesced_spans(events: DataFrame, key: str, t: str, tie: str, most: float) -> DataFrame:
    """Spans of rows no more than `most` apart."""
    w = over(key, t, tie)
    fresh = F.when(F.col(t) - F.lag(t).over(w) <= most, 0).otherwise(1)
    spans = events.withColumn("_new", fresh).withColumn("span", F.sum("_new").over(w))
    return spans.groupBy(key, "span").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("n"))


def ordered_pairs(events: DataFrame, key: str, order: list[str], first: Column, second: Column, value: str) -> DataFrame:
    """A `first` row and the `second` row right after it, of the rows of either kind."""
    w = over(key, *order)
    rows = events.where(first | second).withColumn("_was", F.lag(F.when(first, F.col(value))).over(w))
    return rows.where(second & F.col("_was").isNotNull()).select(key, F.col("_was").alias("from"), F.col(value).alias("to"))


def latest_pairs(events: DataFrame, key: str, t: str, tie: str, first: Column, second: Column) -> DataFrame:
    """The last row of each kind for keys that have both."""
    last = lambda on: F.max_by(t, F.when(on, F.struct(t, tie)))
    return events.groupBy(key).agg(last(first).alias("from"), last(second).alias("to")).dropna()


def as_of(events: DataFrame, key: str, order: list[str], asks: Column, gives: Column, value: str, name: str) -> DataFrame:
    """Rows that ask, with the value of the last row before that gives one."""
    w = over(key, *order).rowsBetween(W.unboundedPreceding, -1)
    return events.withColumn(name, F.last(F.when(gives, F.col(value)), ignorenulls=True).over(w)).where(asks)


def blackout(asks: DataFrame, others: DataFrame, key: str, t: str, within: float) -> DataFrame:
    """Rows with no other event of the key within a distance. The distance buckets time, so the join has an equal key."""
    own = asks.withColumn("_b", F.explode(F.array(*[F.floor(F.col(t) / within) + k for k in (-1, 0, 1)])))
    near = others.select(F.col(key).alias("_k"), F.col(t).alias("_t"), F.floor(F.col(t) / within).alias("_c"))
    hit = own.join(near, (own[key] == near["_k"]) & (own["_b"] == near["_c"]) & (F.abs(own[t] - near["_t"]) <= within))
    return asks.join(hit.select(asks.columns[0]).distinct(), asks.columns[0], "left_anti")


def prefix_counts(asks: DataFrame, events: DataFrame, key: str, ask_t: str, t: str) -> DataFrame:
    """How many events of the key are at or before each asked time: one pass over both, no range join."""
    rows = asks.select(key, F.col(ask_t).alias("_t"), F.lit(1).alias("_ask"), *[c for c in asks.columns if c not in (key, ask_t)]).unionByName(events.select(key, F.col(t).alias("_t"), F.lit(0).alias("_ask")), allowMissingColumns=True)
    seen = F.sum(1 - F.col("_ask")).over(W.partitionBy(key).orderBy("_t", "_ask").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("seen", seen).where("_ask = 1").withColumnRenamed("_t", ask_t).drop("_ask")


def last_n(events: DataFrame, key: str, order: list[str], n: int, value: str) -> DataFrame:
    """Each row with the last n values up to it, how many came and how many are gone."""
    w = over(key, *order)
    seen = F.row_number().over(w).cast("long")
    return events.withColumn("kept", F.collect_list(value).over(w.rowsBetween(-(n - 1), 0))).withColumn("seen", seen).withColumn("evicted", F.greatest(seen - n, F.lit(0)))


def interval_hits(points: DataFrame, spans: DataFrame, key: str, t: str, width: float) -> DataFrame:
    """Points within spans [start, end] of the same key. Spans are spread over buckets of `width`, so the join has equal keys."""
    cells = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    own = points.withColumn("_b", F.floor(F.col(t) / width))
    return own.join(cells, [key, "_b"]).where(F.col(t).between(F.col("start"), F.col("end"))).drop("_b")


def inside_gaps(segments: DataFrame, visits: DataFrame, key: str) -> DataFrame:
    """What lies wholly between a visit's end and the next one's start; on the border of two such spaces, what has no length lies in the later.

    Spaces don't overlap, so a segment can only lie in the last one that begins by its start: one window over both sides, in the order of time.
    """
    w = over(key, "start", "end")
    spaces = visits.withColumn("until", F.lead("start").over(w)).select(key, F.col("end").alias("since"), "until").where("until >= since")
    names = [c for c in segments.columns if c != key]
    none = F.lit(None).cast(segments.select(F.struct(*names).alias("s")).schema["s"].dataType)
    both = segments.select(key, F.col("start").alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast(spaces.schema["until"].dataType).alias("_u"), F.struct(*names).alias("_s"))
    both = both.unionByName(spaces.select(key, F.col("since").alias("_t"), F.lit(0).alias("_k"), F.col("until").alias("_u"), none.alias("_s")))
    space = F.when(F.col("_k") == 0, F.struct(F.col("_t").alias("since"), F.col("_u").alias("until")))
    held = F.last(space, True).over(W.partitionBy(key).orderBy("_t", "_k", "_u").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("_h", held).where((F.col("_k") == 1) & (F.col("_s.end") <= F.col("_h.until"))).select(key, "_s.*", "_h.since", "_h.until")


def confirmed_changes(rows: DataFrame, key: str, order: list[str], state: str, value: str) -> DataFrame:
    """Changes of a state that two rows in a row confirm."""
    w = over(key, *order)
    sure = rows.withColumn("_before", F.lag(state).over(w)).where(F.col("_before") == F.col(state))
    changed = sure.withColumn("was", F.lag(state).over(w))
    return changed.where(F.col("was") != F.col(state)).select(key, value, "was", F.col(state).alias("now"))


def decided_order(events: DataFrame, key: str, t: str, a: Column, b: Column) -> DataFrame:
    """Per key: first times of two kinds and which came first."""
    first = events.groupBy(key).agg(F.min(F.when(a, F.col(t))).alias("first_a"), F.min(F.when(b, F.col(t))).alias("first_b"))
    return first.withColumn("order", F.when(F.col("first_a") < F.col("first_b"), "a").when(F.col("first_b") < F.col("first_a"), "b").otherwise("undecided"))


def last_two(events: DataFrame, key: str, t: str, tie: str, on: Column) -> DataFrame:
    w = W.partitionBy(key).orderBy(F.desc(t), F.desc(tie))
    return events.where(on).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 2")


def visit_clock(visits: DataFrame, key: str, order: list[str], frames: Column, blank: int) -> DataFrame:
    """Chronological number and output clock: frames of the visits before, and a blank after each."""
    w = over(key, *order)
    return visits.withColumn("visit", F.row_number().over(w).cast("long")).withColumn("frames", frames).withColumn("output_start", F.sum(F.col("frames") + blank).over(w) - F.col("frames") - blank)


def running_ids(rows: DataFrame, key: str, order: list[str], base: Column) -> DataFrame:
    return rows.withColumn("number", base + F.row_number().over(over(key, *order)))


def group_changes(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Number of the stretch of equal values that each row is in."""
    w = over(key, *order)
    return rows.withColumn("stretch", F.sum(F.when(F.col(value) == F.lag(value).over(w), 0).otherwise(1)).over(w))


def change_intensity(asks: DataFrame, events: DataFrame, key: str, ask_t: str, t: str) -> DataFrame:
    return prefix_counts(asks, events, key, ask_t, t).withColumn("intensity", F.greatest(F.lit(1).cast("long"), "seen"))


def unwrapped(rows: DataFrame, key: str, order: list[str], angle: str) -> DataFrame:
    """Angles made continuous: the first, then sums of the shortest turns."""
    w = over(key, *order)
    turn = F.pmod(F.col(angle) - F.lag(angle).over(w) + 180, F.lit(360)) - 180
    return rows.withColumn("unwrapped", F.sum(F.coalesce(turn, F.col(angle))).over(w))


def path_length(rows: DataFrame, key: str, order: list[str], x: str, y: str) -> DataFrame:
    """Length walked up to each point."""
    w = over(key, *order)
    step = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))
    return rows.withColumn("walked", F.sum(F.coalesce(step, F.lit(0.0))).over(w))


def aligned_clock(rows: DataFrame, key: str, order: list[str], frame: str) -> DataFrame:
    """Epoch of each row: how often its frame number has fallen."""
    w = over(key, *order)
    return rows.withColumn("epoch", F.sum(F.when(F.col(frame) < F.lag(frame).over(w), 1).otherwise(0)).over(w))


def retimed(events: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """The last frame before an event's start and the first after its end: an event asks twice, and one window over asks and frames answers, in the order of time."""
    names = [c for c in events.columns if c != key]
    kind = events.select(F.struct(*names).alias("e")).schema["e"].dataType
    ask = lambda t, side: events.select(key, F.col(t).cast("double").alias("_t"), F.lit(side).alias("_k"), F.struct(*names).alias("_e"), F.lit(None).cast(frames.schema["t"].dataType).alias("_f"))
    rows = frames.select(key, F.col("t").cast("double").alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast(kind).alias("_e"), F.col("t").alias("_f"))
    both = ask("start", 0).unionByName(rows).unionByName(ask("end", 2))  # at one time: starts, frames, ends
    w = W.partitionBy(key).orderBy("_t", "_k")
    both = both.withColumn("_b", F.last("_f", True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_a", F.first("_f", True).over(w.rowsBetween(0, W.unboundedFollowing)))
    out = both.where("_k <> 1").groupBy(key, "_e").agg(F.max(F.when(F.col("_k") == 0, F.col("_b"))).alias("before"), F.min(F.when(F.col("_k") == 2, F.col("_a"))).alias("after"))
    return out.select(key, "_e.*", "before", "after")
