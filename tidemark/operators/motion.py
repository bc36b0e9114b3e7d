"""Metrics of positions, cameras and masks, by window functions over frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def speeds(rows: DataFrame, key: str, frame: str, x: str, z: str, fps: float) -> DataFrame:
    """Speed over a quarter second to either side, cut at the ends."""
    w, r = W.partitionBy(key).orderBy(frame), max(1, round(fps * 0.25))
    n, last = F.row_number().over(w) - 1, F.count("*").over(W.partitionBy(key)) - 1
    near = w.rowsBetween(-r, r)
    dx, dz = F.last(x).over(near) - F.first(x).over(near), F.last(z).over(near) - F.first(z).over(near)
    elapsed = F.greatest((F.least(n + r, last) - F.greatest(n - r, F.lit(0))) / fps, F.lit(1 / fps))
    return rows.withColumn("speed", F.hypot(dx, dz) / elapsed)


def movement(rows: DataFrame, key: str, frame: str, fps: float, least: float = 0.15) -> DataFrame:
    """Share of moving frames, stationary seconds and the longest stationary stretch."""
    w = W.partitionBy(key).orderBy(frame)
    still = rows.withColumn("_s", F.col("speed") < least).withColumn("_n", F.row_number().over(w))
    runs = still.where("_s").withColumn("_g", F.col("_n") - F.row_number().over(w)).groupBy(key, "_g").agg(F.count("*").alias("_l"))
    longest = runs.groupBy(key).agg(F.max("_l").alias("_l"))
    base = still.groupBy(key).agg(F.round(F.avg(F.when(F.col("_s"), 0.0).otherwise(1.0)), 6).alias("moving"), F.round(F.count_if("_s") / fps, 6).alias("stationary"))
    return base.join(longest, key, "left").select(key, "moving", "stationary", F.round(F.coalesce("_l", F.lit(0)) / fps, 6).alias("longest"))


def camera(rows: DataFrame, key: str, frame: str, xyz: list[str], fps: float) -> DataFrame:
    """Largest and 95th percentile of speed and of linear acceleration."""
    w = W.partitionBy(key).orderBy(frame)
    size = lambda parts: F.sqrt(sum((p * p for p in parts), F.lit(0.0)))
    step = [F.col(c) - F.lag(c).over(w) for c in xyz]
    bend = [F.col(c) - 2 * F.lag(c).over(w) + F.lag(c, 2).over(w) for c in xyz]
    out = rows.select(key, size(step).alias("s"), size(bend).alias("a"))
    p95 = lambda c: F.percentile(c, F.lit(0.95))
    return out.groupBy(key).agg(F.round(F.max("s") * fps, 4).alias("max_speed"), F.round(p95("s") * fps, 4).alias("p95_speed"), F.round(p95("a") * fps * fps, 4).alias("p95_acceleration"))


def rotation_step(a: list[Column], b: list[Column]) -> Column:
    """Degrees between two unit quaternions."""
    dot = F.abs(sum((p * q for p, q in zip(a, b, strict=True)), F.lit(0.0)))
    return F.degrees(2 * F.acos(F.least(F.greatest(dot, F.lit(0.0)), F.lit(1.0))))


def sign_flips(rows: DataFrame, key: str, frame: str, value: str) -> DataFrame:
    """How often the change of a value turns its sign; changes of 0 are passed over."""
    w = W.partitionBy(key).orderBy(frame)
    moved = rows.withColumn("_d", F.signum(F.col(value) - F.lag(value).over(w))).where("_d <> 0")
    return moved.withColumn("_b", F.lag("_d").over(w)).groupBy(key).agg(F.count_if(F.col("_b") != F.col("_d")).alias("flips"))


def visibility(rows: DataFrame, key: str, frame: str, pixels: str, least: int = 128) -> DataFrame:
    """Per object: visible frames, first of them (-1 without), frames in all."""
    seen = F.col(pixels) >= least
    return rows.groupBy(key).agg(F.count_if(seen).alias("visible_frames"), F.coalesce(F.min(F.when(seen, F.col(frame))), F.lit(-1)).cast("long").alias("first_frame"), F.count("*").alias("total_frames"))


def overlap(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    return F.greatest(F.least(a_high, b_high) - F.greatest(a_low, b_low), F.lit(0))


def box_iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Of boxes (x0, y0, x1, y1)."""
    both = overlap(a[0], a[2], b[0], b[2]) * overlap(a[1], a[3], b[1], b[3])
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return F.when(area(a) + area(b) - both > 0, both / (area(a) + area(b) - both)).otherwise(0.0)


def mask_passes(visible: Column, pixels: Column, width: Column, height: Column, edge: Column, centre: Column, least_pixels: int = 3000, least_side: int = 40, least_edge: int = 8, most_centre: float = 1.0, waiver: int | None = None, waiver_centre: float = 0.25) -> Column:
    """Enough pixels, sides, distance from the edge and nearness to the centre; large central masks may touch the edge."""
    base = visible & (pixels >= least_pixels) & (F.least(width, height) >= least_side) & (F.coalesce(centre, F.lit(float("inf"))) <= most_centre)
    at_edge = edge >= least_edge
    return base & (at_edge if waiver is None else at_edge | ((pixels >= waiver) & (centre <= waiver_centre)))


def observed(kind: Column, good_before: Column, seen_before: Column, good_after: Column, seen_after: Column) -> Column:
    return F.when(kind == "disappear", good_before & ~seen_after).when(kind == "appear", ~seen_before & good_after).otherwise(F.lit(False))


def interpolated(rows: DataFrame, keys: DataFrame, key: str, t: str, value: str, smooth: bool = False) -> DataFrame:
    """Values between keyframes: in a straight line, or with minimum jerk. One pass over both, ordered by time."""
    w = W.partitionBy(key).orderBy("_t", "_ask")
    both = rows.select(key, F.col(t).alias("_t"), F.lit(1).alias("_ask"), F.lit(None).cast("double").alias("_v")).unionByName(keys.select(key, F.col(t).alias("_t"), F.lit(0).alias("_ask"), F.col(value).cast("double").alias("_v")))
    back, on = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    at = F.when(F.col("_ask") == 0, F.col("_t"))
    both = both.withColumn("_t0", F.last(at, True).over(back)).withColumn("_v0", F.last("_v", True).over(back)).withColumn("_t1", F.first(at, True).over(on)).withColumn("_v1", F.first("_v", True).over(on))
    u = (F.col("_t") - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))
    u = u * u * u * (10 - 15 * u + 6 * u * u) if smooth else u
    mid = F.when(F.col("_t0").isNull(), F.col("_v1")).when(F.col("_t1").isNull() | (F.col("_t1") == F.col("_t0")), F.col("_v0")).otherwise(F.col("_v0") + (F.col("_v1") - F.col("_v0")) * u)
    return both.where("_ask = 1").select(key, F.col("_t").alias(t), mid.alias(value))


def points_at(path: DataFrame, asks: DataFrame, key: str, order: str, x: str, y: str) -> DataFrame:
    """Points of each polyline at distances along it, clamped to its length: per ask (key, distance) its x and y.

    Vertices closer than 1e-6 to the one before are passed over. Vertices and asks are sorted together, so no ask is compared with all vertices.
    """
    w = W.partitionBy(key).orderBy(order)
    step = lambda: F.coalesce(F.sqrt((F.col(x) - F.lag(x).over(w)) ** 2 + (F.col(y) - F.lag(y).over(w)) ** 2), F.lit(0.0))
    kept = path.withColumn("_s", step()).withColumn("_n", F.row_number().over(w)).where("_s > 1e-6 or _n = 1").drop("_n")
    placed = kept.withColumn("_s", step()).withColumn("_d", F.sum("_s").over(w))
    length = placed.groupBy(key).agg(F.max("_d").alias("_total"))
    bounded = asks.join(length, key).withColumn("_d", F.least(F.greatest(F.col("distance"), F.lit(0.0)), F.col("_total")))
    vertex = F.struct(F.col("_d").alias("d"), F.col(x).alias("x"), F.col(y).alias("y"))
    both = placed.select(key, "_d", F.lit(None).cast("double").alias("distance"), vertex.alias("_v")).unionByName(bounded.select(key, "_d", "distance", F.lit(None).cast("struct<d:double,x:double,y:double>").alias("_v")))
    down, up = W.partitionBy(key).orderBy("_d", F.col("_v").isNull()), W.partitionBy(key).orderBy(F.desc("_d"), F.col("_v").isNull())
    near = both.withColumn("_a", F.last("_v", True).over(down)).withColumn("_b", F.last("_v", True).over(up)).where("distance is not null")
    share = F.when(F.col("_b.d") > F.col("_a.d"), (F.col("_d") - F.col("_a.d")) / (F.col("_b.d") - F.col("_a.d"))).otherwise(0.0)
    at = lambda c: F.col(f"_a.{c}") + share * (F.col(f"_b.{c}") - F.col(f"_a.{c}"))
    return near.select(key, "distance", at("x").alias("x"), at("y").alias("y"))


def exits(samples: DataFrame, keys: list[str], time: str, state: str) -> DataFrame:
    """Times at which something seen is gone: a state counts once two samples in a row agree on it, and ambiguous ones are passed over."""
    w = W.partitionBy(*keys).orderBy(time)
    sure = samples.withColumn("_b", F.lag(state).over(w)).where((F.col(state) == F.col("_b")) & (F.col(state) != "ambiguous"))
    return sure.withColumn("_p", F.lag(state).over(w)).where((F.col("_p") == "visible") & (F.col(state) == "absent")).select(*keys, time)
