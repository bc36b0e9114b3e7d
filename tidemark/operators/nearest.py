"""The nearest of many points for each of many, by rings of grid cells.

A point asks the cells around its own. What it finds within the width of a cell is certain, as all else is farther; those without are asked
again of a grid of twice the width, so the few that lie far from all others cost the logarithm of their distance, and no point is compared with all.

Defined results: points without a scene, id or coordinate are ignored, on either side; of equal distances the smallest id; a point is never its own nearest if both sides
are told to be the same; scenes without points on the other side, and lone points, have no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import checkpointed


def proper(points: DataFrame) -> DataFrame:
    return points.where("scene is not null and id is not null and x is not null and y is not null and not isnan(x) and not isnan(y)").select("scene", "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


#: Points in a cell of the first grid, on average, and most of them in one array.
FULL, MOST = 2, 512


def nearest(asking: DataFrame, points: DataFrame, width: float, same: bool = False) -> DataFrame:
    """(scene, id, nearest, distance) of each asking point (scene, id, x, y). width: of the first cells at most, about the usual distance.

    A scene with many points starts with smaller cells, of FULL points on average, so that what a point is compared with does not grow with the scene. The points of a cell and those around it are
    arrays of MOST at most, of which each asking row keeps its best at once: pairs are never rows. Points in one place are one, with their smallest id (and the next, for itself).
    """
    every = proper(points)
    points = checkpointed(every.groupBy("scene", "x", "y").agg(F.min("id").alias("id"), F.count_distinct("id").alias("n")))
    boxes = points.groupBy("scene").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.sum("n").alias("many"), F.count("*").alias("places"))
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    dense = F.greatest(F.sqrt(wide * high * FULL / F.col("places")), F.greatest(wide, high) * FULL / F.col("places"))
    boxes = checkpointed(boxes.withColumn("width", F.when(dense > 0, F.least(dense, F.lit(float(width)))).otherwise(F.lit(float(width)))))
    left = proper(asking).join(boxes, "scene").where("many > 1" if same else "many > 0")
    far = F.greatest(F.abs(F.col("x") - F.col("x0")), F.abs(F.col("x") - F.col("x1")), F.abs(F.col("y") - F.col("y0")), F.abs(F.col("y") - F.col("y1")))
    left, found = checkpointed(left.select("scene", "id", "x", "y", far.alias("far"), "width")), None
    if same:  # the second id of a place is the nearest of its first
        others = every.join(points.where("n > 1").select("scene", "x", "y", F.col("id").alias("low")), ["scene", "x", "y"]).groupBy("scene", "x", "y", "low").agg(F.min(F.when(F.col("id") > F.col("low"), F.col("id"))).alias("second"))
        points = checkpointed(points.join(others.select("scene", "x", "y", "second"), ["scene", "x", "y"], "left").select("scene", "x", "y", "id", "second"))
    else:
        points = points.select("scene", "x", "y", "id", F.col("id").alias("second"))
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    cell = lambda c: F.floor(F.col(c) / F.col("width"))
    turn = 0
    while not left.isEmpty():
        held = points.join(boxes.select("scene", (F.col("width") * 2.0**turn).alias("width")), "scene").select("*", around.alias("d"))
        held = held.select("scene", (cell("x") + F.col("d.dx")).alias("cx"), (cell("y") + F.col("d.dy")).alias("cy"), F.struct("x", "y", "id", "second").alias("p"))
        sizes = held.groupBy("scene", "cx", "cy").agg(F.count("*").alias("n"))
        many = sizes.where(F.col("n") > MOST)
        held = held.join(many, ["scene", "cx", "cy"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("p"), F.ceil(F.col("n") * 2 / MOST)), F.lit(0)))
        near = held.groupBy("scene", "cx", "cy", "part").agg(F.collect_list("p").alias("near"))
        gap = lambda p: F.sqrt((F.col("x") - p.x) * (F.col("x") - p.x) + (F.col("y") - p.y) * (F.col("y") - p.y))
        other = lambda p: F.when(F.col("id") == p.id, p.second).otherwise(p.id) if same else p.id
        best = F.array_min(F.filter(F.transform("near", lambda p: F.struct(gap(p).alias("distance"), other(p).alias("nearest"))), lambda m: m.nearest.isNotNull()))
        asked = left.select("*", cell("x").alias("cx"), cell("y").alias("cy")).join(near, ["scene", "cx", "cy"], "left").withColumn("m", best)
        asked = asked.groupBy("scene", "id", "x", "y", "far", "width").agg(F.min("m").alias("m"))
        certain = F.coalesce(F.col("m.distance") <= F.col("width"), F.lit(False)) | (F.col("far") < F.col("width"))  # or all points lie in the cells asked
        rows = checkpointed(asked.withColumn("certain", certain))
        own = rows.where("certain and m is not null").select("scene", "id", "m.nearest", "m.distance")
        found = own if found is None else found.unionByName(own)
        left, turn = checkpointed(rows.where("not certain").select("scene", "id", "x", "y", "far", (F.col("width") * 2).alias("width"))), turn + 1
    if found is None:
        return left.select("scene", "id", F.col("id").alias("nearest"), F.col("far").alias("distance"))
    return found


def waypoint_choice(waypoints: DataFrame, surfaces: DataFrame, width: float, standoff: float, most_turn: float) -> DataFrame:
    """A scene's best waypoint (scene, id, surface, distance, turn): closeness of its distance from the nearest surface to `standoff` in steps of a tenth, then the smaller turn, then more room, then the id.

    waypoints: scene, id, x, y, turn, room; those that turn more than most_turn are out.
    """
    near = nearest(waypoints.where(F.abs("turn") <= most_turn), surfaces, width)
    rows = waypoints.join(near, ["scene", "id"])
    key = F.struct(F.round(F.abs(F.col("distance") - standoff), 1).alias("a"), F.abs("turn").alias("b"), (-F.col("room")).alias("c"), F.col("id").alias("d"))
    return rows.groupBy("scene").agg(F.min_by(F.struct("id", F.col("nearest").alias("surface"), "distance", "turn"), key).alias("m")).select("scene", "m.*")
