"""Queries on grids of cells: scenes are suppliers, cells come from their line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import graphs
from tidemark.plans.registry import registry
from tidemark.sources.tables import table

QUERIES, ORACLES, query = registry()

CELLS = "c AS (SELECT DISTINCT l_suppkey AS scene, CAST((l_partkey * 7 + l_linenumber * 5) % 24 AS BIGINT) AS x, CAST((l_orderkey // 3 + l_partkey) % 24 AS BIGINT) AS y FROM lineitem)"
OFFSETS = "o(dx, dy) AS (VALUES (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))"
EDGES = f"""{CELLS}, {OFFSETS},
e AS (SELECT a.scene, a.x, a.y, b.x AS bx, b.y AS by, CASE WHEN dx <> 0 AND dy <> 0 THEN 1414214 ELSE 1000000 END AS cost FROM c a CROSS JOIN o JOIN c b ON b.scene = a.scene AND b.x = a.x + dx AND b.y = a.y + dy
  LEFT JOIN c p ON p.scene = a.scene AND p.x = a.x + dx AND p.y = a.y LEFT JOIN c q ON q.scene = a.scene AND q.x = a.x AND q.y = a.y + dy WHERE dx = 0 OR dy = 0 OR p.x IS NOT NULL OR q.x IS NOT NULL)"""
DISTANCES = f"""{EDGES},
d(scene, x, y, distance) USING KEY (scene, x, y) AS (SELECT scene, min(struct_pack(x := x, y := y)).x, min(struct_pack(x := x, y := y)).y, 0::BIGINT FROM c GROUP BY scene
  UNION SELECT e.scene, e.bx, e.by, min(d.distance + e.cost) FROM d JOIN e ON e.scene = d.scene AND e.x = d.x AND e.y = d.y LEFT JOIN recurring.d r ON r.scene = e.scene AND r.x = e.bx AND r.y = e.by
  WHERE r.distance IS NULL OR r.distance > d.distance + e.cost GROUP BY ALL)"""


def cells(spark, sf):
    rows = table(spark, sf, "lineitem")
    x, y = (F.col("l_partkey") * 7 + F.col("l_linenumber") * 5) % 24, (F.floor(F.col("l_orderkey") / 3) + F.col("l_partkey")) % 24
    return rows.select(F.col("l_suppkey").alias("scene"), x.cast("long").alias("x"), y.cast("long").alias("y")).distinct()


@query(f"""WITH RECURSIVE {EDGES},
k(scene, x, y, component) USING KEY (scene, x, y) AS (SELECT scene, x, y, (x + 1073741824) * 2147483648 + y + 1073741824 FROM c
  UNION SELECT e.scene, e.bx, e.by, min(k.component) FROM k JOIN e ON e.scene = k.scene AND e.x = k.x AND e.y = k.y JOIN recurring.k r ON r.scene = e.scene AND r.x = e.bx AND r.y = e.by WHERE r.component > k.component GROUP BY ALL),
n AS (SELECT scene, component, count(*) AS cells FROM k GROUP BY ALL)
SELECT scene, count(*) AS components, max(cells) AS largest FROM n GROUP BY scene""")
def grid_components(spark, sf):
    """Components of each scene's walkable cells, and the size of the largest."""
    each = graphs.cell_components(cells(spark, sf)).groupBy("scene", "component").agg(F.count("*").alias("cells"))
    return each.groupBy("scene").agg(F.count("*").alias("components"), F.max("cells").alias("largest"))


@query(f"""WITH RECURSIVE {DISTANCES},
b AS (SELECT e.scene, e.bx AS x, e.by AS y, min(struct_pack(x := e.x, y := e.y)) AS before FROM e JOIN d a ON a.scene = e.scene AND a.x = e.x AND a.y = e.y JOIN d z ON z.scene = e.scene AND z.x = e.bx AND z.y = e.by AND z.distance = a.distance + e.cost GROUP BY ALL)
SELECT d.scene, d.x, d.y, d.distance, b.before.x AS before_x, b.before.y AS before_y FROM d LEFT JOIN b ON b.scene = d.scene AND b.x = d.x AND b.y = d.y""")
def grid_distances(spark, sf):
    """Shortest walking distance and predecessor of each cell from its scene's first cell."""
    return graphs.walking_distances(cells(spark, sf))


@query(f"""WITH RECURSIVE {DISTANCES},
b AS (SELECT e.scene, e.bx AS x, e.by AS y, min(struct_pack(x := e.x, y := e.y)) AS before FROM e JOIN d a ON a.scene = e.scene AND a.x = e.x AND a.y = e.y JOIN d z ON z.scene = e.scene AND z.x = e.bx AND z.y = e.by AND z.distance = a.distance + e.cost GROUP BY ALL),
w AS (SELECT scene, 0::BIGINT AS place, x, y FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY distance DESC, x, y) AS r FROM d) WHERE r = 1
  UNION ALL SELECT w.scene, w.place + 1, b.before.x, b.before.y FROM w JOIN b ON b.scene = w.scene AND b.x = w.x AND b.y = w.y)
SELECT scene, place, x, y FROM w""")
def grid_routes(spark, sf):
    """The shortest way between a scene's first cell and the one farthest from it."""
    return graphs.farthest_routes(cells(spark, sf))


@query()
def grid_skeleton(spark, sf):
    """A scene's cells that its skeleton keeps, with how many neighbours each has in it (1: an end, more than 2: a junction)."""
    masks = graphs.neighbour_masks(graphs.skeleton(cells(spark, sf)))
    return masks.select("scene", "x", "y", F.bit_count("mask").cast("long").alias("neighbours"))
