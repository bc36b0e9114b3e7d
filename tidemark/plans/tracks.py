"""Queries on tracks, nearest points and memories: events are frames of episodes, customers and suppliers points of scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import nearest, tracks
from tidemark.plans import views as V
from tidemark.plans.registry import registry
from tidemark.sources.tables import table
from tidemark.streaming import memory

QUERIES, ORACLES, query = registry()

NUMBERED = ", o AS (SELECT episode, seq, floor(value::DOUBLE * 10) AS z, row_number() OVER (PARTITION BY episode ORDER BY seq) AS n FROM frames)"


def turned(x: str) -> str:
    return f"(((({x}) + 180) % 360 + 360) % 360 - 180)"


def filtered(source: str) -> str:
    """DuckDB: one step of the filter with dt 1, process 900 and noise 64, from rows with the state before and the measurement z."""
    expected = f"SELECT episode, seq, n, last + {turned('z - last')} AS z, x + v AS x, v, p00 + 2 * p01 + p11 + 225 AS p00, p01 + p11 + 450 AS p01, p11 + 900 AS p11 FROM ({source})"
    return f"""SELECT episode, seq, n, x + p00 / (p00 + 64) * (z - x) AS x, v + p01 / (p00 + 64) * (z - x) AS v, (1 - p00 / (p00 + 64)) * p00 AS p00, (1 - p00 / (p00 + 64)) * p01 AS p01, p11 - p01 / (p00 + 64) * p01 AS p11, z AS last FROM ({expected})"""


@query(f"""{NUMBERED}, k AS ({filtered("SELECT episode, seq, n, z AS x, 0::DOUBLE AS v, 100::DOUBLE AS p00, 0::DOUBLE AS p01, 100::DOUBLE AS p11, z AS last, z FROM o WHERE n = 1")}
  UNION ALL {filtered("SELECT o.episode, o.seq, o.n, k.x, k.v, k.p00, k.p01, k.p11, k.last, o.z FROM k JOIN o ON o.episode = k.episode AND o.n = k.n + 1")})
SELECT seq, round(x, 4) AS place, round(v, 4) AS speed FROM k""")
def kalman_yaw(spark, sf):
    """Headings of an episode through a constant-velocity Kalman filter."""
    rows = V.frames(spark, sf).select("episode", "seq", F.floor(F.col("value").cast("double") * 10).cast("double").alias("yaw"))
    return tracks.kalman(rows, "episode", "seq", "yaw", angle=True).select("seq", F.round("place", 4).alias("place"), F.round("speed", 4).alias("speed"))


ORACLES["kalman_yaw"] = ORACLES["kalman_yaw"].replace("WITH items", "WITH RECURSIVE items", 1)


@query(f"""{NUMBERED}, k AS (SELECT episode, seq, n, z AS capped FROM o WHERE n = 1 UNION ALL SELECT o.episode, o.seq, o.n, k.capped + greatest(-50, least(50, o.z - k.capped)) FROM k JOIN o ON o.episode = k.episode AND o.n = k.n + 1)
SELECT seq, round(capped, 4) AS capped FROM k""")
def rate_cap(spark, sf):
    """Values that move no more than 50 at a step."""
    rows = V.frames(spark, sf).select("episode", "seq", F.floor(F.col("value").cast("double") * 10).cast("double").alias("v"))
    return tracks.capped(rows, "episode", "seq", "v", 50.0).select("seq", F.round("capped", 4).alias("capped"))


ORACLES["rate_cap"] = ORACLES["rate_cap"].replace("WITH items", "WITH RECURSIVE items", 1)


@query(f"""{NUMBERED}, c AS (SELECT episode, count(*) AS m FROM o GROUP BY episode),
r AS (SELECT o.episode, o.n - 1 AS n, c.m, {turned('coalesce(lead(z) OVER w, first_value(z) OVER w) - z')} * 8 AS rate FROM o JOIN c USING (episode) WINDOW w AS (PARTITION BY o.episode ORDER BY o.n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
a AS (SELECT *, (coalesce(lead(rate) OVER w, first_value(rate) OVER w) - rate) * 8 AS faster FROM r WINDOW w AS (PARTITION BY episode ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
q AS (SELECT episode, any_value(m) AS m, avg(rate) AS mean, quantile_cont(abs(rate), 0.95) AS p95, max(abs(rate)) AS most, max(abs(faster)) AS fastest FROM a GROUP BY episode),
g AS (SELECT episode, count(*) FILTER (s * b < 0) AS flips FROM (SELECT episode, sign(rate) AS s, lag(sign(rate)) OVER (PARTITION BY episode ORDER BY n) AS b FROM r WHERE abs(rate) >= 1) GROUP BY episode),
f AS (SELECT q.episode, q.m, j.range AS j, sum((r.rate - q.mean) * cos(2 * pi() * ((j.range * r.n) % q.m) / q.m)) AS re, sum((r.rate - q.mean) * sin(2 * pi() * ((j.range * r.n) % q.m) / q.m)) AS im
  FROM q JOIN r USING (episode) JOIN range(1, 100000) j ON j.range <= q.m // 2 GROUP BY ALL),
p AS (SELECT episode, sum(re * re + im * im) AS total, coalesce(sum(re * re + im * im) FILTER (j * 8e0 / m >= 3), 0) AS high FROM f GROUP BY episode)
SELECT q.episode, q.m AS n, round(CASE WHEN q.m >= 3 THEN p95 END, 4) AS yaw_rate_p95, round(CASE WHEN q.m >= 3 THEN most END, 4) AS yaw_rate_max, round(CASE WHEN q.m >= 3 THEN fastest END, 4) AS yaw_acceleration_max, CASE WHEN q.m >= 3 THEN coalesce(flips, 0) END AS sign_flips,
  round(CASE WHEN q.m >= 3 THEN CASE WHEN total > 1e-9 THEN high / total ELSE 0 END END, 6) AS high_ratio FROM q LEFT JOIN p USING (episode) LEFT JOIN g USING (episode)""")
def yaw_spectrum(spark, sf):
    """Turning rates of an episode's closed track at eight frames a second, and the share of their power at three hertz or more."""
    rows = V.frames(spark, sf).select("episode", "seq", F.floor(F.col("value").cast("double") * 10).cast("double").alias("yaw"))
    found = tracks.spectra(rows, "episode", "seq", "yaw", 8.0)
    return found.select("episode", "n", *[F.round(c, 4).alias(c) for c in ("yaw_rate_p95", "yaw_rate_max", "yaw_acceleration_max")], "sign_flips", F.round("high_ratio", 6).alias("high_ratio"))


POINTS = "c AS (SELECT c_nationkey AS scene, c_custkey AS id, c_acctbal::DOUBLE AS x, (c_custkey * 37 % 5000)::DOUBLE AS y, c_custkey * 53 % 360 - 180 AS turn FROM customer), s AS (SELECT s_nationkey AS scene, s_suppkey AS id, s_acctbal::DOUBLE AS x, (s_suppkey * 61 % 5000)::DOUBLE AS y FROM supplier)"
NEAREST = f"{POINTS}, n AS (SELECT c.scene, c.id, min({{'d': sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)), 'i': s.id}}) AS m FROM c JOIN s USING (scene) GROUP BY ALL)"


def points(spark, sf):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("scene"), k.alias("id"), F.col("c_acctbal").cast("double").alias("x"), (k * 37 % 5000).cast("double").alias("y"), (k * 53 % 360 - 180).alias("turn"), F.col("c_acctbal").cast("double").alias("room"))
    return c, table(spark, sf, "supplier").select(F.col("s_nationkey").alias("scene"), s.alias("id"), F.col("s_acctbal").cast("double").alias("x"), (s * 61 % 5000).cast("double").alias("y"))


@query(f"WITH {NEAREST} SELECT scene, id, m.i AS nearest, round(m.d, 4) AS distance FROM n")
def nearest_point(spark, sf):
    """The supplier nearest to each customer of a nation, however far."""
    c, s = points(spark, sf)
    return nearest.nearest(c, s, 500.0).select("scene", "id", "nearest", F.round("distance", 4).alias("distance"))


@query(f"""WITH {NEAREST}, w AS (SELECT n.scene, n.id, n.m.i AS surface, n.m.d AS distance, c.turn, c.x AS room FROM n JOIN c ON c.scene = n.scene AND c.id = n.id WHERE abs(c.turn) <= 120)
SELECT scene, id, surface, round(distance, 4) AS distance, turn FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY round(abs(distance - 800), 1), abs(turn), -room, id) AS r FROM w) WHERE r = 1""")
def waypoint_choice(spark, sf):
    """A scene's best waypoint by standoff from the nearest surface, turn, room and id."""
    c, s = points(spark, sf)
    return nearest.waypoint_choice(c, s, 500.0, 800.0, 120.0).withColumn("distance", F.round("distance", 4))


@query()
def clip_memories(spark, sf):
    """What questions find in their episode's bounded memory: purchases ask, all other events are frames."""
    f = V.frames(spark, sf)
    vector = F.array(F.col("value").cast("double"), (F.col("t") % 86400 / 86400).cast("double"), (F.col("seq") % 7).cast("double"), F.lit(1.0))
    frames = f.where("event_type <> 'purchase'").select("episode", F.col("seq").alias("id"), "t", vector.alias("vector"))
    asks = f.where("event_type = 'purchase'").select("episode", F.col("seq").alias("id"), "t", (F.col("seq") % 7 == 0).alias("done"))
    return memory.answers(memory.timeline(frames, asks))
