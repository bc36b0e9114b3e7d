"""Queries on items' form, motion, scenes and programs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import items as I
from tidemark.operators import motion, scenes
from tidemark.plans import views as V
from tidemark.plans.registry import registry

QUERIES, ORACLES, query = registry()

CHOICES = """, o AS (SELECT id::VARCHAR AS id, CASE WHEN known THEN 'known' ELSE 'uncertain' END AS status, question_type, episode_id, query_time,
  [substr(text, 1, 5) || '0', substr(text, 6, (n_chars % 4)::BIGINT + 3) || '1', substr(text, 11, (n_chars % 7)::BIGINT + 3) || '2', CASE WHEN id % 5 = 0 THEN 'it is uncertain' ELSE substr(text, 16, 6) || '3' END] AS options, answer AS answer_index FROM items)"""


def choices(spark, sf):
    n, text = F.col("n_chars"), F.col("text")
    part = lambda at, size, end: F.concat(F.substring(text, F.lit(at), size), F.lit(end))
    options = F.array(part(1, F.lit(5), "0"), part(6, (n % 4 + 3).cast("int"), "1"), part(11, (n % 7 + 3).cast("int"), "2"), F.when(F.col("id") % 5 == 0, "it is uncertain").otherwise(part(16, F.lit(6), "3")))
    return V.items(spark, sf).select(F.col("id").cast("string").alias("id"), F.when(F.col("known"), "known").otherwise("uncertain").alias("status"), "question_type", "episode_id", "query_time", options.alias("options"), F.col("answer").cast("long").alias("answer_index"))


@query(CHOICES + """, h AS (SELECT *, list_transform(list_sort([{'h': sha256(id || ':0'), 'i': 0}, {'h': sha256(id || ':1'), 'i': 1}, {'h': sha256(id || ':2'), 'i': 2}]), lambda x: x.i) || [3] AS p FROM o)
SELECT id, array_to_string(p, ',') AS permutation, list_position(p, answer_index::INTEGER) - 1 AS answer, 'Q' || chr(10) || '(A) ' || options[p[1] + 1] || chr(10) || '(B) ' || options[p[2] + 1] || chr(10) || '(C) ' || options[p[3] + 1] || chr(10) || '(D) ' || options[4] AS prompt FROM h""")
def normalised_items(spark, sf):
    rows = I.normalised(choices(spark, sf).withColumn("abstention_index", F.lit(3)).withColumn("question", F.lit("Q ")).withColumn("question_stem", F.lit("")))
    return rows.select("id", F.array_join(F.transform("option_permutation", lambda x: x.cast("string")), ",").alias("permutation"), "answer", "prompt")


@query(CHOICES + """, k AS (SELECT *, row_number() OVER (PARTITION BY status, question_type ORDER BY id) - 1 AS k FROM o), i AS (SELECT *, unnest([0, 1, 2, 3]) AS i FROM k WHERE status = 'known'),
c AS (SELECT id, i, CASE WHEN options[i + 1] = 'it is uncertain' THEN 0 ELSE 1 END AS m,
    abs((SELECT count(*) FROM range(4) j WHERE j.range <> i AND (length(options[j.range + 1]), options[j.range + 1]) < (length(options[answer_index + 1]), options[answer_index + 1])) - (k // 3) % 3) AS c, sha256(id || ':' || i) AS h FROM i WHERE i <> answer_index),
d AS (SELECT id, arg_min(i, (m, CASE WHEN m = 0 THEN 0 ELSE c END, h)) AS d FROM c GROUP BY id)
SELECT k.id, coalesce(options[d.d + 1], options[answer_index + 1]) AS dropped_option, CASE WHEN status = 'known' THEN k % 3 ELSE 3 END AS answer_index FROM k LEFT JOIN d ON k.id = d.id""")
def rebuilt_options(spark, sf):
    return I.rebuilt(choices(spark, sf)).select("id", "dropped_option", "answer_index")


@query(CHOICES + " SELECT id, len(list_filter(options, lambda x: x = 'it is uncertain')) AS n FROM o")
def abstention_wording(spark, sf):
    return choices(spark, sf).select("id", F.size(F.filter("options", I.is_meta)).cast("long").alias("n"))


@query(""", e AS (SELECT id, episode_id, query_time, episode_id || CASE WHEN id % 3 = 0 THEN '_unc_' || id ELSE '_q' || lpad((id % 1000)::VARCHAR, 3, '0') END AS name FROM items),
t AS (SELECT *, contains(name, '_unc_') AS tells, CASE WHEN id % 3 <> 0 THEN id % 1000 END AS n FROM e), r AS (SELECT *, coalesce(max(n) OVER (PARTITION BY episode_id), 0) AS top, row_number() OVER (PARTITION BY episode_id, tells ORDER BY query_time, name) AS place FROM t)
SELECT name AS id, CASE WHEN tells THEN episode_id || '_q' || CASE WHEN top + place < 10 THEN '0' ELSE '' END || (top + place) ELSE name END AS new_id FROM r""")
def neutral_ids(spark, sf):
    i = F.col("id")
    name = F.concat("episode_id", F.when(i % 3 == 0, F.concat(F.lit("_unc_"), i.cast("string"))).otherwise(F.concat(F.lit("_q"), F.lpad((i % 1000).cast("string"), 3, "0"))))
    rows = V.items(spark, sf).select(name.alias("id"), "episode_id", "query_time")
    out = I.neutral_ids(rows, "_unc_")
    return out.select("id", "new_id")


@query("SELECT id, CASE id % 4 WHEN 0 THEN 'P' || id || '/P' || id || '_x.mp4' WHEN 1 THEN 'FloorPlan' || id || '/a_FloorPlan' || id || '.mp4' WHEN 2 THEN 'cmu_' || id || '.mp4' ELSE 'Release_cook_' || id || '.mp4' END AS path FROM items")
def video_paths(spark, sf):
    i = F.col("id").cast("string")
    name = F.when(F.col("id") % 4 == 0, F.concat(F.lit("P"), i, F.lit("_x"))).when(F.col("id") % 4 == 1, F.concat(F.lit("a_FloorPlan"), i)).when(F.col("id") % 4 == 2, F.concat(F.lit("cmu_"), i)).otherwise(F.concat(F.lit("Release_cook_"), i))
    return V.items(spark, sf).select("id", I.video_path(name).alias("path"))


@query("SELECT seq, greatest(round((t - 100) / 1.5e0, 2), 0) AS start, greatest(round((t + 7 - 100) / 1.5e0, 2), 0) AS \"end\" FROM frames")
def localised_events(spark, sf):
    rows = V.frames(spark, sf).select("seq", F.col("t").alias("start"), (F.col("t") + 7).alias("end"))
    return I.localised(rows, F.lit(100), F.lit(1.5))


@query("SELECT DISTINCT episode_id, query_time * 2 AS frames FROM items WHERE query_time > 0")
def prefix_inputs(spark, sf):
    return I.prefixes(V.items(spark, sf).where("query_time > 0"), 2.0)


PATH = ", p AS (SELECT seq, episode, row_number() OVER (PARTITION BY episode ORDER BY seq) - 1 AS n, count(*) OVER (PARTITION BY episode) - 1 AS last, ((seq * 31) % 23)::DOUBLE / 10 AS x, ((seq * 17) % 19)::DOUBLE / 10 AS z FROM frames)"
SPEED = PATH + """, s AS (SELECT episode, seq, n, sqrt(power(last_value(x) OVER w - first_value(x) OVER w, 2) + power(last_value(z) OVER w - first_value(z) OVER w, 2)) / greatest((least(n + 2, last) - greatest(n - 2, 0)) / 8e0, 1 / 8e0) AS speed FROM p
  WINDOW w AS (PARTITION BY episode ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"""


def path(spark, sf):
    s = F.col("seq")
    return V.frames(spark, sf).select("seq", "episode", ((s * 31 % 23).cast("double") / 10).alias("x"), ((s * 17 % 19).cast("double") / 10).alias("z"))


@query(SPEED + """, m AS (SELECT *, speed < 1.5e0 AS still, row_number() OVER (PARTITION BY episode ORDER BY seq) AS k FROM s), g AS (SELECT episode, k - row_number() OVER (PARTITION BY episode ORDER BY seq) AS g FROM m WHERE still), l AS (SELECT episode, max(c) AS l FROM (SELECT episode, g, count(*) AS c FROM g GROUP BY 1, 2) GROUP BY 1)
SELECT m.episode, round(avg(CASE WHEN still THEN 0e0 ELSE 1e0 END), 6) AS moving, round(count(*) FILTER (still) / 8e0, 6) AS stationary, round(coalesce(max(l.l), 0) / 8e0, 6) AS longest FROM m LEFT JOIN l ON m.episode = l.episode GROUP BY m.episode""")
def movement_metrics(spark, sf):
    return motion.movement(motion.speeds(path(spark, sf), "episode", "seq", "x", "z", 8.0), "episode", "seq", 8.0, 1.5)


@query(PATH + """, d AS (SELECT episode, sqrt(power(x - lag(x) OVER w, 2) + power(z - lag(z) OVER w, 2)) AS s, sqrt(power(x - 2 * lag(x) OVER w + lag(x, 2) OVER w, 2) + power(z - 2 * lag(z) OVER w + lag(z, 2) OVER w, 2)) AS a FROM p WINDOW w AS (PARTITION BY episode ORDER BY seq))
SELECT episode, round(max(s) * 8, 4) AS max_speed, round(quantile_cont(s, 0.95) * 8, 4) AS p95_speed, round(quantile_cont(a, 0.95) * 64, 4) AS p95_acceleration FROM d GROUP BY episode""")
def camera_metrics(spark, sf):
    return motion.camera(path(spark, sf), "episode", "seq", ["x", "z"], 8.0)


@query(PATH + ", d AS (SELECT episode, seq, sign(x - lag(x) OVER (PARTITION BY episode ORDER BY seq)) AS d FROM p), b AS (SELECT episode, d, lag(d) OVER (PARTITION BY episode ORDER BY seq) AS b FROM d WHERE d <> 0) SELECT episode, count(*) FILTER (b <> d) AS flips FROM b GROUP BY episode")
def yaw_sign_flips(spark, sf):
    return motion.sign_flips(path(spark, sf), "episode", "seq", "x")


@query("SELECT episode, count(*) FILTER ((seq * 7) % 300 >= 128) AS visible_frames, coalesce(min(CASE WHEN (seq * 7) % 300 >= 128 THEN seq END), -1) AS first_frame, count(*) AS total_frames FROM frames GROUP BY episode")
def visibility_summary(spark, sf):
    return motion.visibility(V.frames(spark, sf).withColumn("pixels", F.col("seq") * 7 % 300), "episode", "seq", "pixels")


@query(""", b AS (SELECT seq, seq % 50 AS x0, seq % 30 AS y0, seq % 50 + 20 AS x1, seq % 30 + 15 AS y1, seq % 37 AS u0, seq % 41 AS v0, seq % 37 + 25 AS u1, seq % 41 + 10 AS v1 FROM frames),
o AS (SELECT *, greatest(least(x1, u1) - greatest(x0, u0), 0) * greatest(least(y1, v1) - greatest(y0, v0), 0) AS i FROM b) SELECT seq, round(i / (300 + 250 - i)::DOUBLE, 6) AS iou FROM o""")
def mask_iou(spark, sf):
    s = F.col("seq")
    a, b = (s % 50, s % 30, s % 50 + 20, s % 30 + 15), (s % 37, s % 41, s % 37 + 25, s % 41 + 10)
    return V.frames(spark, sf).select("seq", F.round(motion.box_iou(a, b), 6).alias("iou"))


@query("SELECT seq, seq % 5000 >= 3000 AND least(seq % 90, seq % 70) >= 40 AND (seq % 11) / 10e0 <= 1 AND (seq % 13 >= 8 OR (seq % 5000 >= 4500 AND (seq % 11) / 10e0 <= 0.25)) AS passes FROM frames")
def mask_gate(spark, sf):
    s = F.col("seq")
    return V.frames(spark, sf).select("seq", motion.mask_passes(F.lit(True), s % 5000, s % 90, s % 70, s % 13, s % 11 / 10, waiver=4500).alias("passes"))


@query(""", k AS (SELECT episode, t, value::DOUBLE AS v, seq FROM frames WHERE event_type = 'view'), k1 AS (SELECT episode, t, max(v) AS v FROM k GROUP BY 1, 2), q AS (SELECT DISTINCT episode, t FROM frames WHERE event_type = 'purchase'),
j AS (SELECT q.episode, q.t, (SELECT max(k1.t) FROM k1 WHERE k1.episode = q.episode AND k1.t <= q.t) AS t0, (SELECT min(k1.t) FROM k1 WHERE k1.episode = q.episode AND k1.t > q.t) AS t1 FROM q)
SELECT j.episode, j.t, round(CASE WHEN a.v IS NULL THEN b.v WHEN b.v IS NULL THEN a.v ELSE a.v + (b.v - a.v) * ((j.t - j.t0)::DOUBLE / (j.t1 - j.t0)) END, 4) AS v FROM j LEFT JOIN k1 a ON a.episode = j.episode AND a.t = j.t0 LEFT JOIN k1 b ON b.episode = j.episode AND b.t = j.t1""")
def keyframe_interpolation(spark, sf):
    f = V.frames(spark, sf)
    keys = f.where("event_type = 'view'").groupBy("episode", "t").agg(F.max("value").alias("v"))
    return motion.interpolated(f.where("event_type = 'purchase'").select("episode", "t").distinct(), keys, "episode", "t", "v").select("episode", "t", F.round("v", 4).alias("v"))


GRAPH = ", n AS (SELECT p_partkey AS id, p_partkey % 3 = 0 AS surface, p_partkey % 4 = 1 AS closed, p_partkey % 5 = 0 AS opens, p_partkey % 7 AS room FROM part), e AS (SELECT p_partkey AS a, p_partkey // 2 AS b, CASE WHEN p_partkey % 2 = 0 THEN 'ON' ELSE 'INSIDE' END AS r FROM part)"


def graph(spark, sf):
    k = F.col("p_partkey")
    part = V.table(spark, sf, "part")
    tags = lambda *pairs: F.array_compact(F.array(*[F.when(c, v) for c, v in pairs]))
    nodes = part.select(k.alias("id"), tags((k % 3 == 0, "SURFACES"), (k % 5 == 0, "CAN_OPEN")).alias("properties"), tags((k % 4 == 1, "CLOSED")).alias("states"), (k % 7).alias("room"))
    return nodes, part.select(k.alias("from_id"), F.floor(k / 2).alias("to_id"), F.when(k % 2 == 0, "ON").otherwise("INSIDE").alias("relation"))


@query(GRAPH + " SELECT e.a AS node, e.b AS support FROM e JOIN n ON e.b = n.id WHERE e.r = 'ON' AND n.surface")
def support_edges(spark, sf):
    nodes, edges = graph(spark, sf)
    return scenes.supports(edges, nodes)


@query(GRAPH + " SELECT DISTINCT e.a AS node FROM e JOIN n ON e.b = n.id WHERE e.r = 'INSIDE' AND n.closed")
def inside_closed(spark, sf):
    nodes, edges = graph(spark, sf)
    return scenes.in_closed(edges, nodes)


@query(GRAPH + " SELECT room, count(*) FILTER (opens AND closed) AS closed, 0 AS off, count(*) FILTER (surface) AS surfaces, count(*) AS n FROM n GROUP BY room")
def scene_capabilities(spark, sf):
    return scenes.capabilities(graph(spark, sf)[0], "room")


@query(", a AS (SELECT seq // 4 AS frame, seq % 4 AS actor, ((seq * 31) % 23)::DOUBLE AS x, ((seq * 17) % 19)::DOUBLE AS y FROM frames) SELECT p.frame, p.actor AS a, q.actor AS b, round(sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2)), 4) AS distance FROM a p JOIN a q ON p.frame = q.frame AND p.actor < q.actor WHERE sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2)) < 5")
def actor_separation(spark, sf):
    s = F.col("seq")
    rows = V.frames(spark, sf).select(F.floor(s / 4).alias("frame"), (s % 4).alias("actor"), (s * 31 % 23).cast("double").alias("x"), (s * 17 % 19).cast("double").alias("y"))
    return scenes.near_pairs(rows, "frame", "actor", "x", "y", 5.0)


@query(", p AS (SELECT episode, seq, CASE WHEN seq % 3 = 0 THEN seq - 50 WHEN seq % 7 = 0 THEN seq + 1 END AS needs FROM frames) SELECT p.seq FROM p WHERE p.needs IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p d WHERE d.episode = p.episode AND d.seq = p.needs AND d.seq < p.seq)")
def dependency_gate(spark, sf):
    s = F.col("seq")
    rows = V.frames(spark, sf).select("episode", "seq", F.when(s % 3 == 0, s - 50).when(s % 7 == 0, s + 1).alias("needs"), s.alias("name"))
    return scenes.dependencies_met(rows, "episode", "seq", "needs", "name").select("seq")


@query(", s AS (SELECT seq, episode, event_type, seq % 3 AS b, seq % 2 AS a FROM frames), l AS (SELECT *, lag(a) OVER (PARTITION BY episode, event_type ORDER BY seq) AS l FROM s) SELECT seq, l AS \"left\", b FROM l WHERE l <> b")
def state_precondition(spark, sf):
    rows = V.frames(spark, sf).select("seq", "episode", "event_type", (F.col("seq") % 3).alias("b"), (F.col("seq") % 2).alias("a"))
    return scenes.state_legal(rows, ["episode", "event_type"], ["seq"], "b", "a").select("seq", "left", "b")


@query(", h AS (SELECT episode, seq, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY episode ORDER BY seq)::BIGINT AS h FROM frames) SELECT episode, min(h) AS least, max(h) AS most, arg_max(h, seq) AS \"end\" FROM h GROUP BY episode")
def hands_balance(spark, sf):
    return scenes.hands(V.frames(spark, sf), "episode", ["seq"], F.col("event_type") == "signup", F.col("event_type") == "error")


@query(", g AS (SELECT seq, lead(t) OVER (PARTITION BY episode ORDER BY t, seq) - t AS gap FROM frames) SELECT seq, gap FROM g WHERE abs(gap - 20000) > 15000")
def spacing_gate(spark, sf):
    return scenes.spacing(V.frames(spark, sf), "episode", "t", "seq", 20000, 15000).select("seq", "gap")


@query(", v AS (SELECT seq, episode, t AS a, t + 30 AS b FROM frames WHERE event_type = 'view'), s AS (SELECT seq, episode, t AS a, t + 5000 AS b FROM frames WHERE event_type = 'purchase') SELECT v.seq, min(s.seq) AS segment FROM v JOIN s ON v.episode = s.episode AND v.a >= s.a AND v.b <= s.b GROUP BY v.seq")
def visit_containment(spark, sf):
    f = V.frames(spark, sf)
    span = lambda kind, size: f.where(F.col("event_type") == kind).select("seq", "episode", F.col("t").alias("start"), (F.col("t") + size).alias("end"))
    return scenes.contained(span("view", 30), span("purchase", 5000), "episode", 5000)


@query(", m AS (SELECT episode, event_type AS k, min(t) AS t FROM frames GROUP BY 1, 2) SELECT a.episode, a.k AS x, b.k AS y, CASE WHEN a.t < b.t THEN a.k ELSE b.k END AS first FROM m a JOIN m b ON a.episode = b.episode AND a.k < b.k WHERE abs(a.t - b.t) >= 3")
def order_pairs(spark, sf):
    return scenes.order_pairs(V.frames(spark, sf), "episode", "event_type", "t", 3)


@query("SELECT episode, arg_max(CASE WHEN event_type = 'signup' THEN 'accepted' ELSE event_type END, seq) AS latest, count(*) AS tries, bool_or(event_type = 'signup') AS accepted FROM frames GROUP BY episode")
def attempt_rollup(spark, sf):
    rows = V.frames(spark, sf).withColumn("state", F.when(F.col("event_type") == "signup", "accepted").otherwise(F.col("event_type")))
    return scenes.attempts(rows, "episode", "state", "seq")


@query(""", a AS (SELECT p_partkey AS id, p_brand AS k, p_retailprice / 1000 AS x FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_partkey AS id, p_brand AS k, p_retailprice / 1000 AS x FROM part WHERE p_partkey % 2 = 1)
SELECT a.id, count(*) AS matches, min(b.id) AS found FROM a JOIN b ON a.k = b.k AND abs(a.x - b.x) <= 0.15e0 GROUP BY a.id""")
def added_node_match(spark, sf):
    rows = V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind"), (F.col("p_retailprice") / 1000).alias("x"))
    return scenes.matched_nodes(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), "kind", "x")
