"""Queries on limits, resumed runs, states, taxonomies, exits and points along paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as X
from tidemark.operators import motion, runs, temporal
from tidemark.plans import views as V
from tidemark.plans.registry import registry

QUERIES, ORACLES, query = registry()
FRAMES = "PARTITION BY episode ORDER BY seq"


@query("SELECT id, episode_id FROM items WHERE episode_id IN (SELECT episode_id FROM (SELECT DISTINCT episode_id FROM items) ORDER BY md5('7:' || episode_id), episode_id LIMIT 5) ORDER BY id LIMIT 50")
def limited_rows(spark, sf):
    """The first 50 rows of five episodes: limits are the feature."""
    return runs.first_rows(runs.some_groups(V.items(spark, sf), "episode_id", 5, 7), 50, "id").select("id", "episode_id")


@query("SELECT id, question_type FROM items WHERE id NOT IN (SELECT id FROM preds WHERE id % 3 = 0)")
def pending_items(spark, sf):
    done = V.preds(spark, sf).where("id % 3 = 0").select("id", F.lit("run-1").alias("signature"))
    return runs.pending(V.items(spark, sf), done, "run-1").select("id", "question_type")


@query("SELECT question_type, n AS count, 'offline' AS protocol_label, NULL::VARCHAR AS model_path FROM (SELECT question_type, count(*) AS n FROM items GROUP BY 1)")
def compact_results(spark, sf):
    results = V.items(spark, sf).groupBy("question_type").agg(F.count("*").alias("count")).withColumn("eval_signature", F.lit('{"protocol_label": "offline", "fps": 2}')).withColumn("spare", F.lit(1))
    out = runs.compacted(results, ["question_type", "count", "accuracy"], "eval_signature", ["protocol_label", "model_path"])
    return out.select("question_type", "count", "signature.protocol_label", "signature.model_path")


VERBS = ("Open", "Close", "SwitchOn", "SwitchOff", "Grab", "Put")


@query("""SELECT seq, CASE WHEN seq % 6 < 2 THEN 'openable' WHEN seq % 6 < 4 THEN 'switchable' ELSE 'portable' END AS family,
  CASE WHEN seq % 6 < 2 THEN 'Fully closed./Fully open./Partly open.' WHEN seq % 6 < 4 THEN 'On./Off./Being switched between on and off.' ELSE 'Held by a person./Resting on a surface./Lying on the floor.' END AS answers FROM frames""")
def state_families(spark, sf):
    verb = F.element_at(F.array(*map(F.lit, VERBS)), (F.col("seq") % 6 + 1).cast("int"))
    return V.frames(spark, sf).select("seq", X.state_family(verb).alias("family"), F.array_join(X.state_answers(verb), "/").alias("answers"))


@query("""SELECT seq, ['movement', 'presence_change', 'occlusion', 'state_change', 'identity_swap', 'quantity_change', 'no_change'][(seq % 7 + 1)::INTEGER] AS family,
  CASE seq % 7 WHEN 0 THEN 'move' WHEN 1 THEN 'appear' WHEN 2 THEN 'reveal' WHEN 3 THEN CASE seq % 3 WHEN 0 THEN 'toggle_on' WHEN 1 THEN 'toggle_off' ELSE 'slice' END
    WHEN 4 THEN 'swap_positions' WHEN 5 THEN 'add_instance' ELSE 'none' END AS action FROM frames""")
def event_taxonomy(spark, sf):
    kinds = ("move", "appear", "reveal", "state_change", "identity_swap", "quantity_change", "no_change")
    kind, turn = F.element_at(F.array(*map(F.lit, kinds)), (F.col("seq") % 7 + 1).cast("int")), F.col("seq") % 3
    own = X.event_labels(kind, F.when((kind == "state_change") & (turn < 2), "toggle"), F.when(turn == 1, False))
    return V.frames(spark, sf).select("seq", own.alias("o")).select("seq", "o.family", "o.action")


@query("SELECT seq, 2.5e0 * round((seq % 40) / 2.5e0) AS at FROM frames WHERE abs(2.5e0 * round((seq % 40) / 2.5e0) - seq % 40) <= 0.05")
def aligned_boundaries(spark, sf):
    value = (F.col("seq") % 40).cast("double")
    allowed = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda k: k * F.lit(2.5))
    rows = V.frames(spark, sf).where(F.abs(F.round(value / 2.5) * 2.5 - value) <= 0.05)
    return rows.select("seq", X.boundary(value, allowed).alias("at"))


@query(f""", s AS (SELECT episode, seq, CASE seq * 7 % 5 WHEN 0 THEN 'ambiguous' WHEN 1 THEN 'visible' WHEN 2 THEN 'visible' ELSE 'absent' END AS state FROM (SELECT episode, seq // 2 AS h, seq FROM frames)),
b AS (SELECT *, lag(state) OVER ({FRAMES}) AS before FROM s), c AS (SELECT *, lag(state) OVER ({FRAMES}) AS previous FROM b WHERE state = before AND state <> 'ambiguous')
SELECT episode, count(*) AS exits FROM c WHERE previous = 'visible' AND state = 'absent' GROUP BY 1""")
def exit_counts(spark, sf):
    turn = F.col("seq") * 7 % 5
    samples = V.frames(spark, sf).withColumn("state", F.when(turn == 0, "ambiguous").when(turn.isin(1, 2), "visible").otherwise("absent"))
    return motion.exits(samples, ["episode"], "seq", "state").groupBy("episode").agg(F.count("*").alias("exits"))


@query(f""", p AS (SELECT episode, seq, (seq * 31 % 100)::DOUBLE AS x, (seq * 17 % 100)::DOUBLE AS y FROM frames), l AS (SELECT *, lag(x) OVER ({FRAMES}) AS px, lag(y) OVER ({FRAMES}) AS py FROM p),
d AS (SELECT *, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS s FROM l), c AS (SELECT *, sum(coalesce(s, 0)) OVER ({FRAMES}) AS upto FROM d WHERE s IS NULL OR s > 1e-6),
a AS (SELECT episode, least(unnest([0e0, 60e0, 150e0, 1e9]), max(upto)) AS at FROM c GROUP BY episode),
q AS (SELECT a.episode, a.at, max(c.upto) FILTER (c.upto <= a.at) AS low, min(c.upto) FILTER (c.upto >= a.at) AS high FROM a JOIN c USING (episode) GROUP BY 1, 2)
SELECT q.episode, round(q.at, 4) AS at, round(m.x + CASE WHEN high > low THEN (q.at - low) / (high - low) ELSE 0 END * (n.x - m.x), 4) AS x, round(m.y + CASE WHEN high > low THEN (q.at - low) / (high - low) ELSE 0 END * (n.y - m.y), 4) AS y
FROM q JOIN c m ON m.episode = q.episode AND m.upto = q.low JOIN c n ON n.episode = q.episode AND n.upto = q.high""")
def points_along_paths(spark, sf):
    path = V.frames(spark, sf).withColumn("x", (F.col("seq") * 31 % 100).cast("double")).withColumn("y", (F.col("seq") * 17 % 100).cast("double"))
    asks = path.select("episode").distinct().select("episode", F.explode(F.array(*map(F.lit, (0.0, 60.0, 150.0, 1e9)))).alias("distance"))
    whole = temporal.path_length(path, "episode", ["seq"], "x", "y").groupBy("episode").agg(F.max("walked").alias("total"))
    out = motion.points_at(path, asks, "episode", "seq", "x", "y").join(whole, "episode")
    return out.select("episode", F.round(F.least("distance", "total"), 4).alias("at"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y")).distinct()
