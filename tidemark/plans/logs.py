"""Queries on frames and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as X
from tidemark.operators import generate, temporal
from tidemark.plans import views as V
from tidemark.plans.registry import registry

QUERIES, ORACLES, query = registry()
ORDER = ["t", "seq"]
W = "PARTITION BY episode ORDER BY t, seq"


def kind(name: str):
    return F.col("event_type") == name




@query(f"SELECT seq, lead(t) OVER ({W}) - t AS gap FROM frames")
def event_gaps(spark, sf):
    return temporal.gaps(V.frames(spark, sf), "episode", "t", "seq").select("seq", "gap")


ISLANDS = f", n AS (SELECT episode, event_type, row_number() OVER ({W}) AS n, t, seq FROM frames), g AS (SELECT episode, n, n - row_number() OVER ({W}) AS g FROM n WHERE event_type <> 'view'), isl AS (SELECT episode, min(n) AS first, max(n) AS last, count(*) AS length FROM g GROUP BY episode, g) "


def hidden(spark, sf):
    return temporal.islands(V.frames(spark, sf), "episode", ORDER, F.col("event_type") != "view")


@query(ISLANDS + "SELECT episode, first + 1 AS first, last - 1 AS last, last - first - 1 AS length FROM isl WHERE last - first - 1 >= 2")
def offscreen_islands(spark, sf):
    return temporal.eroded(hidden(spark, sf), 1, 2)


@query(ISLANDS + "SELECT episode, max(length) AS longest FROM isl GROUP BY episode")
def longest_gap_run(spark, sf):
    return temporal.longest_run(hidden(spark, sf), "episode")


@query(f", m AS (SELECT *, CASE WHEN t - lag(t) OVER ({W}) <= 20000 THEN 0 ELSE 1 END AS fresh FROM frames), s AS (SELECT *, sum(fresh) OVER ({W})::BIGINT AS span FROM m) SELECT episode, span, min(t) AS start, max(t) AS \"end\", count(*) AS n FROM s GROUP BY 1, 2")
def span_coalesce(spark, sf):
    return temporal.coalesced_spans(V.frames(spark, sf), "episode", "t", "seq", 20000)


@query(f", k AS (SELECT episode, seq, t, event_type, lag(event_type) OVER ({W}) AS was, lag(seq) OVER ({W}) AS prior FROM frames WHERE event_type IN ('error', 'signup')) SELECT episode, prior AS \"from\", seq AS \"to\" FROM k WHERE event_type = 'signup' AND was = 'error'")
def event_pairs(spark, sf):
    return temporal.ordered_pairs(V.frames(spark, sf), "episode", ORDER, kind("error"), kind("signup"), "seq")


@query("""SELECT episode, max(t) FILTER (event_type = 'error') AS "from", max(t) FILTER (event_type = 'signup') AS "to" FROM frames GROUP BY 1 HAVING max(t) FILTER (event_type = 'error') IS NOT NULL AND max(t) FILTER (event_type = 'signup') IS NOT NULL""")
def latest_pairs(spark, sf):
    return temporal.latest_pairs(V.frames(spark, sf), "episode", "t", "seq", kind("error"), kind("signup"))


@query(""", a AS (SELECT * FROM frames WHERE event_type = 'purchase'), b AS (SELECT * FROM frames WHERE event_type IN ('error', 'signup'))
SELECT a.seq, (SELECT b.event_type FROM b WHERE b.episode = a.episode AND (b.t, b.seq) < (a.t, a.seq) ORDER BY b.t DESC, b.seq DESC LIMIT 1) AS state FROM a""")
def state_asof(spark, sf):
    return temporal.as_of(V.frames(spark, sf), "episode", ORDER, kind("purchase"), kind("signup") | kind("error"), "event_type", "state").select("seq", "state")


@query(""", a AS (SELECT * FROM frames WHERE event_type = 'purchase') SELECT a.seq, a.episode FROM a WHERE NOT EXISTS (SELECT 1 FROM frames b WHERE b.episode = a.episode AND b.event_type = 'error' AND abs(b.t - a.t) <= 40000)""")
def blackout_free(spark, sf):
    f = V.frames(spark, sf)
    return temporal.blackout(f.where(kind("purchase")).select("seq", "episode", "t"), f.where(kind("error")), "episode", "t", 40000).select("seq", "episode")


@query(", q AS (SELECT DISTINCT episode, t AS query_t FROM frames WHERE event_type = 'purchase') SELECT q.episode, q.query_t, (SELECT count(*) FROM frames f WHERE f.episode = q.episode AND f.t <= q.query_t) AS seen FROM q")
def causal_prefix_counts(spark, sf):
    f = V.frames(spark, sf)
    asks = f.where(kind("purchase")).select("episode", F.col("t").alias("query_t")).distinct()
    return temporal.prefix_counts(asks, f, "episode", "query_t", "t").select("episode", "query_t", "seen")


@query(", q AS (SELECT DISTINCT episode, t AS query_t FROM frames WHERE event_type = 'purchase') SELECT q.episode, q.query_t, greatest(1, (SELECT count(*) FROM frames f WHERE f.episode = q.episode AND f.event_type = 'signup' AND f.t <= q.query_t)) AS intensity FROM q")
def change_intensity(spark, sf):
    f = V.frames(spark, sf)
    asks = f.where(kind("purchase")).select("episode", F.col("t").alias("query_t")).distinct()
    return temporal.change_intensity(asks, f.where(kind("signup")), "episode", "query_t", "t").select("episode", "query_t", "intensity")


@query(f", w AS (SELECT seq, event_type, array_to_string(list(seq) OVER ({W} ROWS BETWEEN 15 PRECEDING AND CURRENT ROW), ',') AS kept, row_number() OVER ({W}) AS seen FROM frames) SELECT seq, kept, seen, greatest(seen - 16, 0) AS evicted FROM w WHERE event_type = 'purchase'")
def last_n_window(spark, sf):
    rows = temporal.last_n(V.frames(spark, sf), "episode", ORDER, 16, "seq").where(kind("purchase"))
    return rows.select("seq", F.array_join(F.transform("kept", lambda x: x.cast("string")), ",").alias("kept"), "seen", "evicted")


@query(", s AS (SELECT seq AS span, episode, t - 3600 AS a, t + 3600 AS b FROM frames WHERE event_type = 'error') SELECT s.span, f.seq FROM s JOIN frames f ON f.episode = s.episode AND f.t BETWEEN s.a AND s.b")
def interval_join_hits(spark, sf):
    f = V.frames(spark, sf)
    spans = f.where(kind("error")).select(F.col("seq").alias("span"), "episode", (F.col("t") - 3600).alias("start"), (F.col("t") + 3600).alias("end"))
    return temporal.interval_hits(f.select("seq", "episode", "t"), spans, "episode", "t", 3600).select("span", "seq")


@query(f", e AS (SELECT episode, t AS a, lead(t) OVER ({W}) AS b FROM frames WHERE event_type = 'error') SELECT f.seq, e.a AS since, e.b AS until FROM frames f JOIN e ON f.episode = e.episode WHERE f.event_type = 'signup' AND f.t >= e.a AND f.t + 10 <= e.b")
def hidden_gap_changes(spark, sf):
    f = V.frames(spark, sf)
    visits = f.where(kind("error")).select("episode", F.col("t").alias("start"), F.col("t").alias("end"))
    segments = f.where(kind("signup")).select("seq", "episode", F.col("t").alias("start"), (F.col("t") + 10).alias("end"))
    return temporal.inside_gaps(segments, visits, "episode").select("seq", "since", "until")


@query(""", m AS (SELECT episode, min(t) FILTER (event_type = 'signup') AS first_a, min(t) FILTER (event_type = 'error') AS first_b FROM frames GROUP BY 1)
SELECT episode, first_a, first_b, CASE WHEN first_a < first_b THEN 'a' WHEN first_b < first_a THEN 'b' ELSE 'undecided' END AS "order" FROM m""")
def pair_order_decided(spark, sf):
    return temporal.decided_order(V.frames(spark, sf), "episode", "t", kind("signup"), kind("error"))


@query(f", l AS (SELECT episode, seq, t, event_type, lag(event_type) OVER ({W}) AS b FROM frames), c AS (SELECT episode, seq, event_type AS now, lag(event_type) OVER ({W}) AS was FROM l WHERE b = event_type) SELECT episode, seq, was, now FROM c WHERE was <> now")
def two_sample_confirmed_transition(spark, sf):
    return temporal.confirmed_changes(V.frames(spark, sf), "episode", ORDER, "event_type", "seq")


@query(", r AS (SELECT episode, seq, row_number() OVER (PARTITION BY episode ORDER BY t DESC, seq DESC) AS rank FROM frames WHERE event_type = 'signup') SELECT * FROM r WHERE rank <= 2")
def last_two_returns(spark, sf):
    return temporal.last_two(V.frames(spark, sf), "episode", "t", "seq", kind("signup")).select("episode", "seq", "rank")


@query(f", v AS (SELECT seq, episode, t, floor(abs(value))::BIGINT % 90 AS frames FROM frames WHERE event_type = 'view') SELECT seq, row_number() OVER ({W}) AS visit, frames, sum(frames + 12) OVER ({W})::BIGINT - frames - 12 AS output_start FROM v")
def visit_index_clock(spark, sf):
    views = V.frames(spark, sf).where("event_type = 'view'")
    return temporal.visit_clock(views, "episode", ORDER, F.floor(F.abs("value")) % 90, 12).select("seq", "visit", "frames", "output_start")


@query(f"SELECT seq, episode * 100000 + row_number() OVER ({W}) AS number FROM frames")
def running_ids(spark, sf):
    return temporal.running_ids(V.frames(spark, sf), "episode", ORDER, F.col("episode") * 100000).select("seq", "number")


@query(f", l AS (SELECT *, lag(event_type) OVER ({W}) AS b FROM frames) SELECT seq, sum(CASE WHEN event_type = b THEN 0 ELSE 1 END) OVER ({W})::BIGINT AS stretch FROM l")
def consecutive_groups(spark, sf):
    return temporal.group_changes(V.frames(spark, sf), "episode", ORDER, "event_type").select("seq", "stretch")


@query(f", a AS (SELECT *, (seq * 97) % 360 AS angle FROM frames), l AS (SELECT *, lag(angle) OVER ({W}) AS b FROM a) SELECT seq, sum(coalesce((((angle - b + 180) % 360 + 360) % 360) - 180, angle)) OVER ({W})::BIGINT AS unwrapped FROM l")
def yaw_unwrap(spark, sf):
    rows = V.frames(spark, sf).withColumn("angle", F.col("seq") * 97 % 360)
    return temporal.unwrapped(rows, "episode", ORDER, "angle").select("seq", "unwrapped")


@query(f", a AS (SELECT *, (seq * 31 % 100)::DOUBLE AS x, (seq * 17 % 100)::DOUBLE AS y FROM frames), l AS (SELECT *, lag(x) OVER ({W}) AS px, lag(y) OVER ({W}) AS py FROM a) SELECT seq, round(sum(coalesce(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 0)) OVER ({W}), 4) AS walked FROM l")
def polyline_length(spark, sf):
    rows = V.frames(spark, sf).withColumn("x", (F.col("seq") * 31 % 100).cast("double")).withColumn("y", (F.col("seq") * 17 % 100).cast("double"))
    return temporal.path_length(rows, "episode", ORDER, "x", "y").select("seq", F.round("walked", 4).alias("walked"))


@query(f", a AS (SELECT *, seq % 50 AS frame FROM frames), l AS (SELECT *, lag(frame) OVER ({W}) AS b FROM a) SELECT seq, sum(CASE WHEN frame < b THEN 1 ELSE 0 END) OVER ({W})::BIGINT AS epoch FROM l")
def clock_epochs(spark, sf):
    return temporal.aligned_clock(V.frames(spark, sf).withColumn("frame", F.col("seq") % 50), "episode", ORDER, "frame").select("seq", "epoch")


@query(", e AS (SELECT seq, episode, t AS a, t + 600 AS b FROM frames WHERE event_type = 'error') SELECT e.seq, max(f.t) FILTER (f.t < e.a) AS before, min(f.t) FILTER (f.t > e.b) AS after FROM e JOIN frames f ON f.episode = e.episode GROUP BY e.seq")
def retimed_events(spark, sf):
    f = V.frames(spark, sf)
    spans = f.where(kind("error")).select("seq", "episode", F.col("t").alias("start"), (F.col("t") + 600).alias("end"))
    return temporal.retimed(spans, f, "episode").select("seq", "before", "after")


@query("SELECT episode, t // 7200 AS bin, event_type, count(*) AS n FROM frames GROUP BY 1, 2, 3")
def tumbling_bins(spark, sf):
    return V.frames(spark, sf).groupBy("episode", F.floor(F.col("t") / 7200).alias("bin"), "event_type").agg(F.count("*").alias("n"))


@query(""", d AS (SELECT doc_id, n_chars::DOUBLE AS d, greatest(1, n_chars // 300 + CASE WHEN n_chars % 300 >= 45 THEN 1 ELSE 0 END) AS k FROM documents), w AS (SELECT doc_id, d, k, unnest(range(k)) AS i FROM d)
SELECT doc_id, i * 300e0 AS start, CASE WHEN i = k - 1 THEN d ELSE (i + 1) * 300e0 END AS "end" FROM w""")
def tumbling_tail_merge(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("d"))
    return docs.select("doc_id", F.inline(X.processing_windows(F.col("d"), 300.0, 45.0)))


@query(""", v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), l AS (SELECT vec_id, e, lag(e) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM v),
c AS (SELECT vec_id, list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i] * p[i])) / sqrt(list_sum(list_transform(e, lambda x: x * x)) * list_sum(list_transform(p, lambda x: x * x))) AS c FROM l WHERE p IS NOT NULL) SELECT vec_id, round(c, 4) AS cosine, c > 0.5 AS dropped FROM c""")
def cosine_state_drop(spark, sf):
    from pyspark.sql import Window

    rows = V.table(spark, sf, "embeddings").withColumn("p", F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).where("p is not null")
    c = X.cosine(F.col("embedding"), F.col("p"))
    return rows.select("vec_id", F.round(c, 4).alias("cosine"), (c > 0.5).alias("dropped"))


GENERATED = """, q AS (
  SELECT episode, 'factual_retrieval' AS question_type, t::DOUBLE AS query_time, 'What happened at ' || seq || '?' AS question, event_type AS answer FROM frames
  UNION ALL SELECT episode, 'temporal_reasoning', t, 'What came just before the ' || event_type || ' at ' || seq || '?', b FROM (SELECT *, lag(event_type) OVER (PARTITION BY episode ORDER BY seq) AS b FROM frames) WHERE b IS NOT NULL
  UNION ALL SELECT episode, 'history_aggregation', t, 'How many error events so far?', (row_number() OVER (PARTITION BY episode ORDER BY seq))::VARCHAR FROM frames WHERE event_type = 'error'
  UNION ALL SELECT episode, 'current_state', t, 'Is it visible now?', CASE s WHEN 'signup' THEN 'visible' WHEN 'error' THEN 'hidden' ELSE 'cannot tell' END FROM (
    SELECT *, last_value(CASE WHEN event_type IN ('signup', 'error') THEN event_type END IGNORE NULLS) OVER (PARTITION BY episode ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM frames) WHERE event_type = 'purchase'
  UNION ALL SELECT episode, 'state_change', t, 'What changed?', b || ' to ' || event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY episode ORDER BY seq) AS b FROM frames) WHERE b <> event_type
  UNION ALL SELECT episode, 'object_tracking', t, 'When did it return?', n::VARCHAR FROM (SELECT *, lead(event_type) OVER (PARTITION BY episode ORDER BY seq) AS nt, lead(seq) OVER (PARTITION BY episode ORDER BY seq) AS n FROM frames WHERE event_type IN ('signup', 'error')) WHERE event_type = 'error' AND nt = 'signup')
"""


@query(GENERATED + "SELECT * FROM q")
def generated_questions(spark, sf):
    return generate.questions(V.frames(spark, sf), "signup", "error", "purchase")


@query(GENERATED + "SELECT question_type, answer, count(*) AS n, min(query_time) AS first FROM q WHERE question_type IN ('current_state', 'state_change') GROUP BY 1, 2")
def generated_profile(spark, sf):
    rows = generated_questions(spark, sf).where("question_type in ('current_state', 'state_change')")
    return rows.groupBy("question_type", "answer").agg(F.count("*").alias("n"), F.min("query_time").alias("first"))
