"""Queries on reruns, subsets' bootstraps, wording, tags, quotas and frame sampling."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalars as X
from tidemark.operators.running import cumulated
from tidemark.operators import items as I
from tidemark.operators import scoring, selection, temporal
from tidemark.plans import views as V
from tidemark.plans.registry import registry
from tidemark.sources import records
from tidemark.streaming import streams

QUERIES, ORACLES, query = registry()


@query("SELECT count(*) FILTER (p.id IS NOT NULL) AS covered, count(*) FILTER (p.id IS NULL) AS missing, count(*) FILTER (p.id IS NOT NULL AND i.n_chars % 13 = 0) AS changed FROM items i LEFT JOIN (SELECT id FROM preds WHERE id % 9 <> 0) p USING (id)")
def rescore_coverage(spark, sf):
    """Predictions against a subset: covered, missing, and those whose question changed since."""
    rows = V.items(spark, sf).join(V.preds(spark, sf).where("id % 9 <> 0").select("id", F.lit(True).alias("_p")), "id", "left")
    has = F.col("_p").isNotNull()
    return rows.agg(F.count_if(has).alias("covered"), F.count_if(~has).alias("missing"), F.count_if(has & (F.col("n_chars") % 13 == 0)).alias("changed"))


@query(""", s AS (SELECT question_type, episode_id, count(*) FILTER (known) AS k, count(*) FILTER (known AND correct) AS kc, count(*) FILTER (NOT known) AS u, count(*) FILTER (NOT known AND abstained) AS ua,
  row_number() OVER (PARTITION BY question_type ORDER BY episode_id) - 1 AS slot, count(*) OVER (PARTITION BY question_type) AS n FROM outs GROUP BY 1, 2),
d AS (SELECT r.range AS rep, s.question_type, ('0x' || substr(md5(r.range || ':' || s.slot), 1, 8))::BIGINT % s.n AS slot FROM range(100) r, s),
h AS (SELECT rep, question_type, sum(kc)::DOUBLE / nullif(sum(k), 0) AS ka, sum(ua)::DOUBLE / nullif(sum(u), 0) AS ar FROM d JOIN s USING (question_type, slot) GROUP BY 1, 2),
m AS (SELECT rep, avg(CASE WHEN ka + ar = 0 THEN 0e0 ELSE 2 * ka * ar / (ka + ar) END) AS h FROM h GROUP BY rep HAVING count(ka + ar) = (SELECT count(DISTINCT question_type) FROM outs))
SELECT round(quantile_cont(h, 0.025), 6) AS low, round(quantile_cont(h, 0.975), 6) AS high, count(*) AS replicates FROM m""")
def macro_bootstrap(spark, sf, replicates=100):
    """Mean h over subsets, clusters drawn within each; replicates in which a subset is undefined are left out."""
    outs = V.outs(spark, sf)
    stats = outs.groupBy("question_type", "episode_id").agg(F.count_if("known").alias("k"), F.count_if(F.col("known") & F.col("correct")).alias("kc"), F.count_if(~F.col("known")).alias("u"), F.count_if(~F.col("known") & F.col("abstained")).alias("ua"))
    part = W.partitionBy("question_type")
    stats = stats.withColumn("slot", F.row_number().over(part.orderBy("episode_id")) - 1).withColumn("n", F.count("*").over(part))
    plan = stats.select("question_type", "n", F.col("slot").alias("turn"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", "rep", "turn")), 1, 8), 16, 10).cast("long") % F.col("n")
    sums = plan.select("rep", "question_type", drawn.alias("slot")).join(stats.drop("n"), ["question_type", "slot"]).groupBy("rep", "question_type").agg(*[F.sum(c).alias(c) for c in ("k", "kc", "u", "ua")])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    each = sums.withColumn("h", scoring.harmonic(ratio("kc", "k"), ratio("ua", "u")))
    kinds = outs.select("question_type").distinct().count()
    means = each.groupBy("rep").agg(F.avg("h").alias("h"), F.count("h").alias("c")).where(F.col("c") == kinds)
    return means.agg(F.round(F.percentile("h", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("h", F.lit(0.975)), 6).alias("high"), F.count("*").alias("replicates"))


@query(ORACLES["macro_bootstrap"].replace("range(100)", "range(1000)"))
def macro_bootstrap_full(spark, sf):
    """The plan of the reference: 1,000 replicates."""
    return macro_bootstrap(spark, sf, 1000)


@query(", c AS (SELECT episode, count(*) AS seen FROM frames GROUP BY episode) SELECT count(*) AS episodes, max(seen) AS most_seen, sum(greatest(seen - 16, 0))::BIGINT AS evictions, count(*) FILTER (seen > 100) AS leaks FROM c")
def streaming_audit(spark, sf):
    seen = V.frames(spark, sf).groupBy("episode").agg(F.count("*").alias("seen")).withColumn("evicted", F.greatest(F.col("seen") - 16, F.lit(0)))
    return streams.audit(seen, F.col("seen") > 100)


@query(", r AS (SELECT episode, seq, t, row_number() OVER (PARTITION BY episode ORDER BY sha256('shuffle:' || seq)) AS k, row_number() OVER (PARTITION BY episode ORDER BY t, seq) AS n FROM frames) SELECT a.seq, b.t AS shown_at FROM r a JOIN r b ON a.episode = b.episode AND a.k = b.n")
def shuffled_frames(spark, sf):
    """Frames in an order by hash, with the times of the true order."""
    f = V.frames(spark, sf).select("episode", "seq", "t")
    by = W.partitionBy("episode")
    mixed = f.withColumn("k", F.row_number().over(by.orderBy(F.sha2(F.concat(F.lit("shuffle:"), F.col("seq").cast("string")), 256))))
    true = f.select("episode", F.col("t").alias("shown_at"), F.row_number().over(by.orderBy("t", "seq")).alias("k"))
    return mixed.join(true, ["episode", "k"]).select("seq", "shown_at")


@query(", q AS (SELECT seq, episode, t, lag(t) OVER (PARTITION BY episode ORDER BY t, seq) AS since FROM frames WHERE event_type = 'purchase') SELECT q.seq AS id, count(*) AS fresh FROM q JOIN frames f ON f.episode = q.episode AND f.t <= q.t + 1e-6 AND (q.since IS NULL OR f.t > q.since + 1e-6) GROUP BY q.seq")
def incremental_prefixes(spark, sf):
    f = V.frames(spark, sf)
    asks = f.where("event_type = 'purchase'").select("episode", F.col("seq").alias("id"), F.col("t").cast("double").alias("query_time"))
    return streams.prefix_frames(f.select("episode", "t"), asks, "episode").groupBy("id").agg(F.count("*").alias("fresh"))


TEMPLATES = ", t AS (SELECT * FROM (VALUES ('en', 0, 'Where is {x}?'), ('en', 1, 'Can you see {x}?'), ('fr', 0, 'Ou est {x}?'), ('de', 0, 'Wo ist {x}?'), ('de', 1, 'Siehst du {x}?'), ('de', 2, 'Ist {x} da?'), ('es', 0, 'Donde esta {x}?')) v(question_type, slot, template)), n AS (SELECT question_type, count(*) AS n FROM t GROUP BY 1)"


@query(TEMPLATES + " SELECT i.id, replace(t.template, '{x}', i.episode_id) AS question FROM items i JOIN n USING (question_type) JOIN t ON t.question_type = i.question_type AND t.slot = i.id % n.n")
def template_wording(spark, sf):
    rows = [("en", 0, "Where is {x}?"), ("en", 1, "Can you see {x}?"), ("fr", 0, "Ou est {x}?"), ("de", 0, "Wo ist {x}?"), ("de", 1, "Siehst du {x}?"), ("de", 2, "Ist {x} da?"), ("es", 0, "Donde esta {x}?")]
    templates = spark.createDataFrame(rows, "question_type string, slot long, template string")
    items = V.items(spark, sf).select("id", "question_type", F.col("id").alias("ordinal"), F.col("episode_id").alias("subject"))
    return I.templated(items, templates).select("id", "question")


@query(", r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM items WHERE NOT known) SELECT id, CASE WHEN (17 * k + 3) % n < n // 3 THEN 'occluded' WHEN k % 2 = 0 THEN 'out_of_view' ELSE 'ambiguous' END AS source FROM r")
def uncertainty_tags(spark, sf):
    """Sources by fixed shares over spread places; every uncertain item gets one. Items are numbered range by range."""
    rows = V.items(spark, sf).where("not known").select("id")
    tagged = cumulated(rows, [F.col("id")], k=F.lit(1)).withColumn("k", F.col("k") - 1).crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))
    return tagged.select("id", F.when((17 * F.col("k") + 3) % F.col("n") < F.floor(F.col("n") / 3), "occluded").when(F.col("k") % 2 == 0, "out_of_view").otherwise("ambiguous").alias("source"))


@query(""", q AS (SELECT question_type, known, greatest(1, count(*) // 10) AS quota FROM items GROUP BY 1, 2), e AS (SELECT *, row_number() OVER (PARTITION BY episode_id, question_type, known ORDER BY sha256('quota:' || id)) AS turn FROM items),
r AS (SELECT id, question_type, known, row_number() OVER (PARTITION BY question_type, known ORDER BY turn, sha256('quota:' || id)) AS place FROM e) SELECT id FROM r JOIN q USING (question_type, known) WHERE place <= quota""")
def quota_selection(spark, sf):
    """Exact quotas of type and status, filled in rounds over episodes."""
    rows = V.items(spark, sf)
    h = F.sha2(F.concat(F.lit("quota:"), F.col("id").cast("string")), 256)
    quota = rows.groupBy("question_type", "known").agg(F.greatest(F.lit(1), F.floor(F.count("*") / 10)).alias("quota"))
    rounds = rows.withColumn("turn", F.row_number().over(W.partitionBy("episode_id", "question_type", "known").orderBy(h)))
    placed = rounds.withColumn("place", F.row_number().over(W.partitionBy("question_type", "known").orderBy("turn", h)))
    return placed.join(quota, ["question_type", "known"]).where("place <= quota").select("id")


@query(", n AS (SELECT seq, episode, event_type, row_number() OVER (PARTITION BY episode, event_type ORDER BY seq) - 1 AS k FROM frames) SELECT seq, CASE WHEN k % 2 = 0 THEN 'disappear' ELSE 'appear' END AS kind, k // 2 AS pair FROM n")
def planned_pairs(spark, sf):
    """Occurrences of a target in turn: it goes, it comes back."""
    k = F.row_number().over(W.partitionBy("episode", "event_type").orderBy("seq")) - 1
    rows = V.frames(spark, sf).withColumn("k", k)
    return rows.select("seq", F.when(F.col("k") % 2 == 0, "disappear").otherwise("appear").alias("kind"), F.floor(F.col("k") / 2).alias("pair"))


@query(""", m AS (SELECT episode, event_type AS k, min(t) AS t FROM frames GROUP BY 1, 2), q AS (SELECT DISTINCT episode, (t // 100000) * 100000 AS at FROM frames)
SELECT q.episode, q.at, a.k AS x, b.k AS y, CASE WHEN a.t <= q.at AND b.t <= q.at AND a.t <> b.t THEN 'known' ELSE 'uncertain' END AS status FROM q JOIN m a ON a.episode = q.episode JOIN m b ON b.episode = q.episode AND a.k < b.k""")
def order_questions(spark, sf):
    """Pairs asked at several times: known if their order can be told by then."""
    f = V.frames(spark, sf)
    first = f.groupBy("episode", F.col("event_type").alias("k")).agg(F.min("t").alias("t"))
    asks = f.select("episode", (F.floor(F.col("t") / 100000) * 100000).alias("at")).distinct()
    a, b = first.select("episode", F.col("k").alias("x"), F.col("t").alias("tx")), first.select("episode", F.col("k").alias("y"), F.col("t").alias("ty"))
    known = (F.col("tx") <= F.col("at")) & (F.col("ty") <= F.col("at")) & (F.col("tx") != F.col("ty"))
    return asks.join(a, "episode").join(b, "episode").where("x < y").select("episode", "at", "x", "y", F.when(known, "known").otherwise("uncertain").alias("status"))


@query(f", c AS (SELECT seq, row_number() OVER (PARTITION BY episode ORDER BY seq) AS n FROM frames WHERE event_type = 'error') SELECT seq, n, array_to_string(list_sort(list_distinct([n, CASE WHEN n > 1 THEN n - 1 ELSE n + 3 END, n + 1, n + 2])), ',') AS options FROM c")
def count_distractors(spark, sf):
    """A running count with near misses as options."""
    n = F.row_number().over(W.partitionBy("episode").orderBy("seq")).cast("long")
    rows = V.frames(spark, sf).where("event_type = 'error'").withColumn("n", n)
    options = F.array_sort(X.ordered_distinct(F.array(F.col("n"), F.when(F.col("n") > 1, F.col("n") - 1).otherwise(F.col("n") + 3), F.col("n") + 1, F.col("n") + 2)))
    return rows.select("seq", "n", F.array_join(F.transform(options, lambda x: x.cast("string")), ",").alias("options"))


@query("SELECT doc_id, unnest(range((ceil((n_chars + 1) / 30e0))::BIGINT)) * 30 AS frame FROM documents")
def fixed_rate_frames(spark, sf):
    videos = V.table(spark, sf, "documents").select("doc_id", (F.col("n_chars") + 1).alias("frames"), F.lit(30.0).alias("source_fps"))
    return records.frame_grid(videos, 1.0).select("doc_id", "frame")


@query("SELECT doc_id, round_even(k * (n_chars - 1) / 7e0, 0)::BIGINT AS frame FROM (SELECT doc_id, n_chars, unnest(range(8)) AS k FROM documents)")
def linspace_frames(spark, sf):
    videos = V.table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("frames"))
    return records.frame_linspace(videos, F.lit(8)).select("doc_id", "frame")


@query("SELECT question_type, known, count(*) AS n, arg_min(id, sha256('pick:' || id)) AS pick FROM items GROUP BY 1, 2")
def hash_pick(spark, sf):
    """One item of each stratum by hash."""
    h = F.sha2(F.concat(F.lit("pick:"), F.col("id").cast("string")), 256)
    return V.items(spark, sf).groupBy("question_type", "known").agg(F.count("*").alias("n"), F.min_by("id", h).alias("pick"))


@query(", p AS (SELECT episode, t, max(event_type) AS s FROM frames GROUP BY 1, 2), l AS (SELECT *, lag(s) OVER (PARTITION BY episode ORDER BY t) AS was FROM p) SELECT s, was, count(*) AS n FROM l WHERE was IS NOT NULL GROUP BY 1, 2")
def transition_matrix(spark, sf):
    w = W.partitionBy("episode").orderBy("t")
    states = V.frames(spark, sf).groupBy("episode", "t").agg(F.max("event_type").alias("s")).withColumn("was", F.lag("s").over(w)).where("was is not null")
    return states.groupBy("s", "was").agg(F.count("*").alias("n"))


@query()
def farthest_frames(spark, sf):
    """Times chosen one by one, each farthest from those chosen; every choice depends on the last, so an episode is one fold."""

    def fold(rows: list[dict]) -> list[dict]:
        times = sorted({r["t"] for r in rows})
        chosen = [times[0], times[-1]] if len(times) > 1 else times
        while len(chosen) < min(6, len(times)):
            chosen.append(max((t for t in times if t not in chosen), key=lambda t: (min(abs(t - c) for c in chosen), -t)))
        return [{"episode": rows[0]["episode"], "t": t, "turn": k} for k, t in enumerate(chosen)]

    return selection.folded(V.frames(spark, sf).select("episode", "t"), "episode", ["t"], "episode long, t long, turn long", fold)


@query("SELECT episode, count(*) AS n, min(gap) AS least FROM (SELECT episode, lead(t) OVER (PARTITION BY episode ORDER BY t, seq) - t AS gap FROM frames) WHERE gap IS NOT NULL GROUP BY episode")
def gap_profile(spark, sf):
    return temporal.gaps(V.frames(spark, sf), "episode", "t", "seq").where("gap is not null").groupBy("episode").agg(F.count("*").alias("n"), F.min("gap").alias("least"))
