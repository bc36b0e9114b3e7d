"""Queries on predictions, agreement, leakage and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as X
from tidemark.operators import agreement, audit, distribution, scoring
from tidemark.plans import views as V
from tidemark.plans.registry import hash_int, registry

QUERIES, ORACLES, query = registry()

MEASURES = """count(*) AS n, count(*) FILTER (known) AS n_known, count(*) FILTER (NOT known) AS n_uncertain,
  round(avg(CASE WHEN correct THEN 1e0 ELSE 0e0 END), 6) AS accuracy, round(avg(CASE WHEN known THEN CASE WHEN correct THEN 1e0 ELSE 0e0 END END), 6) AS ka,
  round(avg(CASE WHEN NOT known THEN CASE WHEN abstained THEN 1e0 ELSE 0e0 END END), 6) AS ar, round(avg(CASE WHEN known THEN CASE WHEN abstained THEN 1e0 ELSE 0e0 END END), 6) AS far,
  round(avg(CASE WHEN abstained THEN CASE WHEN known THEN 0e0 ELSE 1e0 END END), 6) AS abstention_precision, round(avg(CASE WHEN abstained THEN 0e0 ELSE 1e0 END), 6) AS coverage,
  round(avg(CASE WHEN NOT abstained THEN CASE WHEN correct THEN 0e0 ELSE 1e0 END END), 6) AS risk, round(avg(er::DOUBLE), 6) AS er,
  round(CASE WHEN avg(CASE WHEN known THEN CASE WHEN correct THEN 1e0 ELSE 0e0 END END) + avg(CASE WHEN NOT known THEN CASE WHEN abstained THEN 1e0 ELSE 0e0 END END) = 0 THEN 0e0
    ELSE 2 * avg(CASE WHEN known THEN CASE WHEN correct THEN 1e0 ELSE 0e0 END END) * avg(CASE WHEN NOT known THEN CASE WHEN abstained THEN 1e0 ELSE 0e0 END END)
      / (avg(CASE WHEN known THEN CASE WHEN correct THEN 1e0 ELSE 0e0 END END) + avg(CASE WHEN NOT known THEN CASE WHEN abstained THEN 1e0 ELSE 0e0 END END)) END, 6) AS h,
  round(avg(CASE WHEN invalid THEN 1e0 ELSE 0e0 END), 6) AS invalid_rate"""
INTENSITY = "CASE WHEN change_intensity BETWEEN 1 AND 3 THEN 'low' WHEN change_intensity BETWEEN 4 AND 6 THEN 'medium' WHEN change_intensity BETWEEN 7 AND 10 THEN 'high' END"
AGE = "CASE WHEN query_time - span_end >= 0 AND query_time - span_end < 10 THEN 'lt10s' WHEN query_time - span_end >= 10 THEN 'ge10s' END"


@query(f"SELECT {MEASURES} FROM outs")
def selective_summary(spark, sf):
    return scoring.summary(V.outs(spark, sf))


@query(f"SELECT question_type, {MEASURES} FROM outs GROUP BY question_type")
def selective_by_type(spark, sf):
    return scoring.summary(V.outs(spark, sf), "question_type")


@query(f"SELECT {INTENSITY} AS intensity, {MEASURES} FROM outs WHERE {INTENSITY} IS NOT NULL GROUP BY 1")
def selective_by_intensity(spark, sf):
    return scoring.summary(V.outs(spark, sf), X.intensity_bin(F.col("change_intensity")).alias("intensity"))


@query(f"SELECT {AGE} AS age, {MEASURES} FROM outs WHERE {AGE} IS NOT NULL GROUP BY 1")
def selective_by_age(spark, sf):
    return scoring.summary(V.outs(spark, sf), X.age_bin(F.col("query_time") - F.col("span_end")).alias("age"))


@query(f"SELECT CASE WHEN span_end < query_time - 15 - 1e-6 THEN 'earlier' ELSE 'last16' END AS evidence, {MEASURES} FROM outs GROUP BY 1")
def selective_by_window(spark, sf):
    return scoring.summary(V.outs(spark, sf), X.evidence_window(F.col("query_time"), F.col("span_end"), 16).alias("evidence"))


@query("""SELECT CASE WHEN change_intensity <= 3 THEN 'low' WHEN change_intensity <= 6 THEN 'medium' ELSE 'high' END AS bin,
  CASE WHEN query_time - span_end >= 10 THEN 'ge10s' ELSE 'lt10s' END AS age, count(*) AS n FROM items GROUP BY 1, 2""")
def filter_bins(spark, sf):
    return V.items(spark, sf).groupBy(X.intensity_bin(F.col("change_intensity"), "filter").alias("bin"), X.age_bin(F.col("query_time") - F.col("span_end"), "filter").alias("age")).agg(F.count("*").alias("n"))


@query(""", s AS (SELECT episode_id, count(*) FILTER (known) AS k, count(*) FILTER (NOT known) AS u, avg(CASE WHEN known THEN CASE WHEN correct THEN 1e0 ELSE 0e0 END END) AS ka,
  avg(CASE WHEN NOT known THEN CASE WHEN abstained THEN 1e0 ELSE 0e0 END END) AS ar FROM outs GROUP BY 1),
p AS (SELECT count(*) AS subsets, sum(ka * k) / sum(k) AS ka, sum(ar * u) / sum(u) AS ar, avg(CASE WHEN ka + ar = 0 THEN 0e0 ELSE 2 * ka * ar / (ka + ar) END) AS mh FROM s)
SELECT subsets, round(ka, 6) AS pooled_ka, round(ar, 6) AS pooled_ar, round(CASE WHEN ka + ar = 0 THEN 0e0 ELSE 2 * ka * ar / (ka + ar) END, 6) AS pooled_h, round(mh, 6) AS macro_h FROM p""")
def pooled_vs_macro_h(spark, sf):
    return scoring.pooled_and_macro(V.outs(spark, sf), "episode_id")


@query(""", s AS (SELECT episode_id, count(*) FILTER (known) AS k, count(*) FILTER (known AND correct) AS kc, count(*) FILTER (NOT known) AS u, count(*) FILTER (NOT known AND abstained) AS ua,
    row_number() OVER (ORDER BY episode_id) - 1 AS slot FROM outs GROUP BY 1),
plan AS (SELECT r.range AS rep, ('0x' || substr(md5(r.range::VARCHAR || ':' || s.slot::VARCHAR), 1, 8))::BIGINT % (SELECT count(*) FROM s) AS slot FROM range(200) r, s),
d AS (SELECT rep, sum(kc)::DOUBLE / sum(k) AS ka, sum(ua)::DOUBLE / sum(u) AS ar FROM plan JOIN s USING (slot) GROUP BY rep),
v AS (SELECT CASE WHEN ka + ar = 0 THEN 0e0 ELSE 2 * ka * ar / (ka + ar) END AS h FROM d),
o AS (SELECT h, row_number() OVER (ORDER BY h) - 1 AS i, count(*) OVER () AS n FROM v WHERE h IS NOT NULL)
SELECT round(max(CASE WHEN i = floor(0.025e0 * (n - 1)) THEN h END), 6) AS low, round(max(CASE WHEN i = floor(0.975e0 * (n - 1)) THEN h END), 6) AS high, count(*) AS replicates FROM o""")
def bootstrap_ci_h(spark, sf):
    return scoring.bootstrap(V.outs(spark, sf), "episode_id", 200)


@query(ORACLES["bootstrap_ci_h"].replace("range(200)", "range(1000)"))
def bootstrap_ci_h_full(spark, sf):
    """The plan of the reference: 1,000 replicates."""
    return scoring.bootstrap(V.outs(spark, sf), "episode_id", 1000)


@query(""", s AS (SELECT episode_id, count(*) AS m, sum(er)::DOUBLE AS e, count(*) FILTER (correct) AS c, count(*) FILTER (known) AS k, count(*) FILTER (known AND correct) AS kc, count(*) FILTER (NOT known) AS u,
    count(*) FILTER (NOT known AND abstained) AS ua, row_number() OVER (ORDER BY episode_id) - 1 AS slot FROM outs GROUP BY 1),
plan AS (SELECT r.range AS rep, ('0x' || substr(md5(r.range::VARCHAR || ':' || s.slot::VARCHAR), 1, 8))::BIGINT % (SELECT count(*) FROM s) AS slot FROM range(1000) r, s WHERE (SELECT count(*) FROM s) > 1),
d AS (SELECT rep, sum(kc)::DOUBLE / sum(k) AS ka, sum(ua)::DOUBLE / sum(u) AS ar, sum(e) / sum(m) AS er, sum(c)::DOUBLE / sum(m) AS accuracy FROM plan JOIN s USING (slot) GROUP BY rep),
v AS (SELECT 'er' AS measure, er AS v FROM d UNION ALL SELECT 'ka', ka FROM d UNION ALL SELECT 'ar', ar FROM d UNION ALL SELECT 'accuracy', accuracy FROM d
  UNION ALL SELECT 'h', CASE WHEN ka + ar = 0 THEN 0e0 ELSE 2 * ka * ar / (ka + ar) END FROM d),
o AS (SELECT measure, v, row_number() OVER (PARTITION BY measure ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY measure) AS n FROM v WHERE v IS NOT NULL)
SELECT measure, round(max(CASE WHEN i = floor(0.025e0 * (n - 1)) THEN v END), 6) AS low, round(max(CASE WHEN i = floor(0.975e0 * (n - 1)) THEN v END), 6) AS high, count(*) AS replicates FROM o GROUP BY measure""")
def bootstrap_measures(spark, sf):
    """Intervals of all five measures from 1,000 replicates."""
    return scoring.bootstrap_measures(V.outs(spark, sf), "episode_id", 1000)


@query("SELECT coalesce(pred_index::VARCHAR, 'INVALID') AS choice, count(*) AS n FROM preds GROUP BY 1")
def choice_distribution(spark, sf):
    return scoring.choice_distribution(V.preds(spark, sf))


@query("""SELECT a.abstained, coalesce((i.id * 5 + i.n_chars) % 3 = i.answer, false) AS forced_correct, count(*) AS n FROM outs a JOIN items i USING (id) WHERE a.known GROUP BY 1, 2""")
def forced_pairing(spark, sf):
    items = V.items(spark, sf)
    forced = scoring.outcomes(items, items.select("id", ((F.col("id") * 5 + F.col("n_chars")) % 3).alias("pred_index")))
    return scoring.paired(V.outs(spark, sf), forced)


@query(""", s AS (SELECT id, known, correct, change_intensity AS score FROM outs), t AS (SELECT DISTINCT score FROM s),
c AS (SELECT t.score, sum(CASE WHEN s.known AND s.correct AND s.score < t.score THEN 1 ELSE 0 END)::DOUBLE / sum(CASE WHEN s.known THEN 1 ELSE 0 END) AS ka,
  sum(CASE WHEN NOT s.known AND s.score >= t.score THEN 1 ELSE 0 END)::DOUBLE / sum(CASE WHEN NOT s.known THEN 1 ELSE 0 END) AS ar FROM t, s GROUP BY t.score)
SELECT score, round(CASE WHEN ka + ar = 0 THEN 0e0 ELSE 2 * ka * ar / (ka + ar) END, 6) AS h FROM c ORDER BY 2 DESC, 1 DESC LIMIT 1""")
def blind_agent_threshold(spark, sf):
    return scoring.blind_threshold(V.outs(spark, sf).withColumn("score", F.col("change_intensity")))


@query(""", p AS (SELECT question_type, known, count(*) AS whole FROM items GROUP BY 1, 2), a AS (SELECT * FROM outs WHERE id % 3 = 0), m AS (SELECT question_type, known, count(*) AS own FROM a GROUP BY 1, 2)
SELECT round(sum(CASE WHEN a.correct THEN whole::DOUBLE / own ELSE 0e0 END) / sum(whole::DOUBLE / own), 6) AS agreement, count(*) AS n FROM a JOIN p USING (question_type, known) JOIN m USING (question_type, known)""")
def annotator_reweight(spark, sf):
    return scoring.reweighted(V.outs(spark, sf).where("id % 3 = 0"), V.items(spark, sf), "question_type", "known")


RATED = ", r AS (SELECT id, CASE WHEN known THEN 'k' ELSE 'u' END AS a, CASE WHEN id % 7 = 0 THEN 'u' ELSE 'k' END AS b, CASE WHEN n_chars % 5 = 0 THEN 'u' WHEN n_chars % 11 = 0 THEN 'x' ELSE 'k' END AS c FROM items)"


def rated(spark, sf):
    n = F.col("n_chars")
    return V.items(spark, sf).select("id", F.when(F.col("known"), "k").otherwise("u").alias("a"), F.when(F.col("id") % 7 == 0, "u").otherwise("k").alias("b"), F.when(n % 5 == 0, "u").when(n % 11 == 0, "x").otherwise("k").alias("c"))


@query(RATED + """, n AS (SELECT count(*)::DOUBLE AS n, avg(CASE WHEN a = b THEN 1e0 ELSE 0e0 END) AS po FROM r), p AS (SELECT a AS v, count(*) AS k FROM r GROUP BY 1), q AS (SELECT b AS v, count(*) AS k FROM r GROUP BY 1),
e AS (SELECT sum(p.k / n.n * (q.k / n.n)) AS pe FROM p JOIN q USING (v), n) SELECT round(po, 6) AS agreement, round(CASE WHEN pe = 1 THEN 1e0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM n, e""")
def cohen_kappa(spark, sf):
    return agreement.cohen(rated(spark, sf), "a", "b")


@query(RATED + """, l AS (SELECT id, a AS v FROM r UNION ALL SELECT id, b FROM r UNION ALL SELECT id, c FROM r), k AS (SELECT id, v, count(*) AS k FROM l GROUP BY 1, 2),
p AS (SELECT avg(x) AS po, count(*) AS n FROM (SELECT id, (sum(k * k) - 3) / 6e0 AS x FROM k GROUP BY id)), e AS (SELECT sum(s * s) AS pe FROM (SELECT count(*)::DOUBLE / (SELECT count(*) FROM l) AS s FROM l GROUP BY v))
SELECT n, round(CASE WHEN pe = 1 THEN 1e0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM p, e""")
def fleiss_kappa(spark, sf):
    return agreement.fleiss(rated(spark, sf), ["a", "b", "c"])


@query(RATED + """SELECT count(*) AS n, count(*) FILTER (a = b AND b = c) AS all_agree, count(*) FILTER (NOT (a = b AND b = c) AND (a = b OR b = c OR a = c)) AS two_kinds, count(*) FILTER (a <> b AND b <> c AND a <> c) AS adjudicate FROM r""")
def iaa_report(spark, sf):
    return agreement.report(rated(spark, sf), ["a", "b", "c"])


@query(RATED + "SELECT id, CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b ELSE a END AS label FROM r")
def majority_label(spark, sf):
    return rated(spark, sf).select("id", agreement.majority(["a", "b", "c"]).alias("label"))


@query(RATED + """, d AS (SELECT id, a, b, CASE WHEN id % 4 = 0 THEN NULL ELSE c END AS c FROM r)
SELECT CASE WHEN c IS NOT NULL AND b <> c THEN 'adjudicate' WHEN a = b THEN 'keep' ELSE 'relabel' END AS merge_decision, CASE WHEN c IS NOT NULL AND b <> c THEN 'drop' WHEN a = b THEN 'keep' ELSE 'relabel' END AS apply_decision, count(*) AS n FROM d GROUP BY 1, 2""")
def relabel_decisions(spark, sf):
    second = F.when(F.col("id") % 4 != 0, F.col("c"))
    rules = [agreement.decision(F.col("a"), F.col("b"), second, strict).alias(name) for strict, name in ((False, "merge_decision"), (True, "apply_decision"))]
    return rated(spark, sf).groupBy(*rules).agg(F.count("*").alias("n"))


NB = f""", d AS (SELECT id, known, {hash_int("episode_id")} % 5 AS f, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM items),
l AS (SELECT id, known, f, unnest(t) AS w FROM d), g AS (SELECT DISTINCT f FROM d),
c AS (SELECT l.w, g.f, count(*) FILTER (l.known) AS k, count(*) FILTER (NOT l.known) AS u FROM l, g WHERE l.f <> g.f GROUP BY 1, 2),
s AS (SELECT f, count(*) AS v, sum(k) AS tk, sum(u) AS tu FROM c GROUP BY f), q AS (SELECT g.f, count(*) FILTER (d.known) AS dk, count(*) FILTER (NOT d.known) AS du FROM d, g WHERE d.f <> g.f GROUP BY g.f),
o AS (SELECT c.w, c.f, ln((k + 1) / (tk + v)::DOUBLE) - ln((u + 1) / (tu + v)::DOUBLE) AS o FROM c JOIN s USING (f)),
z AS (SELECT l.id, sum(coalesce(o.o, 0)) AS s FROM l LEFT JOIN o ON l.w = o.w AND l.f = o.f GROUP BY l.id),
nb AS (SELECT d.id, d.known, coalesce(z.s, 0) + ln((dk + 1) / (du + 1)::DOUBLE) AS score FROM d LEFT JOIN z ON d.id = z.id JOIN q ON d.f = q.f)
"""


@query(NB + "SELECT id, known, round(score, 5) AS score FROM nb")
def nb_status_scores(spark, sf):
    return audit.naive_bayes(V.items(spark, sf), F.col("text"), "episode_id").withColumn("score", F.round("score", 5))


@query(NB + """, r AS (SELECT known, rank() OVER (ORDER BY round(score, 5)) + (count(*) OVER (PARTITION BY round(score, 5)) - 1) / 2e0 AS r FROM nb)
SELECT round((sum(CASE WHEN known THEN r ELSE 0 END) - count(*) FILTER (known) * (count(*) FILTER (known) + 1) / 2e0) / (count(*) FILTER (known) * count(*) FILTER (NOT known)), 6) AS auroc FROM r""")
def nb_auroc(spark, sf):
    return audit.auroc(nb_status_scores(spark, sf))


@query(""", c AS (SELECT question_type, query_time // 10 AS bin, answer, count(*) AS n FROM items GROUP BY 1, 2, 3), b AS (SELECT question_type, bin, max(n) AS best, sum(n) AS n FROM c GROUP BY 1, 2)
SELECT round(sum(best)::DOUBLE / sum(n), 6) AS accuracy, count(*) AS keys FROM b""")
def majority_prior_accuracy(spark, sf):
    return audit.majority_accuracy(V.items(spark, sf), F.col("question_type"), F.floor(F.col("query_time") / 10).alias("bin"))


@query(""", q AS (SELECT DISTINCT regexp_extract(lower(text), '[a-z]+') AS cue FROM benchmark), w AS (SELECT id, known, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS cue FROM items)
SELECT cue, count(*) AS n, count(*) FILTER (known) AS n_known FROM w JOIN q USING (cue) GROUP BY cue""")
def cue_leak_audit(spark, sf):
    cues = V.table(spark, sf, "benchmark").select(F.regexp_extract(F.lower("text"), "[a-z]+", 0).alias("cue"))
    return audit.cue_hits(V.items(spark, sf), cues, "text")


VOTES = ", v AS (SELECT id, m.range AS model, (id * 7 + m.range * 13) % 5 < 2 AS correct FROM items, range(5) m)"


def votes(spark, sf):
    models = F.explode(F.sequence(F.lit(0), F.lit(4)))
    return V.items(spark, sf).select("id", models.alias("model")).withColumn("correct", (F.col("id") * 7 + F.col("model") * 13) % 5 < 2)


@query(VOTES + "SELECT id, count(*) FILTER (correct) AS votes FROM v GROUP BY id HAVING count(*) FILTER (correct) < 2")
def text_prior_filter(spark, sf):
    return audit.vote_filter(votes(spark, sf), 5, 2)


@query(VOTES + """, h AS (SELECT votes, count(*) AS n FROM (SELECT id, count(*) FILTER (correct) AS votes FROM v GROUP BY id) GROUP BY 1) SELECT r.range AS votes, coalesce(h.n, 0) AS n FROM range(6) r LEFT JOIN h ON r.range = h.votes""")
def votes_histogram(spark, sf):
    return audit.vote_histogram(votes(spark, sf), 5)


@query("SELECT question_type AS value, count(*) AS n, round(count(*) * 100e0 / (SELECT count(*) FROM items), 6) AS percent FROM items GROUP BY 1")
def category_shares(spark, sf):
    return distribution.shares(V.items(spark, sf), F.col("question_type"))


HALVES = ", a AS (SELECT question_type, count(*)::DOUBLE / (SELECT count(*) FROM items WHERE id % 2 = 0) AS p FROM items WHERE id % 2 = 0 GROUP BY 1), b AS (SELECT question_type, count(*)::DOUBLE / (SELECT count(*) FROM items WHERE id % 2 = 1) AS q FROM items WHERE id % 2 = 1 GROUP BY 1), c AS (SELECT coalesce(a.question_type, b.question_type) AS question_type, coalesce(p, 0e0) AS p, coalesce(q, 0e0) AS q FROM a FULL JOIN b ON a.question_type = b.question_type)"


@query(HALVES + " SELECT question_type, round(p, 6) AS p, round(q, 6) AS q, round((q - p) * 100, 6) AS shift FROM c")
def share_shift(spark, sf):
    items = V.items(spark, sf)
    return distribution.compared(items.where("id % 2 = 0"), items.where("id % 2 = 1"), "question_type")


@query(HALVES + " SELECT round(sum(abs(round(p, 6) - round(q, 6))) / 2, 5) AS tv, round(max(abs(round((q - p) * 100, 6))), 4) AS max_shift FROM c")
def total_variation(spark, sf):
    items = V.items(spark, sf)
    return distribution.total_variation(items.where("id % 2 = 0"), items.where("id % 2 = 1"), "question_type")


@query("""SELECT 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def marginal_distribution(spark, sf):
    return distribution.marginals(V.orders(spark, sf), "o_orderstatus", "o_orderpriority")


@query("""SELECT 'l_quantity' AS field, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity), 6) AS mean FROM lineitem UNION ALL SELECT 'l_tax', min(l_tax), max(l_tax), round(avg(l_tax), 6) FROM lineitem""")
def numeric_profile(spark, sf):
    return distribution.numeric_profile(V.table(spark, sf, "lineitem"), "l_quantity", "l_tax")


@query("""SELECT question_type, count(*) AS n, count(DISTINCT episode_id) AS episodes, count(*) FILTER (known) AS n_known, round(avg(query_time), 6) AS mean_time, round(avg(CASE WHEN span_end > 0 THEN span_end END), 6) AS mean_span_end, max(change_intensity) AS max_intensity
FROM items GROUP BY ROLLUP (question_type)""")
def release_statistics(spark, sf):
    return distribution.release_statistics(V.items(spark, sf), "question_type")


LABELLED = ", t AS (SELECT id, question_type, list_filter([CASE WHEN id % 2 = 0 THEN 'even' END, CASE WHEN id % 3 = 0 THEN 'three' END, CASE WHEN n_chars % 5 = 0 THEN 'five' END], lambda x: x IS NOT NULL) AS s FROM items)"


def labelled(spark, sf):
    i, n = F.col("id"), F.col("n_chars")
    return V.items(spark, sf).withColumn("s", F.array_compact(F.array(F.when(i % 2 == 0, "even"), F.when(i % 3 == 0, "three"), F.when(n % 5 == 0, "five"))))


@query(LABELLED + " SELECT question_type, label, count(*) AS n FROM (SELECT question_type, unnest(s) AS label FROM t) GROUP BY 1, 2")
def source_tallies(spark, sf):
    return distribution.tallies(labelled(spark, sf), F.col("s"), "question_type")


@query(LABELLED + " SELECT array_to_string(list_sort(s), '+') AS combination, count(*) AS n FROM t GROUP BY 1")
def source_combinations(spark, sf):
    return distribution.combinations(labelled(spark, sf), F.col("s"))


@query("""SELECT sha256(sum(('0x' || substr(sha256(coalesce('=' || id::VARCHAR, '-') || chr(31) || coalesce('=' || episode_id, '-') || chr(31) || coalesce('=' || text, '-')), 1, 15))::BIGINT)::VARCHAR) AS digest,
  count(*) AS rows, count(DISTINCT id) AS ids FROM items""")
def dataset_fingerprint(spark, sf):
    return distribution.fingerprint(V.items(spark, sf), "id", "id", "episode_id", "text")


@query()
def debias_filter(spark, sf):
    rows = V.items(spark, sf).select("id", "known", "question_type", "episode_id", "text", "change_intensity", (F.col("query_time") - F.col("span_end")).alias("age"))
    kept = audit.debias(rows, F.col("text"), "episode_id", X.intensity_bin(F.col("change_intensity"), "filter"), X.age_bin(F.col("age"), "filter"), target=0.5)
    return kept.select("id", "known", "question_type")


DRAWS = """, w AS (SELECT *, correct AS ca, abstained AS aa, (id * 5 + n_chars) % 4 = answer AS cb, (id * 5 + n_chars) % 4 = 3 AS ab FROM outs),
s AS (SELECT question_type, episode_id, count(*) FILTER (known) AS k, count(*) FILTER (NOT known) AS u, count(*) FILTER (known AND ca) AS kca, count(*) FILTER (NOT known AND aa) AS uaa, count(*) FILTER (known AND cb) AS kcb, count(*) FILTER (NOT known AND ab) AS uab,
  row_number() OVER (PARTITION BY question_type ORDER BY episode_id) - 1 AS slot, count(*) OVER (PARTITION BY question_type) AS n FROM w GROUP BY 1, 2),
d AS (SELECT r.range AS rep, s.question_type, ('0x' || substr(md5(r.range || ':' || s.slot), 1, 8))::BIGINT % s.n AS slot FROM range(1000) r, s),
e AS (SELECT rep, question_type, sum(k) AS k, sum(u) AS u, sum(kca) AS kca, sum(uaa) AS uaa, sum(kcb) AS kcb, sum(uab) AS uab FROM d JOIN s USING (question_type, slot) GROUP BY 1, 2),
l AS (SELECT rep, 'a' AS run, kca::DOUBLE / nullif(k, 0) AS ka, uaa::DOUBLE / nullif(u, 0) AS ar FROM e UNION ALL SELECT rep, 'b', kcb::DOUBLE / nullif(k, 0), uab::DOUBLE / nullif(u, 0) FROM e),
m AS (SELECT rep, run, avg(ka) AS ka, avg(ar) AS ar, avg(CASE WHEN ka + ar = 0 THEN 0e0 ELSE 2 * ka * ar / (ka + ar) END) AS h FROM l GROUP BY 1, 2 HAVING count(*) = count(ka + ar))"""


def draws(spark, sf):
    """Two runs over the same items: the predictions, and others by arithmetic."""
    other = (F.col("id") * 5 + F.col("n_chars")) % 4
    rows = V.outs(spark, sf).withColumns({"correct_a": F.col("correct"), "abstained_a": F.col("abstained"), "correct_b": other == F.col("answer"), "abstained_b": other == 3})
    return scoring.macro_replicates(rows, "question_type", "episode_id", ["a", "b"])


@query(DRAWS + """ SELECT run, measure, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(*) AS replicates
FROM (SELECT run, 'ka' AS measure, ka AS v FROM m UNION ALL SELECT run, 'ar', ar FROM m UNION ALL SELECT run, 'h', h FROM m) GROUP BY 1, 2""")
def macro_intervals(spark, sf):
    """Intervals of known accuracy, abstention recall and their harmonic mean, averaged over subsets: 1,000 draws of episodes."""
    found = scoring.macro_intervals(draws(spark, sf))
    return found.select("run", "measure", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")], "replicates")


@query(DRAWS + """ SELECT 'b' AS run, round(avg(y.h - x.h), 6) AS mean, round(quantile_cont(y.h - x.h, 0.025), 6) AS low, round(quantile_cont(y.h - x.h, 0.975), 6) AS high, round(avg((y.h > x.h)::INT), 6) AS above FROM m x JOIN m y ON x.rep = y.rep AND x.run = 'a' AND y.run = 'b' HAVING count(*) > 0""")
def paired_differences(spark, sf):
    """How much better the second run's mean h is than the first's, draw by draw."""
    found = scoring.paired_differences(draws(spark, sf), "a")
    return found.select("run", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high", "above")])
