"""Queries on contracts: documents with labels as released rows, some broken by their numbers; events as segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import contracts
from tidemark.operators.items import ABSTENTION
from tidemark.plans import views as V
from tidemark.plans.registry import registry

QUERIES, ORACLES, query = registry()


@query(f""", r AS (SELECT CASE WHEN id % 29 = 0 THEN 'supp' ELSE 'q' END || id // CASE WHEN id % 31 = 0 THEN 2 ELSE 1 END AS id, CASE WHEN id % 37 = 0 THEN NULL WHEN known THEN 'known' ELSE 'uncertain' END AS status,
  [CASE WHEN id % 41 = 0 THEN 'not enough evidence' ELSE 'in the ' || question_type END, CASE WHEN id % 43 = 0 THEN ' IN the ' || question_type ELSE 'on the ' || question_type END, 'gone', CASE WHEN id % 47 = 0 THEN 'none' ELSE '{ABSTENTION}' END] AS o,
  CASE WHEN id % 53 = 0 THEN 3 - answer ELSE answer END AS a, id % 59 = 0 AS odd, known, span_end, query_time, change_intensity + CASE WHEN id % 61 = 0 THEN 10 ELSE 0 END AS intensity FROM items),
v AS (SELECT id, 'id without a status word' AS rule FROM r WHERE regexp_matches(lower(id), 'known|uncertain|supp') UNION ALL SELECT id, 'status' FROM r WHERE status IS NULL UNION ALL SELECT id, 'abstention in its place' FROM r WHERE o[4] <> '{ABSTENTION}'
  UNION ALL SELECT id, 'options differ' FROM r WHERE len(list_distinct(list_transform(o, lambda x: lower(trim(x))))) < 4 UNION ALL SELECT id, 'substantive wording' FROM r WHERE o[1] = 'not enough evidence'
  UNION ALL SELECT id, 'uncertain answer abstains' FROM r WHERE status IS NULL AND a <> 3 OR status = 'uncertain' AND a <> 3 UNION ALL SELECT id, 'known answer is substantive' FROM r WHERE (status IS NULL OR status = 'known') AND NOT a BETWEEN 0 AND 2
  UNION ALL SELECT id, 'sources fit the status' FROM r WHERE status IS NULL OR (status = 'uncertain') <> (NOT known AND NOT odd) UNION ALL SELECT id, 'evidence before the question' FROM r WHERE odd OR span_end < 0
  UNION ALL SELECT id, 'intensity' FROM r WHERE NOT intensity BETWEEN 1 AND 10 UNION ALL SELECT id, 'unique id' FROM r GROUP BY id HAVING count(*) > 1)
SELECT rule, count(*) AS n, md5(string_agg(id, ',' ORDER BY id)) AS ids FROM v GROUP BY rule""")
def released_contract(spark, sf):
    """How often each rule of a released row is broken, and by which."""
    i, own = F.col("id"), V.items(spark, sf)
    when = lambda m, a, b: F.when(i % m == 0, a).otherwise(b)
    word = F.col("question_type")
    end = F.when(i % 59 == 0, F.col("query_time") + 5).otherwise(F.col("span_end"))
    rows = own.select(
        F.concat(when(29, F.lit("supp"), F.lit("q")), F.floor(i / when(31, F.lit(2), F.lit(1))).cast("string")).alias("id"), F.when(i % 37 != 0, F.when(F.col("known"), "known").otherwise("uncertain")).alias("status"),
        F.array(when(41, F.lit("not enough evidence"), F.concat(F.lit("in the "), word)), when(43, F.concat(F.lit(" IN the "), word), F.concat(F.lit("on the "), word)), F.lit("gone"), when(47, F.lit("none"), F.lit(ABSTENTION))).alias("options"),
        when(53, 3 - F.col("answer"), F.col("answer")).alias("answer_index"), F.lit(3).alias("abstention_index"), F.when(~F.col("known") & (i % 59 != 0), F.array(F.lit("occlusion"))).alias("uncertainty_sources"),
        F.array(F.array(F.least(F.lit(0.0), end.cast("double")), end.cast("double"))).alias("evidence_spans"), F.col("query_time").cast("double").alias("query_time"), (F.col("change_intensity") + when(61, F.lit(10), F.lit(0))).alias("change_intensity"),
    )
    found = contracts.released_violations(rows)
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("id")), ",")).alias("ids"))


@query(", s AS (SELECT seq AS id, episode AS video, t AS a, t + 1 + seq % 3 AS b, event_type, lag(t + 1 + seq % 3) OVER (PARTITION BY episode ORDER BY t, t + 1 + seq % 3, seq) AS p FROM frames) SELECT id, 'role' AS rule FROM s WHERE event_type NOT IN ('view', 'click', 'purchase') UNION ALL SELECT id, 'activity' FROM s WHERE video % 5 > 2 UNION ALL SELECT id, 'follows the one before' FROM s WHERE p IS NOT NULL AND a <> p")
def segment_contract(spark, sf):
    """Segments that break a rule: role, activity, or order within their video."""
    rows = V.frames(spark, sf).select(F.col("seq").alias("id"), F.col("episode").alias("video"), F.col("t").alias("start"), (F.col("t") + 1 + F.col("seq") % 3).alias("end"), F.col("event_type").alias("role"), (F.col("episode") % 5).cast("string").alias("activity"))
    return contracts.segment_violations(rows, ["view", "click", "purchase"], ["0", "1", "2"])
