"""Queries on plans, traces and scenes: joins of plan and execution, effects, signatures, extremes and aligned option sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.plans import views as V
from tidemark.plans.records import graph
from tidemark.plans.registry import registry

QUERIES, ORACLES, query = registry()

#: Selector names and what they stand for.
DATASETS = {"all": ["en", "fr", "de", "es"], "romance": ["fr", "es"], "english": ["en"]}


def expand(names: list[str]) -> list[str]:
    """Names of datasets, aliases replaced, each once and in order; unknown names stay."""
    return list(dict.fromkeys(x for n in names for x in DATASETS.get(n, [n])))


@query("SELECT question_type, count(*) AS n FROM items WHERE question_type IN ('fr', 'es', 'en') GROUP BY 1")
def selected_datasets(spark, sf):
    return V.items(spark, sf).where(F.col("question_type").isin(expand(["romance", "english", "fr"]))).groupBy("question_type").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS plan, l_linenumber AS step, c_name AS station, l_shipmode_day AS day, l_quantity AS amount FROM (SELECT l_orderkey, l_linenumber, l_quantity, epoch_us(l_shipdate) // 86400000000 AS l_shipmode_day FROM lineitem) l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND l_quantity >= 30")
def adapted_events(spark, sf):
    """Steps of accepted plans with station and execution: three equal-key joins, the filters below them."""
    l, o, c = (V.table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    day = F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 86_400_000_000)
    rows = l.where("l_quantity >= 30").join(o.where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("o_orderkey").alias("plan"), F.col("l_linenumber").alias("step"), F.col("c_name").alias("station"), day.alias("day"), F.col("l_quantity").alias("amount"))


@query("SELECT seq, episode FROM frames WHERE event_type IN ('view', 'click') AND episode % 5 <> 0 AND abs(value) >= 3")
def candidate_segments(spark, sf):
    """Segments of the roles that count, in a named region, long enough."""
    return V.frames(spark, sf).where(F.col("event_type").isin("view", "click") & (F.col("episode") % 5 != 0) & (F.abs("value") >= 3)).select("seq", "episode")


@query(", b AS (SELECT seq, seq % 3 AS s FROM frames), a AS (SELECT seq, (seq + CASE WHEN seq % 10 = 0 THEN 0 ELSE 1 END) % 3 AS s FROM frames WHERE seq % 17 <> 0) SELECT b.seq, coalesce(a.s = (b.s + 1) % 3, false) AS effective FROM b LEFT JOIN a USING (seq)")
def state_effects(spark, sf):
    """Whether the snapshot after shows the new state; a missing snapshot doesn't."""
    s = F.col("seq")
    f = V.frames(spark, sf).select("seq")
    after = f.where(s % 17 != 0).select("seq", ((s + F.when(s % 10 == 0, 0).otherwise(1)) % 3).alias("now"))
    return f.join(after, "seq", "left").select("seq", F.coalesce(F.col("now") == (s % 3 + 1) % 3, F.lit(False)).alias("effective"))


@query(", g AS (SELECT p_partkey % 7 AS room, string_agg(p_partkey || ':' || p_brand, ';' ORDER BY p_partkey) AS s FROM part GROUP BY 1) SELECT room, sha256(s) AS signature FROM g")
def scene_signature(spark, sf):
    """Digest of a room's nodes in order of id."""
    rows = V.table(spark, sf, "part").select((F.col("p_partkey") % 7).alias("room"), F.col("p_partkey").alias("k"), F.concat_ws(":", "p_partkey", "p_brand").alias("s"))
    nodes = F.array_sort(F.collect_list(F.struct("k", "s")))
    return rows.groupBy("room").agg(F.sha2(F.array_join(F.transform(nodes, lambda x: x["s"]), ";"), 256).alias("signature"))


@query(", c AS (SELECT p_partkey, p_partkey % 7 AS room, p_brand, count(*) OVER (PARTITION BY p_partkey % 7, p_brand) AS same FROM part) SELECT room, count(*) FILTER (same = 1) AS unique_classes, count(*) AS n FROM c GROUP BY room")
def room_profile(spark, sf):
    """Nodes that are the only ones of their class in a room."""
    rows = V.table(spark, sf, "part").select((F.col("p_partkey") % 7).alias("room"), "p_brand")
    return rows.groupBy("room", "p_brand").agg(F.count("*").alias("same")).groupBy("room").agg(F.count_if(F.col("same") == 1).alias("unique_classes"), F.sum("same").alias("n"))


@query(", d AS (SELECT p_partkey, p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS r, lead(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - p_retailprice AS margin FROM part) SELECT p_brand AS kind, p_partkey AS closest, margin >= 10 AS clear FROM d WHERE r = 1 AND margin IS NOT NULL")
def extreme_target(spark, sf):
    """The closest of each class, and whether the next is clearly farther."""
    rows = V.table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    two = rows.groupBy("p_brand").agg(F.slice(F.array_sort(F.collect_list(F.struct("p_retailprice", "p_partkey"))), 1, 2).alias("t")).where(F.size("t") == 2)
    return two.select(F.col("p_brand").alias("kind"), F.col("t")[0]["p_partkey"].alias("closest"), (F.col("t")[1]["p_retailprice"] - F.col("t")[0]["p_retailprice"] >= 10).alias("clear"))


@query(""", s AS (SELECT id, question_type, known, array_to_string(list_sort([id % 3, n_chars % 3, (id + n_chars) % 3]), ',') AS options FROM items), k AS (SELECT DISTINCT question_type, options FROM s WHERE known),
p AS (SELECT s.id, k.options, row_number() OVER (PARTITION BY s.id ORDER BY sha256(s.id || ':' || k.options)) AS r FROM s JOIN k USING (question_type) WHERE NOT s.known) SELECT id, options FROM p WHERE r = 1""")
def aligned_option_sets(spark, sf):
    """Uncertain items take an option set that some known item of their type has, picked by hash."""
    i, n = F.col("id"), F.col("n_chars")
    rows = V.items(spark, sf).withColumn("options", F.array_join(F.transform(F.array_sort(F.array(i % 3, n % 3, (i + n) % 3)), lambda x: x.cast("string")), ","))
    known = rows.where("known").select("question_type", "options").distinct()
    both = rows.where("not known").select("id", "question_type").join(known, "question_type")
    return both.groupBy("id").agg(F.min_by("options", F.sha2(F.concat_ws(":", "id", "options"), 256)).alias("options"))


@query(", r AS (SELECT DISTINCT episode, t, event_type FROM frames WHERE event_type IN ('signup', 'error')), p AS (SELECT a.episode, a.t AS first, b.t AS second, a.event_type AS x, b.event_type AS y FROM r a JOIN r b ON a.episode = b.episode AND b.t - a.t BETWEEN 3000 AND 15000) SELECT episode, first, second, x, y FROM p")
def state_pairs(spark, sf):
    """Two states of an episode between a least and a most distance in time: the later one's bucket and those before it are the equal key."""
    r = V.frames(spark, sf).where(F.col("event_type").isin("signup", "error")).select("episode", "t", "event_type").distinct()
    a = r.select("episode", F.col("t").alias("first"), F.col("event_type").alias("x")).withColumn("b", F.explode(F.array(F.floor(F.col("first") / 15000), F.floor(F.col("first") / 15000) + 1)))
    b = r.select("episode", F.col("t").alias("second"), F.col("event_type").alias("y"), F.floor(F.col("t") / 15000).alias("b"))
    return a.join(b, ["episode", "b"]).where("second - first between 3000 and 15000").select("episode", "first", "second", "x", "y")


def parents(spark, sf: str) -> DataFrame:
    """Edges of the scene with the state of what they lead to."""
    nodes, edges = graph(spark, sf)
    return edges.join(nodes.select(F.col("id").alias("to_id"), "states"), "to_id")


@query(", n AS (SELECT p_partkey AS id, p_partkey % 4 = 1 AS closed FROM part) SELECT e.p_partkey AS node, n.closed AS hidden FROM part e JOIN n ON e.p_partkey // 2 = n.id")
def hidden_nodes(spark, sf):
    return parents(spark, sf).select(F.col("from_id").alias("node"), F.array_contains("states", "CLOSED").alias("hidden"))


@query(", w AS (SELECT seq, t, episode, lag(t) OVER (PARTITION BY episode ORDER BY t, seq) AS p FROM frames) SELECT seq, greatest(t, coalesce(p + 500, t)) AS start, least(greatest(t, coalesce(p + 500, t)), t + 300) AS command FROM w")
def preferred_starts(spark, sf):
    """Starts that keep an interval from the event before, and commands no later than a deadline."""
    w = W.partitionBy("episode").orderBy("t", "seq")
    start = F.greatest(F.col("t"), F.coalesce(F.lag("t").over(w) + 500, F.col("t")))
    return V.frames(spark, sf).withColumn("start", start).select("seq", "start", F.least(F.col("start"), F.col("t") + 300).alias("command"))
