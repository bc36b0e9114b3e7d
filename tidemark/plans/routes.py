"""Queries that plan: routes between stations, routines, and natural selections."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import routes
from tidemark.plans import views as V
from tidemark.plans.registry import registry
from tidemark.sources.tables import table

QUERIES, ORACLES, query = registry()

BEATS, DURATION, CANDIDATES = [6.0, 12.0, 18.0, 24.0, 30.0, 36.0], 42.0, 20_000
KINDS = ["current", "factual", "history", "temporal"]


def h(*parts: str) -> str:
    """DuckDB: the number drawn from the MD5 of parts."""
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT)"


def ranked(n: str, *key: str) -> str:
    return f"list_transform(list_sort(list_transform(range(0, {n}), lambda i: {{'h': {h('plan', 'c', *key, 'i')}, 'i': i}})), lambda x: x.i)"


TIMES = [0.0, *(t for b in BEATS for t in (b - 1.05, b + 1.2)), DURATION]
SPANS = ", ".join(f"{b - a!r}::DOUBLE" for a, b in zip(TIMES, TIMES[1:], strict=False))


def stations(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(F.floor(k / 40).alias("plan"), k.alias("station"), (k % 6).alias("target"), (k % 4).alias("surface"), (k * 97 % 360).cast("double").alias("target_yaw"), (k * 31 % 360).cast("double").alias("hidden_yaw"), ((k * 37 % 40).cast("double") / 10).alias("x"), ((k * 53 % 30).cast("double") / 10).alias("y"))
    part = W.partitionBy("plan")
    return rows.withColumn("k", F.row_number().over(part.orderBy("station")) - 1).withColumn("n", F.count("*").over(part))


@query(f"""WITH s AS (SELECT c_custkey // 40 AS plan, c_custkey AS station, c_custkey % 6 AS target, c_custkey % 4 AS surface, (c_custkey * 97 % 360)::DOUBLE AS ty, (c_custkey * 31 % 360)::DOUBLE AS hy, (c_custkey * 37 % 40)::DOUBLE / 10 AS x, (c_custkey * 53 % 30)::DOUBLE / 10 AS y,
  row_number() OVER (PARTITION BY c_custkey // 40 ORDER BY c_custkey) - 1 AS k, count(*) OVER (PARTITION BY c_custkey // 40) AS n FROM customer),
p AS (SELECT a.plan, a.k AS i, b.k AS j, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance FROM s a CROSS JOIN range(1, 13) d JOIN s b ON b.plan = a.plan AND b.k = (a.k + d.range) % a.n WHERE a.k <> b.k),
l AS (SELECT plan, i, j, min(distance) AS distance FROM (SELECT * FROM p UNION ALL SELECT plan, j, i, distance FROM p) GROUP BY ALL),
pr AS (SELECT l.plan, a.target, list({{'i': i, 'j': j}} ORDER BY i, j) AS pairs FROM l JOIN s a ON a.plan = l.plan AND a.k = l.i JOIN s b ON b.plan = l.plan AND b.k = l.j
  WHERE a.target = b.target AND abs(((b.ty - a.hy + 180.0) % 360.0 + 360.0) % 360.0 - 180.0) * 1.875 / 1.2 <= 210 GROUP BY ALL),
po AS (SELECT plan, list(pairs ORDER BY target) AS pools FROM pr GROUP BY plan),
me AS (SELECT a.plan, list(l.distance ORDER BY a.k, b.k) AS metres FROM s a JOIN s b ON b.plan = a.plan LEFT JOIN l ON l.plan = a.plan AND l.i = a.k AND l.j = b.k GROUP BY a.plan),
ne AS (SELECT plan, list(js ORDER BY k) AS near FROM (SELECT s.plan, s.k, coalesce(list(l.j ORDER BY l.j) FILTER (l.j IS NOT NULL), []) AS js FROM s LEFT JOIN l ON l.plan = s.plan AND l.i = s.k GROUP BY ALL) GROUP BY plan),
ow AS (SELECT plan, any_value(n) AS n, list({{'station': station, 'target': target, 'surface': surface}} ORDER BY k) AS own FROM s GROUP BY plan),
sc AS (SELECT * FROM ow LEFT JOIN po USING (plan) LEFT JOIN me USING (plan) LEFT JOIN ne USING (plan)),
c1 AS (SELECT *, range AS c FROM sc CROSS JOIN range({CANDIDATES}) WHERE coalesce(len(pools), 0) >= 3),
c2 AS (SELECT *, {ranked("len(pools)", "'target'")}[1:3] AS chosen, {ranked("3", "'first'")} AS o1, {ranked("3", "'second'")} AS o2 FROM c1),
c3 AS (SELECT *, o1 || CASE WHEN o1[3] = o2[1] THEN [o2[2], o2[1], o2[3]] ELSE o2 END AS ord FROM c2),
c4 AS (SELECT *, list_transform(ord, lambda t, s: pools[chosen[t + 1] + 1][{h("plan", "c", "'pair'", "s - 1")} % len(pools[chosen[t + 1] + 1]) + 1]) AS picked FROM c3),
c5 AS (SELECT *, near[picked[1].i + 1] AS ahead, near[picked[6].j + 1] AS behind FROM c4),
c6 AS (SELECT *, [ahead[{h("plan", "c", "'start'")} % len(ahead) + 1]] || flatten(list_transform(picked, lambda p: [p.i, p.j])) || [behind[{h("plan", "c", "'end'")} % len(behind) + 1]] AS way FROM c5 WHERE len(ahead) > 0 AND len(behind) > 0),
c7 AS (SELECT *, list_transform(range(1, 14), lambda k: metres[way[k] * n + way[k + 1] + 1]) AS legs, [{SPANS}] AS spans FROM c6),
c8 AS (SELECT *, list_sum(legs) AS distance FROM c7 WHERE list_bool_and(list_transform(legs, lambda d, k: coalesce(d > 1e-4 AND d <= 3.5 AND d / spans[k] <= 0.85, false)))),
c9 AS (SELECT plan, c, distance, list_transform(way, lambda k: own[k + 1].station) AS route, round(-abs(distance / 42.0 - 0.42) * 80.0 + len(list_distinct(list_transform(way[2:13], lambda k: own[k + 1].target))) * 5.0
  + len(list_distinct(list_transform(way[2:13], lambda k: own[k + 1].surface))) * 2.0 - list_sum(list_transform(list_distinct(way), lambda k: greatest(0, len(list_filter(way, lambda x: x = k)) - 3))) * 20.0, 6) AS score FROM c8 WHERE distance >= 8),
b AS (SELECT plan, count(*) AS feasible, arg_max({{'c': c, 'score': score, 'distance': round(distance, 6), 'route': route}}, {{'s': score, 'c': -c}}) AS b FROM c9 GROUP BY plan)
SELECT sc.plan, CASE WHEN coalesce(len(pools), 0) < 3 THEN 'insufficient stations' WHEN b.b IS NULL THEN 'no feasible route' ELSE 'ok' END AS status, CASE WHEN coalesce(len(pools), 0) < 3 THEN 0 ELSE {CANDIDATES} END AS tried, coalesce(feasible, 0) AS feasible,
  b.b.c AS best, b.b.score AS score, b.b.distance AS distance, array_to_string(b.b.route, ',') AS route FROM sc LEFT JOIN b USING (plan)""")
def station_routes(spark, sf):
    """The best of 20,000 drawn routes of each plan, over stations of forty customers a scene; paths join those up to twelve places apart."""
    own = stations(spark, sf)
    a, b = own.alias("a"), own.select("plan", F.col("k").alias("kb"), F.col("station").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    near = a.select("*", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("d")).withColumn("kb", (F.col("k") + F.col("d")) % F.col("n")).join(b, ["plan", "kb"]).where("k <> kb")
    dx, dy = F.col("x") - F.col("xb"), F.col("y") - F.col("yb")
    found = routes.station_routes(own, near.select("plan", F.col("station").alias("a"), "b", F.round(F.sqrt(dx * dx + dy * dy), 6).alias("distance")), BEATS, DURATION, CANDIDATES)
    return found.drop("times").withColumn("route", F.array_join(F.transform("route", lambda x: x.cast("string")), ","))


@query(f"""WITH RECURSIVE l AS (SELECT l_orderkey AS episode, l_linenumber AS n, max(l_quantity) >= 25 AS carried, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS p FROM lineitem GROUP BY l_orderkey, l_linenumber),
t AS (SELECT episode, 'first_' || n AS task, CASE WHEN carried THEN 'pick' ELSE 'open' END AS kind, CASE WHEN n % 3 = 0 AND p IS NOT NULL THEN ['first_' || p] ELSE []::VARCHAR[] END AS needs, 0 AS gap FROM l
  UNION ALL SELECT episode, 'second_' || n, CASE WHEN carried THEN 'place' ELSE 'close' END, ['first_' || n], 0 FROM l
  UNION ALL SELECT DISTINCT episode, 'lamp', 'switch', []::VARCHAR[], 0 FROM l),
r AS (SELECT episode, []::VARCHAR[] AS done, 0 AS carried, count(*) AS n FROM t GROUP BY episode
  UNION ALL SELECT episode, list_append(done, own.task), carried + CASE own.kind WHEN 'pick' THEN 1 WHEN 'place' THEN -1 ELSE 0 END, n FROM (
    SELECT r.episode, r.done, r.carried, r.n, arg_min({{'task': t.task, 'kind': t.kind}}, {{'h': {h("7", "r.episode", "len(r.done)", "t.task")}, 't': t.task}}) AS own FROM r JOIN t ON t.episode = r.episode
    WHERE NOT list_contains(r.done, t.task) AND list_has_all(r.done, t.needs) AND NOT (r.carried > 0 AND t.kind IN ('pick', 'open')) AND (t.kind <> 'place' OR r.carried > 0) GROUP BY ALL))
SELECT episode, array_to_string(done, ',') AS tasks FROM r WHERE len(done) = n""")
def routine_orders(spark, sf):
    """A random order of each episode's tasks, with one hand to carry in: orders are episodes, line items what is carried or opened."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("episode"), F.col("l_linenumber").alias("n")).agg((F.max("l_quantity") >= 25).alias("carried"))
    before = F.lag("n").over(W.partitionBy("episode").orderBy("n"))
    name = lambda kind, n: F.concat(F.lit(kind), n.cast("string"))
    none = F.array().cast("array<string>")
    needs = F.when((F.col("n") % 3 == 0) & F.col("p").isNotNull(), F.array(name("first_", F.col("p")))).otherwise(none)
    first = F.struct(name("first_", F.col("n")).alias("task"), F.when(F.col("carried"), "pick").otherwise("open").alias("kind"), needs.alias("needs"))
    second = F.struct(name("second_", F.col("n")).alias("task"), F.when(F.col("carried"), "place").otherwise("close").alias("kind"), F.array(name("first_", F.col("n"))).alias("needs"))
    lamp = F.struct(F.lit("lamp").alias("task"), F.lit("switch").alias("kind"), none.alias("needs"))
    tasks = rows.withColumn("p", before).select("episode", F.explode(F.array(first, second, lamp)).alias("t")).select("episode", "t.*", F.lit(0).alias("gap"))
    return routes.routine_lists(tasks, 7).select("episode", F.array_join("tasks", ",").alias("tasks"))


@query()
def natural_batches(spark, sf):
    """Ten questions an episode, answers in balance, by up to 256 drawn attempts a batch: each year of orders is a batch, its customers' nations in five groups are episodes, its line items questions.

    Order and line number are no key of the line items: part and supplier belong to a question's id."""
    l, o, c = (V.table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    rows = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    number = F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("l_partkey") % 4 + 1).cast("int"))
    options = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    pool = rows.select(F.year(F.col("o_orderdate").cast("timestamp")).alias("batch"), (F.col("c_nationkey") % 5).alias("episode"), number.alias("id"), kind.alias("kind"), options.alias("options"), options[(F.col("l_suppkey") % 3).cast("int")].alias("answer"), (F.col("l_orderkey") % 50).alias("event"), F.col("l_partkey").alias("request"))
    return routes.natural_batches(pool, KINDS)
