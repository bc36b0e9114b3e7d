"""Steps that must keep to their bounds on larger tables, and their results against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import draws
from tidemark.operators import graphs, nearest, quotas, routes, scenes
from tidemark.plans import views


def test_rooms_of_many_nodes(spark, monkeypatch):
    """Sums of levels above a million rows, which a recursion may not reach."""
    monkeypatch.setattr(views, "table", lambda s, folder, name: s.range(200_000).withColumnRenamed("id", "p_partkey"))
    got = catalog.queries()["room_of_node"](spark, "").selectExpr("count(*)", "sum(room * 31 + depth)").first()

    def way(k):
        depth, k = 1, k // 2
        while k > 7:
            depth, k = depth + 1, k // 2
        return k * 31 + depth

    assert tuple(got) == (199_998, sum(map(way, range(2, 200_000))))


def random_cells(spark, scenes=8, size=5):
    rng = random.Random(5)
    return spark.createDataFrame([(k, x - 3, y - 5) for k in range(scenes) for x in range(size) for y in range(size) if rng.random() < 0.6], "scene long, x long, y long")


@pytest.mark.parametrize("search", [graphs.cell_components, graphs.walking_distances, graphs.farthest_routes, graphs.skeleton])
def test_small_scenes_are_searched_without_joins(spark, monkeypatch, search):
    """The same rows by a join a step and within tasks, in chunks that cut scenes, or with scenes of both kinds; and a fixed number of tables written."""
    cells = random_cells(spark)
    tables = []
    written = graphs.checkpointed
    monkeypatch.setattr(graphs, "checkpointed", lambda df: tables.append(1) or written(df))
    found = []
    for small, chunk in ((15, 1 << 18), (1 << 18, 1 << 18), (1 << 18, 20)):
        monkeypatch.setattr(graphs, "SMALL", small)
        monkeypatch.setattr(graphs, "CHUNK", chunk)
        tables.clear()
        found.append(sorted(map(tuple, search(cells).collect()), key=str))
        assert small < 1 << 18 or len(tables) <= 4
    assert found[0] and all(f == found[0] for f in found)


@pytest.mark.parametrize("same", [False, True])
def test_nearest_of_full_cells(spark, monkeypatch, same):
    """Many points in few places, and arrays of few points."""
    monkeypatch.setattr(nearest, "MOST", 4)
    rng = random.Random(3)
    points = [(0, i, float(rng.randrange(9)), float(rng.randrange(3))) for i in range(60)] + [(0, 99, 500.0, 500.0), (1, 1, 0.0, 0.0), (1, 2, 0.0, 0.0)]
    asking = points if same else [(s, i + 1000, x + 0.3, y) for s, i, x, y in points]
    frame = lambda rows: spark.createDataFrame(rows, "scene long, id long, x double, y double")
    got = {(r.scene, r.id): (round(r.distance, 9), r.nearest) for r in nearest.nearest(frame(asking), frame(points), 400.0, same).collect()}
    want = {(s, i): min((round(((x - u) ** 2 + (y - v) ** 2) ** 0.5, 9), j) for t, j, u, v in points if t == s and not (same and i == j)) for s, i, x, y in asking}
    assert got == want


def test_matched_nodes_without_pairs(spark):
    """Against all pairs, with differences at the very bound; the plan joins on a node's own place only."""
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), rng.randrange(-400, 400) / 1000 * 2.5) for i in range(400)] + [(500, None, 0.1), (501, "a", None), (502, "a", float("nan")), (503, "a", float("inf")), (504, "a", 1e20), (505, "a", 1e20)]
    data = spark.createDataFrame(rows, "id long, kind string, x double")
    found = scenes.matched_nodes(data.where("id % 2 = 0"), data.where("id % 2 = 1"), "kind", "x")
    want = {}
    for i, k, x in rows:
        own = [j for j, l, y in rows if j % 2 and k and l == k and x is not None and y is not None and abs(x - y) <= 0.15]
        if i % 2 == 0 and own:
            want[i] = (len(own), min(own))
    assert {r.id: (r.matches, r.found) for r in found.collect()} == want
    assert "<= 0.15" not in found._jdf.queryExecution().toString()


def test_positions_follow_cells_not_rows(spark, monkeypatch):
    """A batch's flow is over its cells, however many rows they have."""
    cells = [{"n": 100_003, "left": [t], "right": [e], "draw": [0.5, 0.1, 0.7, 0.2]} for t in "ab" for e in "xyz"]
    each = quotas.positions_of(cells, 4)
    assert all(sum(e) == 100_003 and max(e) - min(e) == 1 for e in each)
    for side, names in (("left", "ab"), ("right", "xyz")):
        for g in names:
            totals = [sum(n) for n in zip(*(e for c, e in zip(cells, each, strict=True) if c[side] == [g]), strict=True)]
            assert max(totals) - min(totals) <= 1


def test_flows_with_drawn_costs_end(spark):
    """A hundred cells a batch: costs that rounding distorts beside those of bounds would run in circles."""
    rows = spark.range(3000).selectExpr("id % 2 AS batch", "id", "cast(hash(id) % 4 as string) AS lang", "hash(id, 1) % 2 AS status", "hash(id, 2) % 7 AS episode")
    got = quotas.balanced_positions(rows, ["lang", "status"], ["episode"]).groupBy("batch", "lang").pivot("position", [0, 1, 2, 3]).count().collect()
    assert got and all(max(r[2:]) - min(r[2:]) <= 1 for r in got)


def test_draws_of_many_counts():
    """Against hashlib, over all lengths of counts, a text of more than one block, and counts left out."""
    counts = np.array([c for c in range(12_000) if c % 7])
    for before, after in (("7:", ":target:3"), ("é" * 40 + ":", ":end"), ("x" * 53 + ":", "")):
        want = [int(hashlib.md5(f"{before}{c}{after}".encode()).hexdigest()[:8], 16) for c in counts.tolist()]
        assert draws.drawn_counts(before, counts, after).tolist() == want


def test_candidates_of_a_plan_are_not_rows(spark, monkeypatch):
    """The same routes in blocks of any size; the plans are dealt to many tasks, and no row is made for a candidate."""
    rng = random.Random(8)
    stations = [(plan, 100 * plan + k, k % 4, k % 3, float(rng.randrange(360)), float(rng.randrange(360))) for plan in range(6) for k in range(12)]
    paths = [(p, s, t, rng.randrange(3, 30) / 10) for p, s, *_ in stations for q, t, *_ in stations if p == q and s < t]
    stations, paths = spark.createDataFrame(stations, "plan long, station long, target int, surface int, target_yaw double, hidden_yaw double"), spark.createDataFrame(paths, "plan long, a long, b long, distance double")
    found = []
    for block in (70, 1 << 16):
        monkeypatch.setattr(routes, "CANDIDATES", block)
        got = routes.station_routes(stations, paths, [6.0, 12.0, 18.0, 24.0], 30.0, 3_000)
        assert "Generate explode" not in (plan := got._jdf.queryExecution().toString()) and "REPARTITION_BY_NUM" in plan
        found.append(sorted(map(tuple, got.collect())))
    assert found[0] == found[1] and any(r[1] == "ok" and r[3] > 1 for r in found[0])


def test_an_attempt_sees_few_questions_of_a_cell(spark):
    """As many as an episode asks for, whatever the number of questions, and the same choice as from all of them."""
    rng = random.Random(9)
    rows, options = [], ["no", "yes"]
    for k in range(3_000):
        rows.append({"batch": 1, "episode": f"e{k % 2}", "kind": rng.choice("cf"), "domain": "d", "answer": rng.choice(options), "event": rng.choice(["1", "2", None]), "request": rng.choice([None, *"abcdefghijkl"]), "options": options, "id": f"q{k}"})
    seen = 0
    for seed in range(3):
        own = [r | {"attempt": seed, "draw": routes.drawn_here(seed, "question", r["id"]) % 50} for r in rows]  # few draws: ids decide
        data = spark.createDataFrame([tuple(r.values()) for r in own], "batch long, episode string, kind string, domain string, answer string, event string, request string, options array<string>, id string, attempt int, draw long")
        few = [r.asDict() for r in routes.first_questions(data, 8).collect()]
        assert len(few) == 8 * 2 * 2 * 2 * 3
        whole = routes.natural_selection(own, ["c", "f"], 8, seed)
        seen += whole is not None
        assert routes.natural_selection(few, ["c", "f"], 8, seed) == whole
    assert seen


def test_routines_of_an_episode_are_one_row(spark):
    """The query's orders come from the fold, without a shuffle after it; duplicates and nulls as in `routines`."""
    rows = [(e, f"t{k}", ["open", None, "pick", "place"][k], [[], ["t0"], ["t1", "t0"], ["t2"]][k], None if k % 2 else 0) for e in range(300) for k in range(4)]
    tasks = spark.createDataFrame([*rows, rows[0], (None, "x", None, [], 0), (7, None, None, None, 0)], "episode long, task string, kind string, needs array<string>, gap int")
    lists = routes.routine_lists(tasks, 5)
    want = {(r.episode, r.place): r.task for r in routes.routines(tasks, 5).collect()}
    assert {(r.episode, k): t for r in lists.collect() for k, t in enumerate(r.tasks)} == want and len(want) == 1200
    plan = catalog.queries()["routine_orders"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString().split("== Physical Plan ==")[1].split("MapInArrow")
    assert len(plan) > 1 and "Exchange" not in plan[0]


@pytest.mark.parametrize("ids, requests", [(40, 40), (12, 200), (200, 12), (400, 400)])
def test_an_attempt_sees_enough_questions_of_an_id(spark, ids, requests):
    """Whatever ids and requests are taken, the first question left of a cell is among those seen, and they are bounded."""
    rng, each = random.Random(ids), 5
    rows = {(e, f"q{rng.randrange(ids)}", rng.choice("cf"), rng.choice(["no", "yes"]), rng.choice([None, *map(str, range(requests))])) for e in ("e", "g") for _ in range(1_500)}
    data = spark.createDataFrame([(1, *r, "d", "1", 3) for r in sorted(rows, key=str)], "batch long, episode string, id string, kind string, answer string, request string, domain string, event string, attempt int")
    turned = routes.turns(data).withColumn("draw", routes.drawn("question", F.col("id")) % 50)
    order = lambda q: (q["draw"], q["id"], q["request"] is not None, q["request"] or "")
    whole, few = (sorted((r.asDict() for r in d.collect()), key=order) for d in (turned, routes.first_questions(turned, each, F.col("turn"))))
    assert len(few) <= 2 * 2 * 2 * (2 * (each - 1) * each + 1 + each) and len(few) < len(whole) / 2
    cells = {(q["episode"], q["kind"], q["answer"]) for q in whole}
    assert len(cells) == 8
    of = lambda rows, cell: [q for q in rows if (q["episode"], q["kind"], q["answer"]) == cell]
    for cell in sorted(cells):
        own, seen = of(whole, cell), of(few, cell)
        for trial in range(120):
            taken = rng.sample([q for q in (whole if trial % 2 else own[:30]) if q["episode"] == cell[0]], each - 1)
            if trial % 3 == 0:  # each time what would be chosen next
                taken = []
                for _ in range(each - 1):
                    taken.append(next(q for q in own if all(q["id"] != t["id"] and q["request"] != t["request"] for t in taken)))
            left = [next((q for q in x if all(q["id"] != t["id"] and q["request"] != t["request"] for t in taken)), None) for x in (own, seen)]
            assert left[0] == left[1]
