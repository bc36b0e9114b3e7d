"""Routes, routines and selections against plain loops."""

import hashlib
import math
import random
from collections import Counter

import pytest

from tidemark.operators import routes


def number(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def best_of(plan, stations, metres, beats, duration, candidates):
    """stations: [(station, target, surface, target_yaw, hidden_yaw)] in order; metres: {(i, j): distance} both ways."""
    pools = {}
    for (i, j) in metres:
        turn = abs((stations[j][3] - stations[i][4] + 180) % 360 - 180) * 1.875 / 1.2
        if stations[i][1] == stations[j][1] and turn <= 210:
            pools.setdefault(stations[i][1], []).append((i, j))
    pools = [sorted(pools[t]) for t in sorted(pools)]
    half = len(beats) // 2
    if len(pools) < half:
        return "insufficient stations", None
    near = [sorted(j for (a, j) in metres if a == i) for i in range(len(stations))]
    times = [0.0, *(t for b in beats for t in (b - 1.05, b + 1.2)), duration]
    best = None
    for c in range(candidates):
        order = lambda n, name: sorted(range(n), key=lambda i: (number(plan, c, name, i), i))  # noqa: B023, E731
        chosen, first, second = order(len(pools), "target")[:half], order(half, "first"), order(half, "second")
        if first[-1] == second[0]:
            second[:2] = second[1::-1]
        pairs = [pools[chosen[t]] for t in first + second]
        pairs = [own[number(plan, c, "pair", s) % len(own)] for s, own in enumerate(pairs)]
        ahead, behind = near[pairs[0][0]], near[pairs[-1][1]]
        if not ahead or not behind:
            continue
        way = [ahead[number(plan, c, "start") % len(ahead)], *(k for p in pairs for k in p), behind[number(plan, c, "end") % len(behind)]]
        legs = [metres.get((a, b)) for a, b in zip(way, way[1:], strict=False)]
        if any(d is None or not 1e-4 < d <= 3.5 or d / (t - s) > 0.85 for d, s, t in zip(legs, times, times[1:], strict=False)) or sum(legs) < 8:
            continue
        inside = way[1:-1]
        score = -abs(sum(legs) / duration - 0.42) * 80 + 5 * len({stations[k][1] for k in inside}) + 2 * len({stations[k][2] for k in inside}) - 20 * sum(max(0, n - 3) for n in Counter(way).values())
        if best is None or round(score, 6) > best[0]:
            best = (round(score, 6), c, [stations[k][0] for k in way])
    return ("ok", best) if best else ("no feasible route", None)


def test_station_routes_equal_a_loop(spark):
    rng = random.Random(2)
    scenes, stations, paths = {}, [], []
    for plan in range(4):
        own = [(100 * plan + k, f"t{k % 4}", k % 3, float(rng.randrange(360)), float(rng.randrange(360))) for k in range((16, 12, 6, 5)[plan])]
        place = [(rng.uniform(0, 3), rng.uniform(0, 2)) for _ in own]
        metres = {(i, j): round(math.dist(place[i], place[j]), 6) for i in range(len(own)) for j in range(i) if rng.random() < 0.8}
        paths += [(plan, own[i][0], own[j][0], d) for (i, j), d in metres.items()]
        scenes[plan] = own, metres | {(j, i): d for (i, j), d in metres.items()}
        stations += [(plan, *s) for s in own]
    beats = [6.0, 12.0, 18.0, 24.0]
    got = routes.station_routes(
        spark.createDataFrame([*stations, stations[0]], "plan long, station long, target string, surface int, target_yaw double, hidden_yaw double"), spark.createDataFrame(paths, "plan long, a long, b long, distance double"), beats, 30.0, candidates=400
    ).collect()
    assert {r.status for r in got} >= {"ok"}
    for r in got:
        status, best = best_of(r.plan, *scenes[r.plan], beats, 30.0, 400)
        assert r.status == status and (best is None) == (r.best is None)
        if best:
            assert (r.score, r.best, r.route) == (pytest.approx(best[0], abs=1e-6), best[1], best[2]) and len(r.times) == len(r.route)
    with pytest.raises(ValueError, match="even"):
        routes.station_routes(None, None, [1.0, 2.0, 3.0], 9.0)


def test_routines_keep_their_rules(spark):
    rows = []
    for e in range(60):
        rows += [(e, "on", "switch", [], 0), (e, "cabinet", "open", ["on"], None), (e, "a", "pick", ["on"], 0), (e, "put_a", "place", ["a"], 0), (e, "b", "pick", ["put_a", "cabinet"], 0), (e, "put_b", "place", ["b", "cabinet"], 0), (e, "shut", "close", ["cabinet"], 2), (e, "off", "switch", ["put_b"], 0)]
    tasks = spark.createDataFrame([*rows, rows[0], (None, "x", "open", [], 0)], "episode long, task string, kind string, needs array<string>, gap int")
    found = {}
    for r in routes.routines(tasks, 3).orderBy("episode", "place").collect():
        found.setdefault(r.episode, []).append(r.task)
    assert sorted(found) == list(range(60)) and len({tuple(o) for o in found.values()}) > 3
    for order in found.values():
        at = {t: k for k, t in enumerate(order)}
        assert sorted(order) == sorted({t for _, t, *_ in rows[:8]}) and all(at[n] < at[t] for _, t, _, needs, _ in rows[:8] for n in needs)
        assert at["shut"] - at["cabinet"] > 2
        hand = 0
        for t in order:
            kind = next(k for _, x, k, *_ in rows if x == t)
            assert not (hand and kind in ("pick", "open"))
            hand += {"pick": 1, "place": -1}.get(kind, 0)
    again = {}
    for r in routes.routines(tasks.repartition(7), 3).orderBy("episode", "place").collect():
        again.setdefault(r.episode, []).append(r.task)
    assert again == found
    with pytest.raises(Exception, match="no task can come next"):
        routes.routines(spark.createDataFrame([(1, "a", "x", ["b"], 0), (1, "b", "x", ["a"], 0)], tasks.schema), 3).count()


def attempt(pool, kinds, each, seed):
    """The rule written plainly."""
    answers, totals, out = Counter(), Counter(), []
    for turn, e in enumerate(sorted({q["episode"] for q in pool}, key=lambda e: (number(seed, "episode", e), e))):
        taken, events = [], Counter()
        plan = [kinds[(i + 4 * turn) % len(kinds)] for i in range(each)]
        for i in sorted(range(each), key=lambda i: (number(seed, e, "kind", i), i)):
            free = [q for q in pool if q["episode"] == e and q["kind"] == plan[i] and q not in taken and q["request"] not in {t["request"] for t in taken}]
            free = [q for q in free if all(answers[q["kind"], tuple(q["options"]), q["answer"]] <= answers[q["kind"], tuple(q["options"]), o] for o in q["options"])]
            if not free:
                return None
            q = min(free, key=lambda q: (answers[q["kind"], tuple(q["options"]), q["answer"]], totals[q["kind"], q["answer"]], events[q["event"]], number(seed, "question", q["id"]), q["id"]))
            taken.append(q)
            events[q["event"]] += 1
            answers[q["kind"], tuple(q["options"]), q["answer"]] += 1
            totals[q["kind"], q["answer"]] += 1
            out.append(q["id"])
    return out


@pytest.mark.parametrize("wave", [3, 64])
def test_natural_batches_equal_a_loop(spark, wave):
    rng = random.Random(6)
    kinds, rows = ["c", "f", "h"], []
    for batch in range(4):
        for e in range(4):
            for k in range(18 + batch):
                options = [["yes", "no"], ["red", "blue", "green"]][k % 2]
                rows.append({"batch": batch, "episode": f"e{e}", "id": f"b{batch}e{e}q{k:02}", "kind": kinds[k % 3], "options": options, "answer": rng.choice(options), "event": f"{rng.randrange(4)}", "request": f"{rng.randrange(30)}"})
    pool = spark.createDataFrame([tuple(r.values()) for r in rows], "batch long, episode string, id string, kind string, options array<string>, answer string, event string, request string")
    want = {}
    for batch in range(4):
        own = [r | {"options": sorted(r["options"])} for r in rows if r["batch"] == batch]
        given = {(q["kind"], tuple(q["options"]), q["answer"]) for q in own}
        own = [q for q in own if all((q["kind"], tuple(q["options"]), o) in given for o in q["options"])]
        want[batch] = next(((s, ids) for s in range(64) if (ids := attempt(own, kinds, 6, s)) is not None), None)
    assert all(want.values()) and len({s for s, _ in want.values()}) > 1
    got = {}
    for r in routes.natural_batches(pool, kinds, 6, attempts=64, wave=wave).collect():
        got.setdefault(r.batch, (r.attempt, set()))[1].add(r.id)
    assert got == {b: (s, set(ids)) for b, (s, ids) in want.items()}
    with pytest.raises(ValueError, match="no balanced selection"):
        routes.natural_batches(pool.where("kind <> 'h'"), kinds, 6, attempts=4).count()


def whole_attempt(pool, kinds, each, seed):
    """The rule written plainly, where ids repeat: an episode takes an id and a request once."""
    answers, totals, out = Counter(), Counter(), []
    for turn, e in enumerate(sorted({q["episode"] for q in pool}, key=lambda e: (number(seed, "episode", e), e))):
        taken = []
        plan = [kinds[(i + 4 * turn) % len(kinds)] for i in range(each)]
        for i in sorted(range(each), key=lambda i: (number(seed, e, "kind", i), i)):
            free = [q for q in pool if q["episode"] == e and q["kind"] == plan[i] and not any(t["id"] == q["id"] or t["request"] == q["request"] for t in taken)]
            free = [q for q in free if all(answers[q["kind"], tuple(q["options"]), q["answer"]] <= answers[q["kind"], tuple(q["options"]), o] for o in q["options"])]
            if not free:
                return None
            rank = lambda q: (answers[q["kind"], tuple(q["options"]), q["answer"]], totals[q["kind"], q["answer"]], sum(t["event"] == q["event"] for t in taken), number(seed, "question", q["id"]), q["id"])
            taken.append(min(free, key=lambda q: (*rank(q), q["request"], q["options"], q["answer"], q["event"])))
            q = taken[-1]
            answers[q["kind"], tuple(q["options"]), q["answer"]] += 1
            totals[q["kind"], q["answer"]] += 1
            out.append(q["id"])
    return out


POOL = "batch long, episode string, id string, kind string, options array<string>, answer string, event string, request string"


@pytest.mark.parametrize("parts", [1, 5])
def test_all_questions_of_an_id_are_candidates(spark, parts):
    """Ids that several questions of an episode, and several episodes, share: none of them is left out, whatever the order of rows."""
    rng = random.Random(11)
    kinds, rows = ["c", "f", "h"], []
    for batch in range(4):
        for k in range(240):
            options = [["no", "yes"], ["blue", "green", "red"]][k % 2]
            rows.append({"batch": batch, "episode": f"e{k % 3}", "id": f"q{rng.randrange(25)}", "kind": rng.choice(kinds), "options": options, "answer": rng.choice(options), "event": f"{rng.randrange(3)}", "request": f"{rng.randrange(20)}"})
    data = [tuple(r.values()) for r in rows]
    rng.shuffle(data)
    want = {b: next((s, ids) for s in range(64) if (ids := whole_attempt([r for r in rows if r["batch"] == b], kinds, 6, s)) is not None) for b in range(4)}
    got = {}
    for r in routes.natural_batches(spark.createDataFrame([*data, *data[:50]], POOL).repartition(parts), kinds, 6, attempts=64).collect():
        got.setdefault(r.batch, (r.attempt, []))[1].append(r.id)
    assert {b: (s, sorted(ids)) for b, (s, ids) in got.items()} == {b: (s, sorted(ids)) for b, (s, ids) in want.items()}


def test_an_episode_without_kinds_is_not_left_out(spark):
    rows = [(1, "a", f"q{k}", "c", ["no", "yes"], ["no", "yes"][k % 2], "1", f"{k}") for k in range(8)]
    assert routes.natural_batches(spark.createDataFrame(rows, POOL), ["c"], 4).count() == 4
    with pytest.raises(ValueError, match="batch 1 has no balanced selection"):
        routes.natural_batches(spark.createDataFrame([*rows, (1, "b", "q", None, ["no", "yes"], "no", "1", "1")], POOL), ["c"], 4).count()


def test_every_line_item_is_a_question(spark, monkeypatch):
    """Order and line number repeat in the tables; different line items under them are different questions."""
    from tidemark import catalog

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(routes, "natural_batches", lambda pool, kinds: pool)
    ids = catalog.queries()["natural_batches"](spark, sf).select("id").distinct().count()
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    whole = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct().count()
    assert ids == whole > lines.select("l_orderkey", "l_linenumber").distinct().count()
