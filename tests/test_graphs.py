"""Graph searches against plain Python."""

import heapq
import random

import pytest

from tidemark.operators import graphs


def scene(seed, size=9, share=0.65):
    rng = random.Random(seed)
    return {(x, y) for x in range(size) for y in range(size) if rng.random() < share}


def steps(cells, x, y):
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            if (dx or dy) and (x + dx, y + dy) in cells and (not dx or not dy or (x + dx, y) in cells or (x, y + dy) in cells):
                yield (x + dx, y + dy), graphs.DIAGONAL if dx and dy else graphs.STRAIGHT


def dijkstra(cells, start):
    far, heap = {}, [(0, start)]
    while heap:
        d, at = heapq.heappop(heap)
        if at not in far:
            far[at] = d
            for to, cost in steps(cells, *at):
                heapq.heappush(heap, (d + cost, to))
    return far


def thinned(cells):
    """Zhang and Suen, on sets."""
    turn, still = 0, 0
    while still < 2:
        gone = {(x, y) for x, y in cells if graphs.removable(sum(((x + dx, y + dy) in cells) << k for k, (dx, dy) in enumerate(graphs.AROUND)), turn)}
        cells, turn, still = cells - gone, 1 - turn, 0 if gone else still + 1
    return cells


@pytest.fixture(scope="module")
def scenes():
    return {k: scene(k) for k in range(6)} | {90: {(5, 5)}, 91: {(0, 0), (1, 1)}, 92: {(x, 0) for x in range(-3, 9)}}


@pytest.fixture(scope="module")
def cells(spark, scenes):
    rows = [(k, x, y, "extra") for k, own in scenes.items() for x, y in own]
    return spark.createDataFrame([*rows, rows[0], (None, 1, 1, None), (0, None, 1, None)], "scene long, x long, y long, cost string")


def test_distances_and_predecessors(cells, scenes):
    got = {(r.scene, r.x, r.y): (r.distance, r.before_x, r.before_y) for r in graphs.walking_distances(cells.where("scene is not null and x is not null")).collect()}
    want = {}
    for k, own in scenes.items():
        far = dijkstra(own, min(own))
        for (x, y), d in far.items():
            before = min((c for c, _ in steps(own, x, y) if c in far and far[c] + dict(steps(own, *c))[x, y] == d), default=(None, None))
            want[k, x, y] = (d, *before)
    # a lone cell has no edges, but reaches itself
    assert got == want


def test_routes_are_shortest(cells, scenes):
    rows = graphs.farthest_routes(cells.where("scene is not null and x is not null")).collect()
    for k, own in scenes.items():
        way = [(r.x, r.y) for r in sorted((r for r in rows if r.scene == k), key=lambda r: r.place)]
        far = dijkstra(own, min(own))
        assert way[-1] == min(own) and far[way[0]] == max(far.values()) == sum(dict(steps(own, *a))[b] for a, b in zip(way, way[1:], strict=False))


def test_components_and_the_largest(spark, cells, scenes):
    largest = {}
    for k, own in scenes.items():
        groups, left = [], set(own)
        while left:
            one = set(dijkstra(own, min(left)))
            groups.append(one)
            left -= one
        best = max(groups, key=lambda g: (len(g), [-v for v in min(g)]))
        largest[k] = best
    got = {}
    for r in graphs.largest_component(cells.where("scene is not null and x is not null")).collect():
        got.setdefault(r.scene, set()).add((r.x, r.y))
    assert got == largest
    chain = spark.createDataFrame([(1, i, i + 1) for i in range(200)] + [(1, 500, 501), (2, 7, 3), (2, 7, 7), (2, None, 1)], "graph long, a long, b long")
    found = {(r.graph, r.node): r.component for r in graphs.components(chain).collect()}
    assert found == {(1, i): 0 for i in range(201)} | {(1, 500): 500, (1, 501): 500, (2, 3): 3, (2, 7): 3}


def test_skeleton(cells, scenes):
    got = {}
    for r in graphs.skeleton(cells).collect():
        got.setdefault(r.scene, set()).add((r.x, r.y))
    assert got == {k: thinned(own) for k, own in scenes.items()}


def test_defined_results(spark):
    edges = spark.createDataFrame([("g", 1, 2, 5), ("g", 1, 2, 3), ("g", 2, 3, 0), ("g", 3, 4, 1), (None, 1, 2, 1), ("g", 2, 1, 9)], "graph string, a long, b long, cost long")
    sources = spark.createDataFrame([("g", 1), ("g", 1), ("h", 8)], "graph string, node long")
    got = sorted((r.graph, r.node, r.distance) for r in graphs.shortest_paths(edges, sources).collect())
    assert got == [("g", 1, 0), ("g", 2, 3), ("g", 3, 3), ("g", 4, 4), ("h", 8, 0)]
    assert graphs.shortest_paths(edges.limit(0), sources.limit(0)).count() == 0 and graphs.components(edges.limit(0)).count() == 0
    with pytest.raises(Exception, match="negative"):
        graphs.shortest_paths(edges.selectExpr("graph", "a", "b", "-cost AS cost"), sources).count()
