"""Graph searches over many graphs at once: components, shortest paths, and grids of cells with their skeletons.

A graph is rows of edges (graph, a, b, cost); all graphs of a table advance together, one join a step, and what has come to rest is not expanded again. Costs are
whole numbers, so that sums and ties are exact.

Grids of scenes of up to SMALL cells are dealt out by scene, sorted, and searched where they lie: a task holds arrays of the neighbours of CHUNK cells' worth of scenes, which
advance together, and nothing is shuffled again. Grids of more cells go the way of all graphs, a join a step; the results are the same.

Defined results: an edge with a null end is ignored, so are loops; repeated edges count once, at the least cost; a negative cost is an error; nodes that no source reaches
have no row; a source outside the edges reaches itself; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.tables import checkpointed

#: Micrometres of a step along an axis and of a diagonal one.
STRAIGHT, DIAGONAL = 1_000_000, 1_414_214
#: Most cells of a scene that is searched within a task, and cells that a task takes on at once.
SMALL, CHUNK = 1 << 18, 1 << 18
#: Neighbours of a cell, clockwise from the one above; bit k of a cell's mask stands for neighbour k.
AROUND = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]


def proper(edges: DataFrame) -> DataFrame:
    rows = edges.where("a is not null and b is not null and graph is not null and a <> b").groupBy("graph", "a", "b").agg(F.min("cost").alias("cost"))
    return rows.withColumn("cost", F.when(F.col("cost") >= 0, F.col("cost")).otherwise(F.raise_error(F.lit("an edge has no cost, or a negative one"))).cast("long"))


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(graph, node, distance, before) from the nearest of a graph's sources (graph, node); edges lead from a to b. before is the smallest node before it on a shortest path.

    A step relaxes the edges of the nodes whose distance fell in the step before; it ends when none fell.
    """
    edges = checkpointed(proper(edges))
    reached = checkpointed(sources.where("graph is not null and node is not null").select("graph", "node", F.lit(0).cast("long").alias("distance"), F.lit(0).alias("step")).distinct())
    step = 0
    while not reached.where(F.col("step") == step).isEmpty():
        frontier = reached.where(F.col("step") == step).select("graph", F.col("node").alias("a"), "distance")
        found = frontier.join(edges, ["graph", "a"]).select("graph", F.col("b").alias("node"), (F.col("distance") + F.col("cost")).alias("distance"), F.lit(step + 1).alias("step"))
        best = F.min(F.struct("distance", "step"))  # of equal distances the one known before
        reached = checkpointed(reached.unionByName(found).groupBy("graph", "node").agg(best.alias("m")).select("graph", "node", "m.distance", "m.step"))
        step += 1
    ends = reached.select("graph", F.col("node").alias("a"), F.col("distance").alias("_d"))
    back = edges.join(ends, ["graph", "a"]).select("graph", F.col("b").alias("node"), (F.col("_d") + F.col("cost")).alias("distance"), F.col("a").alias("before"))
    back = back.join(reached.select("graph", "node", "distance"), ["graph", "node", "distance"]).where("distance > 0 or before is not null").groupBy("graph", "node").agg(F.min("before").alias("before"))
    out = reached.join(back, ["graph", "node"], "left")
    return out.select("graph", "node", "distance", F.when(F.col("distance") > 0, F.col("before")).alias("before"))


def paths_to(found: DataFrame, goals: DataFrame) -> DataFrame:
    """(graph, goal, place, node): the nodes of the shortest paths of shortest_paths() to goals (graph, goal), place 0 being the goal. Zero-cost edges are not followed back."""
    walks = checkpointed(goals.select("graph", "goal").distinct().join(found.select("graph", F.col("node").alias("goal"), "before"), ["graph", "goal"]).select("graph", "goal", F.lit(0).alias("place"), F.col("goal").alias("node"), "before"))
    out, steps = walks, found.select("graph", F.col("node").alias("_n"), F.col("before").alias("_b"))
    while True:
        walks = checkpointed(
            walks.where("before is not null").join(steps, (walks["graph"] == steps["graph"]) & (walks["before"] == steps["_n"])).select(walks["graph"], "goal", (F.col("place") + 1).alias("place"), F.col("before").alias("node"), F.col("_b").alias("before"))
        )
        if walks.isEmpty():
            return out.drop("before")
        out = out.unionByName(walks)


def components(edges: DataFrame) -> DataFrame:
    """(graph, node, component): the smallest node that edges, in either direction, connect to it.

    Stars are contracted in two turns (neighbours above a node to the smallest around it, then those below it), so the number of steps grows
    with the logarithm of the nodes, not with a graph's diameter; a node's neighbours are never gathered in a list.
    """
    both = edges.where("graph is not null and a is not null and b is not null and a <> b").select("graph", "a", "b")
    links = checkpointed(both.select("graph", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        """pairs (u, v): each neighbour v of u on the star's side is linked to the smallest of u and its neighbours."""
        sides = pairs.unionByName(pairs.select("graph", F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
        least = sides.groupBy("graph", "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        out = sides.join(least, ["graph", "u"])
        rows = out.where("v > u").select("graph", F.col("v").alias("u"), F.col("m").alias("v")) if large else out.select("graph", F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("graph", "u", F.col("m").alias("v")))
        return rows.where("u <> v").distinct()

    mark = F.sum(F.xxhash64("graph", "u", "v") % 1_000_003)
    before = None
    while True:
        links = checkpointed(stars(stars(links, True), False))
        now = tuple(links.agg(F.count("*"), mark).first())
        if now == before:
            break
        before = now
    nodes = both.select("graph", F.col("a").alias("node")).unionByName(both.select("graph", F.col("b").alias("node"))).distinct()
    return nodes.join(links.select("graph", F.col("u").alias("node"), F.col("v").alias("component")), ["graph", "node"], "left").select("graph", "node", F.coalesce("component", "node").alias("component"))


def neighbour_masks(cells: DataFrame) -> DataFrame:
    """Distinct cells (scene, x, y) with the mask of their neighbours. A cell tells its neighbours of itself, so the table is shuffled once and not joined."""
    told = [F.struct(F.lit(0).alias("dx"), F.lit(0).alias("dy"), F.lit(0).alias("bit"), F.lit(True).alias("own"))]
    told += [F.struct(F.lit(-dx).alias("dx"), F.lit(-dy).alias("dy"), F.lit(1 << k).alias("bit"), F.lit(False).alias("own")) for k, (dx, dy) in enumerate(AROUND)]
    rows = cells.where("scene is not null and x is not null and y is not null").select("scene", "x", "y", F.explode(F.array(*told)).alias("t"))
    rows = rows.select("scene", (F.col("x") + F.col("t.dx")).alias("x"), (F.col("y") + F.col("t.dy")).alias("y"), "t.bit", "t.own")
    return rows.groupBy("scene", "x", "y").agg(F.bit_or("bit").alias("mask"), F.max("own").alias("own")).where("own").drop("own")


def node_of(x: Column, y: Column) -> Column:
    """A cell's number, from which x and y can be told again: x * 2^31 + y, for coordinates below 2^30 either side of zero."""
    return F.shiftleft(x.cast("long") + (1 << 30), 31) + y.cast("long") + (1 << 30)


def x_of(node: Column) -> Column:
    return F.shiftright(node, 31) - (1 << 30)


def y_of(node: Column) -> Column:
    return node.bitwiseAND((1 << 31) - 1) - (1 << 30)


def grid_edges(cells: DataFrame) -> DataFrame:
    """Edges (graph, a, b, cost) between neighbouring cells; a diagonal needs one of the two cells beside it."""
    steps = []
    for k, (dx, dy) in enumerate(AROUND):
        beside = (1 << (k - 1) % 8) | (1 << (k + 1) % 8) if k % 2 else 0
        steps.append(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(1 << k).alias("bit"), F.lit(beside).alias("beside"), F.lit(DIAGONAL if k % 2 else STRAIGHT).cast("long").alias("cost")))
    rows = neighbour_masks(cells).select("*", F.explode(F.array(*steps)).alias("s")).where((F.col("mask").bitwiseAND(F.col("s.bit")) > 0) & ((F.col("s.beside") == 0) | (F.col("mask").bitwiseAND(F.col("s.beside")) > 0)))
    return rows.select(F.col("scene").alias("graph"), node_of(F.col("x"), F.col("y")).alias("a"), node_of(F.col("x") + F.col("s.dx"), F.col("y") + F.col("s.dy")).alias("b"), "s.cost")


def removable(mask: int, turn: int) -> bool:
    """Whether thinning takes a cell with these neighbours away: a border cell (south and east in the first turn, north and west in the second) that is neither an end nor a bridge."""
    p = [mask >> k & 1 for k in range(8)]
    n, e, s, w = p[0], p[2], p[4], p[6]
    turns = sum(p[k] == 0 and p[(k + 1) % 8] == 1 for k in range(8))
    if not 2 <= sum(p) <= 6 or turns != 1:
        return False
    return (n * e * s == 0 and e * s * w == 0) if turn == 0 else (n * e * w == 0 and n * s * w == 0)


def large_skeleton(cells: DataFrame) -> DataFrame:
    """skeleton() by turns of one shuffle each until two in a row take nothing."""
    own = checkpointed(cells.where("scene is not null and x is not null and y is not null").select("scene", "x", "y").distinct())
    many, still, turn = own.count(), 0, 0
    while still < 2 and many:
        gone = [m for m in range(256) if removable(m, turn)]
        own = checkpointed(neighbour_masks(own).where(~F.col("mask").isin(gone)).drop("mask"))
        left = own.count()
        still, many, turn = (still + 1 if left == many else 0), left, 1 - turn
    return own


def proper_cells(cells: DataFrame) -> DataFrame:
    return cells.where("scene is not null and x is not null and y is not null").select("scene", "x", "y").distinct()


def by_size(cells: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Cells of scenes that a task can search, and those of larger ones, if there are any."""
    own = checkpointed(proper_cells(cells))
    large = checkpointed(own.groupBy("scene").agg(F.count("*").alias("n")).where(F.col("n") > SMALL).select("scene"))
    if large.isEmpty():
        return own, None
    return own.join(large, "scene", "left_anti"), own.join(large, "scene", "left_semi")


class Grid:
    """Cells of whole scenes in order of scene, x and y, and the neighbours of each: its row, or the number of rows where there is none."""

    def __init__(self, scene: np.ndarray, x: np.ndarray, y: np.ndarray):
        self.n = len(x)
        fresh = np.r_[True, scene[1:] != scene[:-1]] if self.n else np.zeros(0, bool)
        self.first, self.group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        xs, ys = np.unique(x, return_inverse=True), np.unique(y, return_inverse=True)
        wide, high = len(xs[0]), len(ys[0])
        key = (self.group * wide + xs[1]) * high + ys[1]
        self.near = np.full((8, self.n), self.n, np.int64)
        for k, (dx, dy) in enumerate(AROUND):
            a, b = np.searchsorted(xs[0], xs[0] + dx), np.searchsorted(ys[0], ys[0] + dy)
            a[xs[0][np.minimum(a, wide - 1)] != xs[0] + dx] = wide
            b[ys[0][np.minimum(b, high - 1)] != ys[0] + dy] = high
            ax, by = a[xs[1]], b[ys[1]]
            want = (self.group * wide + ax) * high + by
            at = np.minimum(np.searchsorted(key, want), self.n - 1)
            self.near[k] = np.where((ax < wide) & (by < high) & (key[at] == want), at, self.n)

    def walks(self) -> np.ndarray:
        """Neighbours that can be walked to: a diagonal needs one of the two cells beside it."""
        out = self.near.copy()
        for k in range(1, 8, 2):
            out[k, (self.near[k - 1] == self.n) & (self.near[(k + 1) % 8] == self.n)] = self.n
        return out

    def distances(self) -> tuple[np.ndarray, np.ndarray]:
        """Distance of each cell from its scene's first (-1: not reached) and the smallest cell before it on a shortest way (-1: none)."""
        far, walks = 1 << 62, self.walks()
        cost = np.array([DIAGONAL if k % 2 else STRAIGHT for k in range(8)])
        d = np.full(self.n + 1, far, np.int64)
        d[self.first] = 0
        rows = self.first
        while len(rows):  # only cells beside those whose distance fell
            rows = np.unique(walks[:, rows])
            rows = rows[rows < self.n]
            best = (d[walks[:, rows]] + cost[:, None]).min(axis=0) if len(rows) else d[rows]
            less = best < d[rows]
            rows = rows[less]
            d[rows] = best[less]
        meets = (d[walks] + cost[:, None] == d[: self.n]) & (d[walks] < far)
        before = np.where(meets, walks, self.n).min(axis=0)
        reached = d[: self.n] < far
        return np.where(reached, d[: self.n], -1), np.where(reached & (d[: self.n] > 0), before, -1)

    def routes(self) -> tuple[np.ndarray, np.ndarray]:
        """(places, cells) of the ways from each scene's farthest cell back to its first."""
        d, before = self.distances()
        order = np.lexsort((np.arange(self.n), -d, self.group))
        at, places, out = order[self.first], [], []
        while len(at):
            out.append(at)
            places.append(np.full(len(at), len(places), np.int64))
            at = before[at]
            at = at[at >= 0]
        return np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.int64), *out])

    def components(self) -> np.ndarray:
        """The first cell of each cell's component."""
        walks, own = self.walks(), np.arange(self.n + 1)
        while True:
            less = np.minimum(own[walks].min(axis=0), own[:-1]) if self.n else own[:-1]
            new = own.copy()
            np.minimum.at(new, own[:-1], less)  # the whole of a component follows its first cell
            new[:-1] = np.minimum(new[:-1], less)
            while not np.array_equal(new, new[new]):
                new = new[new]
            if np.array_equal(new, own):
                return own[:-1]
            own = new

    def skeleton(self) -> np.ndarray:
        """Cells that thinning leaves."""
        gone = [np.array([removable(m, turn) for m in range(256)]) for turn in (0, 1)]
        alive, rows = np.r_[np.ones(self.n, bool), False], [np.arange(self.n)] * 2
        turn, still = 0, 0
        while still < 2 and self.n:
            own = rows[turn][alive[rows[turn]]]
            mask = np.zeros(len(own), np.int64)
            for k in range(8):
                mask |= alive[self.near[k, own]].astype(np.int64) << k
            take = own[gone[turn][mask]]
            alive[take] = False
            # what a turn has seen and left stays, until one of its neighbours goes
            beside = np.unique(self.near[:, take])
            beside = beside[beside < self.n]
            rows[turn], rows[1 - turn] = beside, np.union1d(rows[1 - turn], beside)
            still, turn = (0 if len(take) else still + 1), 1 - turn
        return np.flatnonzero(alive[:-1])


def in_scenes(cells: DataFrame, schema: str, search: Callable[[Grid, pa.Table], dict]) -> DataFrame:
    """search() of the cells (scene, x, y: distinct, no nulls) of whole scenes at a time; its columns are those of `schema`, after the scene."""
    kind = cells.schema["scene"].dataType.simpleString()
    names = ["scene", *[c.split()[0] for c in schema.split(", ")]]

    def searched(rows: pa.Table) -> list[pa.RecordBatch]:
        codes = rows["scene"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        grid = Grid(codes, rows["x"].to_numpy().astype(np.int64), rows["y"].to_numpy().astype(np.int64))
        found = search(grid, rows)
        return pa.table({"scene": rows["scene"].take(pa.array(found.pop("at"))), **found}).select(names).to_batches(1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= CHUNK:
                rows = pa.Table.from_batches(held)
                scene = rows["scene"].combine_chunks()
                # all but the last scene are whole: the rows are sorted
                other = np.flatnonzero(scene.dictionary_encode().indices.to_numpy(zero_copy_only=False) != scene.dictionary_encode().indices[-1].as_py())
                whole = int(other[-1]) + 1 if len(other) else 0
                if whole:
                    yield from searched(rows.slice(0, whole))
                held, size = rows.slice(whole).to_batches(), rows.num_rows - whole
        if size:
            yield from searched(pa.Table.from_batches(held))

    return cells.repartition("scene").sortWithinPartitions("scene", "x", "y").mapInArrow(run, f"scene {kind}, {schema}")


def placed(grid: Grid, rows: pa.Table, at: np.ndarray) -> dict:
    return {"at": at, "x": rows["x"].take(pa.array(at)).cast(pa.int64()), "y": rows["y"].take(pa.array(at)).cast(pa.int64())}


def cell_components(cells: DataFrame) -> DataFrame:
    """(scene, x, y, component) of each distinct cell; component: the smallest cell that is connected with it, as node_of() numbers it."""
    small, large = by_size(cells)

    def search(grid: Grid, rows: pa.Table) -> dict:
        at, x, y = grid.components(), rows["x"].to_numpy().astype(np.int64), rows["y"].to_numpy().astype(np.int64)
        return placed(grid, rows, np.arange(grid.n)) | {"component": pa.array((x[at] + (1 << 30) << 31) + y[at] + (1 << 30))}

    out = in_scenes(small, "x long, y long, component long", search)
    if large is None:
        return out
    single = large.select(F.col("scene").alias("graph"), node_of(F.col("x"), F.col("y")).alias("node"))
    rows = single.join(components(grid_edges(large)), ["graph", "node"], "left")
    return out.unionByName(rows.select(F.col("graph").alias("scene"), x_of(F.col("node")).alias("x"), y_of(F.col("node")).alias("y"), F.coalesce("component", "node").alias("component")))


def skeleton(cells: DataFrame) -> DataFrame:
    """Cells (scene, x, y) thinned to lines of one cell's width (Zhang and Suen's parallel thinning), until two turns in a row take nothing."""
    small, large = by_size(cells)
    out = in_scenes(small, "x long, y long", lambda grid, rows: placed(grid, rows, grid.skeleton()))
    kinds = {c: cells.schema[c].dataType for c in ("x", "y")}
    out = out.select("scene", *[F.col(c).cast(kinds[c]).alias(c) for c in kinds])
    return out if large is None else out.unionByName(large_skeleton(large))


def largest_component(cells: DataFrame) -> DataFrame:
    """A scene's cells in the component of most cells, of equal ones the one with the smallest cell."""
    every = checkpointed(cell_components(cells))
    best = every.groupBy("scene", "component").agg(F.count("*").alias("n")).groupBy("scene").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
    return every.join(best, ["scene", "component"]).select("scene", "x", "y")


def walking_distances(cells: DataFrame) -> DataFrame:
    """(scene, x, y, distance, before_x, before_y) from each scene's first cell, by x and then y, over neighbouring cells; distance in micrometres."""
    small, large = by_size(cells)

    def search(grid: Grid, rows: pa.Table) -> dict:
        d, before = grid.distances()
        at = np.flatnonzero(d >= 0)
        back = pa.array(before[at], mask=before[at] < 0)
        return placed(grid, rows, at) | {"distance": pa.array(d[at]), "before_x": rows["x"].take(back).cast(pa.int64()), "before_y": rows["y"].take(back).cast(pa.int64())}

    out = in_scenes(small, "x long, y long, distance long, before_x long, before_y long", search)
    if large is None:
        return out
    found = shortest_paths(grid_edges(large), firsts(large))
    return out.unionByName(found.select(F.col("graph").alias("scene"), x_of(F.col("node")).alias("x"), y_of(F.col("node")).alias("y"), "distance", x_of(F.col("before")).alias("before_x"), y_of(F.col("before")).alias("before_y")))


def firsts(cells: DataFrame) -> DataFrame:
    """(graph, node): each scene's first cell."""
    return cells.groupBy("scene").agg(F.min(F.struct("x", "y")).alias("c")).select(F.col("scene").alias("graph"), node_of(F.col("c.x"), F.col("c.y")).alias("node"))


def farthest_routes(cells: DataFrame) -> DataFrame:
    """(scene, place, x, y): the way from a scene's farthest cell back to its first."""
    small, large = by_size(cells)

    def search(grid: Grid, rows: pa.Table) -> dict:
        places, at = grid.routes()
        return placed(grid, rows, at) | {"place": pa.array(places)}

    out = in_scenes(small, "place long, x long, y long", search)
    if large is None:
        return out
    found = checkpointed(shortest_paths(grid_edges(large), firsts(large)))
    last = found.withColumn("_r", F.row_number().over(W.partitionBy("graph").orderBy(F.desc("distance"), "node"))).where("_r = 1").select("graph", F.col("node").alias("goal"))
    return out.unionByName(paths_to(found, last).select(F.col("graph").alias("scene"), F.col("place").cast("long").alias("place"), x_of(F.col("node")).alias("x"), y_of(F.col("node")).alias("y")))
