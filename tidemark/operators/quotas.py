"""Selections with exact quotas and soft marginals, and answer positions in balance, by integral flows over cells.

Candidates that agree in all that counts are one cell, so what a task solves grows with the cells of one batch (a release), not with its candidates; batches are solved in
parallel, each from one packed row. Inside a cell the candidate with the smallest hash is taken.

Defined results: candidates without a batch, id, episode, type or status are ignored, a null fact is a fact of its own candidate, repeated ids count once; a batch whose quotas cannot be met is an
error that says which bound fails; empty tables give no rows.
"""

from __future__ import annotations

import json
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.running import cumulated
from tidemark.sources.tables import checkpointed

#: Cost of a unit that a lower bound misses; above all other costs together.
BOUND = 1e7


class Flow:
    """A network with bounds and costs; nodes are any values. A lower bound is met before all costs, if it can be."""

    def __init__(self):
        self.out: dict = {}
        self.ends: list = []
        self.room: list[int] = []
        self.cost: list[float] = []
        self.bounds: list[tuple[int, int]] = []

    def add(self, a, b, low: int, high: int, cost: float = 0.0) -> int:
        """An edge for low to high units; gives its number."""
        self.bounds.append((low, high))
        at = len(self.ends)
        for room, price in ((low, cost - BOUND), (high - low, cost)):
            for u, v, r, c in ((a, b, room, price), (b, a, 0, -price)):
                self.out.setdefault(u, []).append(len(self.ends))
                self.out.setdefault(v, [])
                self.ends.append(v)
                self.room.append(r)
                self.cost.append(c)
        return at

    def flow(self, edge: int) -> int:
        return self.room[edge + 1] + self.room[edge + 3]

    def send(self, source, sink, amount: int) -> int:
        """Sends up to `amount` units along the cheapest paths left; gives how many went."""
        sent = 0
        while sent < amount:
            far, by, waiting, queued = {source: 0.0}, {}, deque([source]), {source}
            while waiting:
                u = waiting.popleft()
                queued.discard(u)
                for e in self.out[u]:
                    if self.room[e] and far[u] + self.cost[e] < far.get(self.ends[e], float("inf")) - 1e-9:
                        far[self.ends[e]] = far[u] + self.cost[e]
                        by[self.ends[e]] = e
                        if self.ends[e] not in queued:
                            queued.add(self.ends[e])
                            waiting.append(self.ends[e])
            if sink not in by:
                break
            path, at = [], sink
            while at != source:
                path.append(by[at])
                at = self.ends[by[at] ^ 1]
            units = min(amount - sent, *(self.room[e] for e in path))
            for e in path:
                self.room[e] -= units
                self.room[e ^ 1] += units
            sent += units
        return sent


def quota_cells(cells: list[dict], quotas: dict[tuple, int], targets: dict[str, float], weights: dict[str, float], each: int, ranges: dict[str, tuple[int, int]], most: int, rounds: int = 24) -> list[int]:
    """Numbers of the cells chosen, or an error.

    cells: episode, type, status, fact, marks (soft cells), cost. quotas: exact number of each (type, status). An episode has `each` cells, as many of a status as its range says, at most one of
    a fact and `most` of a type. A flow meets the quotas; the price of a mark rises while too many of it are taken and falls while too few are; then single cells are changed for
    others of their episode, type and status as long as that helps. The smallest deviation from the targets of all rounds wins, then the smallest cost.
    """
    episodes, total = sorted({c["episode"] for c in cells}), sum(quotas.values())
    if len(episodes) * each != total:
        raise ValueError(f"quotas of {total} for {len(episodes)} episodes of {each}")
    slots: dict[tuple, list[int]] = {}
    for k, c in enumerate(cells):
        if (c["type"], c["status"]) in quotas:
            slots.setdefault((c["type"], c["status"], c["episode"], c["fact"]), []).append(k)
    prices, crowded, spread = dict.fromkeys(targets, 0.0), Counter(), 1e-3
    off = lambda counts: sum(weights[m] * abs(counts[m] - t) for m, t in targets.items())
    best = None
    for turn in range(rounds):
        price = lambda k: cells[k]["cost"] + sum(prices.get(m, 0.0) for m in cells[k]["marks"])  # noqa: B023, E731
        heads = {s: min(own, key=lambda k: (price(k), k)) for s, own in slots.items()}
        net = Flow()
        for (kind, status), n in quotas.items():
            net.add("source", (kind, status), n, n)
        arcs = {}
        for (kind, status, episode, fact), k in heads.items():
            arcs[k] = net.add((kind, status, episode), ("fact", episode, status, fact), 0, 1, price(k))
        for kind, status, episode in sorted({(t, s, e) for t, s, e, _ in heads}):
            for k in range(most):  # each more of a type in an episode costs more, so they spread
                net.add((kind, status), (kind, status, episode), 0, 1, spread * k + crowded[episode, kind])
        for episode, status, fact in sorted({(e, s, f) for _, s, e, f in heads}, key=str):
            net.add(("fact", episode, status, fact), ("status", episode, status), 0, 1)
        for episode in episodes:
            for status, (low, high) in ranges.items():
                net.add(("status", episode, status), ("episode", episode), low, high)
            net.add(("episode", episode), "sink", each, each)
        if net.send("source", "sink", total) < total:
            raise ValueError("the quotas of types and statuses cannot be met")
        for episode in episodes:
            for status, (low, high) in ranges.items():
                e = next(e for e in net.out["status", episode, status] if net.ends[e] == ("episode", episode))
                if not low <= net.flow(e) <= high:
                    raise ValueError(f"episode {episode} cannot have {low} to {high} of {status}")
        chosen = {k for k, e in arcs.items() if net.flow(e)}
        over = {g: n - most for g, n in Counter((cells[k]["episode"], cells[k]["type"]) for k in chosen).items() if n > most}
        for g in over:
            crowded[g] += spread * over[g]
        spread *= 2 if over else 1
        counts = Counter(m for k in chosen for m in cells[k]["marks"])
        if not over:
            chosen, counts = changed(cells, chosen, counts, off, price)
            found = (round(off(counts), 9), sum(cells[k]["cost"] for k in chosen), sorted(chosen))
            best = found if best is None or found < best else best
        for m, t in targets.items():
            prices[m] += weights[m] * (counts[m] - t) * 2.0 / (turn + 2)
    if best is None:
        raise ValueError(f"an episode has more than {most} of a type in every selection tried")
    return best[2]


def changed(cells: list[dict], chosen: set[int], counts: Counter, off, price) -> tuple[set[int], Counter]:
    """Changes chosen cells for others of their episode, type and status, of the same fact or an unused one, as long as the deviation falls."""
    same: dict[tuple, list[int]] = {}
    for k, c in enumerate(cells):
        same.setdefault((c["episode"], c["type"], c["status"]), []).append(k)
    used = {(cells[k]["episode"], cells[k]["status"], cells[k]["fact"]) for k in chosen}
    now, better = off(counts), True
    while better:
        better = False
        for k in sorted(chosen):
            c = cells[k]
            for j in same[c["episode"], c["type"], c["status"]]:
                o = cells[j]
                if j in chosen or (o["fact"] != c["fact"] and (o["episode"], o["status"], o["fact"]) in used):
                    continue
                trial = counts.copy()
                trial.subtract(c["marks"])
                trial.update(o["marks"])
                if off(trial) < now - 1e-9:
                    chosen = chosen - {k} | {j}
                    used = used - {(c["episode"], c["status"], c["fact"])} | {(o["episode"], o["status"], o["fact"])}
                    counts, now, better = trial, off(trial), True
                    break
    return chosen, counts


def packed(rows: DataFrame, fields: list[Column]) -> DataFrame:
    """One row a batch, its rows as JSON in their order."""
    return rows.groupBy("batch").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))).alias("rows"))


def quota_selection(pool: DataFrame, quotas: dict[tuple[str, str], int], targets: dict[str, float], weights: dict[str, float], each: int, ranges: dict[str, tuple[int, int]], most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(selection: batch, id; marginals: batch, mark, target, actual) of pool: batch, id, episode, type, status, fact, marks, cost."""
    names = ["episode", "type", "status", "fact", "marks", "cost"]
    whole = pool.where("batch is not null and id is not null and episode is not null and type is not null and status is not null").dropDuplicates(["batch", "id"])
    rows = whole.select("batch", "id", *[F.col(c).cast("string").alias(c) for c in ("episode", "type", "status")], F.coalesce(F.col("fact").cast("string"), F.concat(F.lit("id "), F.col("id").cast("string"))).alias("fact"), F.array_sort(F.coalesce("marks", F.array().cast("array<string>"))).alias("marks"), F.coalesce(F.col("cost").cast("double"), F.lit(0.0)).alias("cost"))
    cells = checkpointed(rows.groupBy("batch", *names).agg(F.min_by("id", F.struct(F.xxhash64("id"), "id")).alias("id")))
    key = F.col("batch").cast("string").alias("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, text in zip(b.column("key").to_pylist(), b.column("rows").to_pylist(), strict=True):
                own = json.loads(text)
                try:
                    out += [(name, own[k]["place"]) for k in quota_cells(own, quotas, targets, weights, each, ranges, most)]
                except ValueError as e:
                    raise ValueError(f"batch {name}: {e}") from e
            cols = list(zip(*out, strict=True)) if out else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["key", "place"])

    place = F.sha2(F.to_json(F.struct(*names)), 256)
    found = checkpointed(packed(cells.withColumn("place", place), [F.col(c) for c in [*names, "place"]]).select(key, "rows").repartition("key").mapInArrow(run, "key string, place string"))
    taken = checkpointed(cells.withColumn("place", place).withColumn("key", key).join(found, ["key", "place"]).select("batch", "id", "marks"))
    actual = taken.select("batch", F.explode("marks").alias("mark")).groupBy("batch", "mark").agg(F.count("*").alias("actual"))
    wanted = F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in targets]), F.array(*[F.lit(float(t)) for t in targets.values()]))).alias("mark", "target")
    marginals = taken.select("batch").distinct().select("batch", wanted).join(actual, ["batch", "mark"], "left").select("batch", "mark", "target", F.coalesce("actual", F.lit(0)).alias("actual"))
    return taken.select("batch", "id"), marginals


def positions_of(cells: list[dict], positions: int) -> list[list[int]]:
    """How many rows of each cell (n; left: names of nested groups, the widest first; right: likewise) get each position, so that every group and cell has each as often as any other, but for one."""
    out, left = [[] for _ in cells], [c["n"] for c in cells]
    names = [([("left", *c["left"][: i + 1]) for i in range(len(c["left"]))], [("right", *c["right"][: i + 1]) for i in range(len(c["right"]))]) for c in cells]
    for p in range(positions):
        net, many, parts = Flow(), Counter(), positions - p
        for (a, b), n in zip(names, left, strict=True):
            for group in [("left",), *a, *b]:
                many[group] += n
        joined, arcs = set(), []
        for k, (a, b) in enumerate(names):
            for u, v in (*zip([("left",), *a], a, strict=False), *((y, x) for x, y in zip([("right",), *b], b, strict=False))):
                if (u, v) not in joined:
                    joined.add((u, v))
                    group = v if v[0] == "left" else u
                    net.add(u, v, many[group] // parts, -(-many[group] // parts))
            arcs.append(net.add(a[-1] if a else ("left",), b[-1] if b else ("right",), left[k] // parts, -(-left[k] // parts), cells[k]["draw"][p]))
        n = many["left",]
        net.send(("left",), ("right",), n // parts + (1 if n % parts else 0))  # the first positions have one more
        for k, e in enumerate(arcs):
            out[k].append(net.flow(e))
            left[k] -= out[k][-1]
    return out


def balanced_positions(rows: DataFrame, nested: list[str], other: list[str], positions: int = 4, seed: int = 0) -> DataFrame:
    """rows (batch, id, ...) with `position`: within a batch, in each group of `nested` columns (all, the first, the first two, ...) and of `other` columns each position occurs as often as any other, but for one.

    Rows of the same groups are one cell. Groups nested on either side make a flow over a batch's cells with bounds that a fractional split always meets, so whole numbers meet them too: one flow a position. Equal
    costs are drawn from seed and cell; a cell's rows get its positions in an order drawn from seed and id, ranked range by range.
    """
    text = lambda names: F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]) if names else F.array().cast("array<string>")
    draw = F.array(*[(F.pmod(F.xxhash64(F.lit(seed), F.col("_cell"), F.lit(p)), F.lit(1 << 20)) / float(1 << 20)).alias("d") for p in range(positions)])  # whole parts of a power of two: sums with BOUND are exact, so no rounding makes a circle look cheaper
    own = rows.where("batch is not null and id is not null").dropDuplicates(["batch", "id"])
    own = own.withColumns({"_left": text(nested), "_right": text(other)}).withColumns({"_key": F.col("batch").cast("string"), "_cell": F.to_json(F.struct("_left", "_right")), "_draw": F.xxhash64(F.lit(seed), F.col("id").cast("string"))})
    ranked = cumulated(own, [F.col(c) for c in ("_key", "_cell", "_draw", "id")], _place=F.lit(1))
    cells = checkpointed(ranked.groupBy("_key", "_cell", "_left", "_right").agg(F.count("*").alias("n"), F.min("_place").alias("_first")))
    lists = packed(cells.withColumn("batch", F.col("_key")), [F.col("_cell").alias("cell"), F.col("_left").alias("left"), F.col("_right").alias("right"), "n", draw.alias("draw")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, text in zip(b.column("batch").to_pylist(), b.column("rows").to_pylist(), strict=True):
                own = json.loads(text)
                out += [(name, c["cell"], each) for c, each in zip(own, positions_of(own, positions), strict=True)]
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.list_(pa.int64())), strict=True)], names=["_key", "_cell", "_each"])

    found = lists.repartition("batch").mapInArrow(run, "_key string, _cell string, _each array<bigint>")
    found = checkpointed(cells.select("_key", "_cell", "_first").join(found, ["_key", "_cell"]))
    # a rank's position: the first up to which the cell's counts add up to more
    at = F.aggregate("_each", F.struct((F.col("_place") - F.col("_first")).alias("left"), F.lit(0).cast("long").alias("p")), lambda a, n: F.struct((a.left - n).alias("left"), (a.p + F.when(a.left >= n, 1).otherwise(0)).cast("long").alias("p")))
    return ranked.join(found, ["_key", "_cell"]).select(*rows.columns, at["p"].alias("position"))
