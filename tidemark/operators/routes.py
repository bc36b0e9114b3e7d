"""Station routes by candidate search, routines by random topological order, and natural selections by seeded restarts."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.draws import drawn_counts
from tidemark.sources.tables import checkpointed

CANDIDATES = 1 << 16


def drawn(*parts: Column | str) -> Column:
    """A number below 2^32 from the MD5 of parts, each a column or a plain text."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def drawn_here(*parts) -> int:
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def station_routes(
    stations: DataFrame, paths: DataFrame, beats: list[float], duration: float, candidates: int = 20_000, lead: float = 1.05, lag: float = 1.2, yaw_rate: float = 210.0, most_speed: float = 0.85,
    most_step: float = 3.5, least_travel: float = 8.0, wanted_speed: float = 0.42, most_reuse: int = 3,
) -> DataFrame:
    """The best of `candidates` routes of each plan: plan, status, tried, feasible, best, score, distance, route, times.

    stations: plan, station, target, surface, target_yaw, hidden_yaw. paths: plan, a, b, distance, walked both ways. A candidate draws half as many targets as there are beats and
    visits each twice, in two drawn orders, equal ones never in a row; for each visit it draws a pair of stations of the target (before and after the beat) that a path joins and that the
    camera can turn between; then a start and an end next to them. A leg must have a path, within step and speed. Score: closeness to the wanted speed,
    different targets and surfaces, and a fine for stations used more than most_reuse times; the smallest candidate of equal scores.

    A plan's stations and legs are one row of arrays (a scene's, so bounded), and its candidates are drawn within one task, CANDIDATES at a time and only as far as they hold.
    Plans with fewer targets than the beats need get status 'insufficient stations', those without a feasible candidate 'no feasible route'.
    """
    events, half = len(beats), len(beats) // 2
    if events % 2 or events < 4:
        raise ValueError("an even number of beats, four at least, is needed")
    own = stations.select("plan", "station", "target", "surface", "target_yaw", "hidden_yaw").dropDuplicates(["plan", "station"])
    code = lambda field: F.dense_rank().over(W.partitionBy("plan").orderBy(field)) - 1
    own = own.withColumns({"k": F.row_number().over(W.partitionBy("plan").orderBy("station")) - 1, "n": F.count("*").over(W.partitionBy("plan")), "tk": code("target"), "sk": code("surface")})
    own = checkpointed(own)
    both = paths.select("plan", "a", "b", "distance").unionByName(paths.select("plan", F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    place = lambda c, name, *more: own.select("plan", F.col("station").alias(c), F.col("k").alias(name), *[F.col(m).alias(f"{m}_{name}") for m in more])
    legs = both.where("a <> b").groupBy("plan", "a", "b").agg(F.min("distance").alias("distance"))
    legs = legs.join(place("a", "i", "target", "hidden_yaw", "n", "tk"), ["plan", "a"]).join(place("b", "j", "target", "target_yaw"), ["plan", "b"])
    turn = F.abs(F.pmod(F.col("target_yaw_j") - F.col("hidden_yaw_i") + 180.0, F.lit(360.0)) - 180.0) * 1.875 / max(lag, 1e-6)
    pool = F.when((F.col("target_i") == F.col("target_j")) & (turn <= yaw_rate), F.col("tk_i"))
    leg = F.struct((F.col("i") * F.col("n_i") + F.col("j")).cast("long").alias("cell"), F.col("distance").cast("double").alias("metres"), pool.cast("int").alias("pool"))
    legs = legs.groupBy("plan").agg(F.array_sort(F.collect_list(leg)).alias("legs"), F.size(F.collect_set(pool)).alias("pools"))
    lists = own.groupBy("plan").agg(F.array_sort(F.collect_list(F.struct("k", "station", "tk", "sk"))).alias("own"))
    scenes = checkpointed(lists.join(legs, "plan", "left").withColumn("ready", F.coalesce("pools", F.lit(0)) >= half))
    times = [0.0, *(t for b in beats for t in (max(0.0, b - lead), min(duration, b + lag))), duration]
    search = RouteSearch(times, candidates, half, most_speed, most_step, least_travel, wanted_speed, most_reuse)
    schema = T.StructType([scenes.schema["plan"]]).add("feasible", "long").add("c", "integer").add("score", "double").add("distance", "double").add("way", T.ArrayType(T.IntegerType()))
    ready = scenes.where("ready").select("plan", F.col("plan").cast("string").alias("name"), *[F.col(x)[y].alias(y) for x, y in (("own", "tk"), ("own", "sk"), ("legs", "cell"), ("legs", "metres"), ("legs", "pool"))])
    ready = ready.repartition(scenes.sparkSession.sparkContext.defaultParallelism * 8, "plan")  # by number, or all plans would be put into one task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                found = search.best(*(b.column(c)[k].as_py() for c in ("name", "tk", "sk", "cell", "metres", "pool")))
                cols = [list(x) for x in zip(*found, strict=True)] or [[] for _ in range(5)]
                plans = b.column("plan").take(pa.array([k] * len(found), pa.int32()))
                yield pa.RecordBatch.from_arrays([plans, *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.int32())), strict=True)]], names=schema.names)

    rows = ready.mapInArrow(run, schema).withColumn("score", F.round("score", 6))
    best = rows.groupBy("plan").agg(F.max("feasible").alias("feasible"), F.max_by(F.struct("c", "score", F.round("distance", 6).alias("distance"), "way"), F.struct("score", -F.col("c"))).alias("b"))
    out = scenes.select("plan", "ready", "own").join(best, "plan", "left")
    status = F.when(~F.col("ready"), "insufficient stations").when(F.col("b").isNull(), "no feasible route").otherwise("ok")
    tried, feasible = F.when(F.col("ready"), candidates).otherwise(0).cast("long"), F.coalesce("feasible", F.lit(0)).cast("long")
    kept, route = F.when(F.col("b").isNotNull(), F.array(*[F.lit(t) for t in times])), F.transform("b.way", lambda k: F.col("own")[k]["station"])
    return out.select("plan", status.alias("status"), tried.alias("tried"), feasible.alias("feasible"), F.col("b.c").cast("long").alias("best"), "b.score", "b.distance", route.alias("route"), kept.alias("times"))


@dataclass
class RouteSearch:
    """The candidates of one plan, as arrays; a candidate that fails a leg draws no more."""

    times: list[float]
    candidates: int
    half: int
    most_speed: float
    most_step: float
    least_travel: float
    wanted_speed: float
    most_reuse: int

    def best(self, plan: str, targets: list[int], surfaces: list[int], cells: list[int], metres: list[float], pools: list[int]) -> list[tuple]:
        """(feasible, candidate, score, distance, way) of those feasible candidates whose scores could round to the best one; feasible counts all."""
        n = len(targets)
        cell = np.array(cells, np.int64)
        table = np.full(n * n, np.nan)
        table[cell] = np.array(metres, np.float64)
        pool = np.array([-1 if p is None else p for p in pools], np.int64)
        members = [cell[pool == p] for p in np.unique(pool[pool >= 0])]
        of_pool = np.array([len(m) for m in members]), np.cumsum([0, *map(len, members)])[:-1], np.concatenate(members)
        near = np.bincount(cell // n, minlength=n), np.searchsorted(cell, np.arange(n) * n), cell % n
        scene = plan, n, table, of_pool, near, np.array(targets), np.array(surfaces)
        found = [x for low in range(0, self.candidates, CANDIDATES) if (x := self.drawn(scene, np.arange(low, min(low + CANDIDATES, self.candidates))))[0].size]
        if not found:
            return []
        c, score, distance, way = (np.concatenate(x) for x in zip(*found, strict=True))
        top = np.flatnonzero(score >= score.max() - 1e-5)
        return [(len(c), int(c[k]), float(score[k]), float(distance[k]), way[k].tolist()) for k in top]

    def drawn(self, scene: tuple, c: np.ndarray) -> tuple[np.ndarray, ...]:
        plan, n, table, (sizes, starts, pairs), (degree, first, neighbours), targets, surfaces = scene
        events, spans = 2 * self.half, [max(b - a, 1e-6) for a, b in zip(self.times, self.times[1:], strict=False)]
        number = lambda *key: drawn_counts(f"{plan}:", c, ":" + ":".join(map(str, key)))
        ranked = lambda m, name: np.argsort(np.stack([number(name, i) for i in range(m)], 1), axis=1, kind="stable")
        good = lambda d, k: (d > 1e-4) & (d <= self.most_step) & (d / spans[k] <= self.most_speed)
        chosen, order = ranked(len(sizes), "target")[:, : self.half], ranked(self.half, "first")
        way = np.empty((len(c), 0), np.int64)
        for s in range(events):
            if s == self.half:
                second = ranked(self.half, "second")
                same = order[:, -1] == second[:, 0]
                second[same, :2] = second[same, 1::-1]
                order = np.concatenate([order, second], 1)
            own = chosen[np.arange(len(c)), order[:, s]]
            i, j = np.divmod(pairs[starts[own] + number("pair", s) % sizes[own]], n)
            kept = good(table[i * n + j], 2 * s + 1)
            if s:
                kept &= good(table[way[:, -1] * n + i], 2 * s)
            way = np.concatenate([way, i[:, None], j[:, None]], 1)
            c, chosen, order, way = c[kept], chosen[kept], order[kept], way[kept]
        kept = (degree[way[:, 0]] > 0) & (degree[way[:, -1]] > 0)
        c, way = c[kept], way[kept]
        ends = [neighbours[first[k] + number(name) % degree[k]] for k, name in ((way[:, 0], "start"), (way[:, -1], "end"))]
        way = np.concatenate([ends[0][:, None], way, ends[1][:, None]], 1)
        legs = table[way[:, :-1] * n + way[:, 1:]]
        distance = np.zeros(len(c))
        for k in range(legs.shape[1]):
            distance += legs[:, k]
        kept = good(legs[:, 0], 0) & good(legs[:, -1], len(spans) - 1) & (distance >= self.least_travel)
        c, way, distance = c[kept], way[kept], distance[kept]
        different = lambda x: (np.diff(np.sort(x[way[:, 1:-1]], axis=1), axis=1) != 0).sum(1) + 1
        stops, r = np.sort(way, axis=1), self.most_reuse
        over = (stops[:, r:] == stops[:, : stops.shape[1] - r]).sum(1)
        score = -np.abs(distance / max(self.times[-1] - self.times[0], 1e-6) - self.wanted_speed) * 80.0 + different(targets) * 5.0 + different(surfaces) * 2.0 - over * 20.0
        return c, score, distance, way


def routine_order(tasks: dict[str, tuple], *key) -> list[str]:
    """One episode's tasks {task: (kind, needs, gap)} in an order drawn by the key, or an error.

    A task is ready when what it needs is done; nothing is picked up or opened while something is carried, and a task with a gap waits until so
    many others lie between it and what it needs. Of the ready ones the one with the smallest drawn number is next.
    """
    left, done, carried, head = dict(tasks), {}, 0, ":".join(map(str, key))
    while left:
        at, ready = len(done), []
        for task, (kind, needs, gap) in left.items():
            if (kind in ("pick", "open")) if carried else kind == "place":
                continue
            for d in needs:
                if d not in done or at - done[d] <= gap:
                    break
            else:
                ready.append(task)
        if not ready:
            raise ValueError(f"no task can come next after {', '.join(done) or 'the start'}: {', '.join(sorted(left))}")
        # the first bytes of a digest are in the order of the numbers drawn from it
        own = ready[0] if len(ready) == 1 else min([(hashlib.md5(f"{head}:{at}:{t}".encode()).digest()[:4], t) for t in ready])[1]
        carried += {"pick": 1, "place": -1}.get(left.pop(own)[0], 0)
        done[own] = at
    return list(done)


def texts(values: pa.Array) -> list[str | None]:
    """The texts of an array, each distinct one decoded once."""
    coded = values.dictionary_encode()
    names = [*coded.dictionary.to_pylist(), None]
    return [names[k] for k in coded.indices.fill_null(len(names) - 1).to_numpy().tolist()]


def routine_lists(tasks: DataFrame, seed: int) -> DataFrame:
    """(episode, tasks) of tasks (episode, task, kind, needs, gap): a random topological order of each episode under the rule of one hand.

    kind: pick, place, open or anything else. gap: how many tasks must lie between it and those it needs (null: none). An episode is packed to one row, as small as a
    routine, and folded in Arrow batches. Cycles, missing needs and orders that get stuck are errors; of a task that is named twice the last, by its other fields, counts.
    """
    rows = tasks.where("episode is not null and task is not null").select("episode", F.struct("task", "kind", F.coalesce("needs", F.array().cast("array<string>")).alias("needs"), F.col("gap").cast("int").alias("gap")).alias("t"))
    packed = rows.groupBy("episode").agg(F.array_sort(F.collect_list("t")).alias("tasks"))
    packed = packed.select("episode", *[F.col("tasks")[c].alias(c) for c in ("task", "kind", "needs")], F.transform("tasks", lambda t: F.coalesce(t["gap"], F.lit(0))).alias("gap"))
    schema = T.StructType([T.StructField("episode", tasks.schema["episode"].dataType), T.StructField("tasks", T.ArrayType(T.StringType()))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, cuts = b.column("episode"), b.column("task").offsets.to_numpy().tolist()
            task, kind = (texts(b.column(c).values) for c in ("task", "kind"))
            inner, gap = b.column("needs").values, b.column("gap").values.to_numpy().tolist()
            need, ends = texts(inner.values), inner.offsets.to_numpy().tolist()
            needs = [need[x:y] for x, y in pairwise(ends)]
            every = zip(names.to_pylist(), pairwise(cuts), strict=True)
            orders = [routine_order(dict(zip(task[x:y], zip(kind[x:y], needs[x:y], gap[x:y], strict=True), strict=True)), seed, name) for name, (x, y) in every]
            yield pa.RecordBatch.from_arrays([names, pa.array(orders, pa.list_(pa.string()))], names=schema.names)

    return packed.mapInArrow(fold, schema)


def routines(tasks: DataFrame, seed: int) -> DataFrame:
    """(episode, place, task): `routine_lists` as rows."""
    return routine_lists(tasks, seed).select("episode", F.posexplode("tasks").alias("place", "task")).select("episode", F.col("place").cast("long").alias("place"), "task")


def natural_selection(pool: list[dict], kinds: list[str], each: int, *key) -> list[str] | None:
    """One attempt at a batch: ids chosen, or None if an episode cannot be filled. A question's draw is its id's drawn number in this attempt.

    Episodes come in a drawn order, each with its kinds in a drawn order, turned by its place so that all kinds come to all places. An episode takes an id and a request once. A question may be taken if
    no answer of its options was given less often; of those, the one whose answer was given least in its options and kind, whose event was used least, and then the smallest drawn number; of
    questions with the same id the first by request, options, answer and event.
    """
    by: dict = {}
    for q in sorted(pool, key=lambda q: (q["draw"], q["id"], *[(q[c] is not None, q[c] or "") for c in ("request", "domain", "answer", "event")])):
        by.setdefault((q["episode"], q["kind"]), []).append(q)
    given, of_kind, out = Counter(), Counter(), []
    episodes = sorted({q["episode"] for q in pool}, key=lambda e: (drawn_here(*key, "episode", e), e))
    for place, episode in enumerate(episodes):
        turned = [kinds[(i + place * 4) % len(kinds)] for i in range(each)]
        order = sorted(range(each), key=lambda i: (drawn_here(*key, episode, "kind", i), i))
        used, asked, events = set(), set(), Counter()
        for i in order:
            kind = turned[i]
            found = []
            for q in by.get((episode, kind), ()):
                if q["id"] in used or q["request"] in asked:
                    continue
                times = given[kind, q["domain"], q["answer"]]
                if times <= min(given[kind, q["domain"], a] for a in q["options"]):
                    found.append((times, of_kind[kind, q["answer"]], events[q["event"]], len(found), q))
            if not found:
                return None
            *_, own = min(found, key=lambda x: x[:-1])
            used.add(own["id"])
            asked.add(own["request"])
            events[own["event"]] += 1
            given[kind, own["domain"], own["answer"]] += 1
            of_kind[kind, own["answer"]] += 1
            out.append(own["id"])
    return out


CELL = ["episode", "kind", "domain", "answer", "event"]


def turns(questions: DataFrame) -> DataFrame:
    """The different questions (batch, id, *CELL, request) with their turn: 0 if no other question of the episode has the id, else the place, from 1, by request among those of the cell with the id."""
    own = ["batch", "episode", "id"]
    order = W.partitionBy(*own, *CELL[1:]).orderBy("request")
    rows = questions.repartition(*own).withColumns({"turn": F.dense_rank().over(order), "_rank": F.rank().over(order), "_row": F.row_number().over(order)}).where("_rank = _row").drop("_rank", "_row")
    return rows.withColumn("turn", F.when(F.count("*").over(W.partitionBy(*own)) > 1, F.col("turn")).otherwise(0))


def first_questions(questions: DataFrame, each: int, turn: Column | int = 0) -> DataFrame:
    """Those of the questions (batch, attempt, *CELL, request, draw, id, more) that an attempt at a batch can choose; turn: as of `turns`.

    An episode asks for `each` questions, so at most each - 1 ids and as many requests are taken when it chooses, and in a cell the first question by (draw, id, request) with neither taken wins. All
    before it have one of them taken. If no other question has their ids, their requests are: it is the first of its request, and fewer than `each` such are before it. If others do, it is among the
    first `each` of its request and of its id; so a taken id or request holds `each` questions before it at most, and one of those that come first both of their id and of their request.
    """
    cell, taken = ["batch", "attempt", *CELL, "_several"], each - 1
    rows = questions.withColumn("_turn", F.lit(turn)).withColumn("_several", F.col("_turn") > 0)
    rows = rows.withColumn("_q", F.row_number().over(W.partitionBy(*cell, "request").orderBy("draw", "id"))).where((F.col("_q") <= each) & (F.col("_turn") <= each) & (F.col("_several") | (F.col("_q") == 1)))
    order = W.partitionBy(*cell).orderBy("draw", "id", "request").rowsBetween(W.unboundedPreceding, 0)
    first = ((F.col("_q") == 1) & (F.col("_turn") <= 1)).cast("int")
    rows = rows.withColumn("_first", first).withColumns({"_r": F.row_number().over(order), "_f": F.sum("_first").over(order)})
    rows = rows.where((F.col("_r") <= 2 * taken * each + 1) & (F.col("_f") - F.col("_first") <= F.when(F.col("_several"), 2 * taken).otherwise(taken)))
    return rows.drop("_turn", "_several", "_q", "_first", "_r", "_f")


def natural_batches(pool: DataFrame, kinds: list[str], each: int = 10, seed: int = 0, attempts: int = 256, wave: int = 16) -> DataFrame:
    """(batch, attempt, id): the selection of each batch's first feasible attempt.

    pool: batch, episode, id, kind, options, answer, event, request. Questions count only if each of their options is the answer of some question of the same kind and options in the batch. All different
    questions of an id are candidates, in each of its episodes; rows without batch, episode or id are none. A wave of attempts runs in parallel for all batches without a selection, and the smallest
    feasible number wins, so the result does not depend on the waves, which double from one attempt to `wave`. An attempt at a batch sees `first_questions`: its size follows the
    batch's episodes, kinds, answers and events, not its questions. Batches without any selection are an error that names one, and so is one with an episode none of whose questions counts.
    """
    kind, text = pool.schema["id"].dataType, T.ArrayType(T.StringType())
    domain = F.to_json(F.array_sort(F.array_distinct("options")).cast(text))
    own = pool.where("batch is not null and episode is not null and id is not null").withColumn("domain", domain)
    own = checkpointed(turns(own.select("batch", *[F.col(c).cast("string").alias(c) for c in (*CELL, "request", "id")])))
    given = own.groupBy("batch", "kind", "domain").agg(F.array_sort(F.collect_set("answer")).alias("_given"))
    given = checkpointed(given.select("batch", "kind", "domain", (F.col("_given") == F.array_sort(F.from_json("domain", text))).alias("_ok")))
    own = own.join(given, ["batch", "kind", "domain"], "left")
    ok = F.max(F.coalesce("_ok", F.lit(False))).alias("ok")
    whole = own.groupBy("batch", "episode").agg(ok).groupBy("batch").agg(F.min("ok").alias("ok"))  # an episode without any question cannot be filled
    left, found, low = checkpointed(whole), None, 0
    schema = T.StructType([pool.schema["batch"], T.StructField("attempt", T.IntegerType()), T.StructField("ids", text)])

    def run(key: tuple[pa.Scalar, ...], questions: pa.Table) -> pa.Table:
        attempt = key[1].as_py()
        ids = natural_selection(questions.to_pylist(), kinds, each, seed + attempt)
        return pa.table([questions.column("batch").slice(0, 1), pa.array([attempt], pa.int32()), pa.array([ids], pa.list_(pa.string()))], names=schema.names)

    stuck = left.where("not ok").select("batch").first()
    while stuck is None and low < attempts and not left.isEmpty():
        many = min(max(low, 1), wave, attempts - low)
        rows = own.where("_ok").join(left, "batch", "left_semi").withColumn("attempt", F.explode(F.sequence(F.lit(low), F.lit(low + many - 1)))).withColumn("draw", drawn(F.col("attempt") + seed, "question", F.col("id")))
        tried = first_questions(rows, each, F.col("turn")).withColumn("options", F.from_json("domain", text)).groupBy("batch", "attempt").applyInArrow(run, schema).where("ids is not null")
        tried = checkpointed(tried.groupBy("batch").agg(F.min_by("ids", "attempt").alias("ids"), F.min("attempt").alias("attempt")))
        found = tried if found is None else found.unionByName(tried)
        left, low = checkpointed(left.join(tried, "batch", "left_anti")), low + many
    stuck = left.select("batch").first() if stuck is None else stuck
    if stuck is not None:
        raise ValueError(f"batch {stuck[0]} has no balanced selection within {attempts} attempts")
    if found is None:
        return pool.select("batch", F.lit(0).cast("long").alias("attempt"), "id").limit(0)
    return found.select("batch", F.col("attempt").cast("long").alias("attempt"), F.explode(F.col("ids").cast(T.ArrayType(kind))).alias("id"))
