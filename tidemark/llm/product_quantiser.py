"""Near-duplicate vectors by product quantisation.

Vectors of one label are compared by cosine. Equal vectors of a label are one node with a weight; nodes are numbered in the order of their smallest
ids. Unit vectors are put into the inverted list of their nearest coarse centre, as codes of SUBSPACES parts of the residual. A vector probes
the lists that can hold something within the radius of the threshold, by two exact bounds: the plane halfway between its own centre and the list's, beyond which all of
the list lies, is no farther than the radius; and its distance from the list's centre is at most the radius and the list's own reach (the largest distance of a member). So
no link is lost, whatever directions the vectors fill. In a probed list, distances are read
from the query's tables (asymmetric: the query is exact); what they leave possible, given each code's stored error, is compared in single precision, and by
exact cosine in double precision where that comes within rounding of the threshold.

Coarse centres (about the root of the number of vectors, LISTS at most) and code books are fitted on a bounded sample of SAMPLE vectors, drawn by
hash; every vector is indexed and every vector is a query. A list of more than BLOCK vectors is dealt out in blocks and so are its
queries. A task reports for each query how much it links with, and a spanning forest of the links.

Defined results: vectors that are null, zero, empty, or hold null or non-finite components link with nothing, nor do those without a label or
id; vectors of different lengths are never compared; rows that repeat are copies of each other, and rows that share an id are told apart by label
and vector; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, partitions
from .components import components

LEAST = 0.98
LISTS = 4096
SAMPLE = 32_768
SUBSPACES = 8
CODES = 256
BLOCK = 1024


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].astype(np.float32)
    for _ in range(rounds):
        own = nearest(x, centres)
        sums = np.zeros((len(centres), x.shape[1]))
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres).astype(np.float32)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmax(x[a : a + 2048] @ centres.T - half, 1) for a in range(0, len(x), 2048)] or [np.zeros(0, np.int64)])


class Quantiser:
    """Coarse centres and code books of one vector length."""

    def __init__(self, sample: np.ndarray, n: int):
        self.coarse = k_means(sample, max(1, min(LISTS, int(np.sqrt(n)), len(sample))), 8, 1)
        self.reach = np.full(len(self.coarse), np.inf)  # the largest distance of a list's members from its centre, once all are known
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [k_means(rest[:8192][:, p], min(CODES, len(rest)), 8, 2 + k) for k, p in enumerate(self.parts)]

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distance between each vector and what its codes stand for."""
        rest = x - self.coarse[own]
        codes = np.stack([nearest(rest[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], 1).astype(np.uint8)
        back = np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], 1)
        return codes, np.sqrt(((rest - back) ** 2).sum(1))

    def probes(self, x: np.ndarray, own: np.ndarray, radius: float) -> list[np.ndarray]:
        """Lists that may hold vectors within the radius."""
        c = self.coarse
        square = (c * c).sum(1)
        out = []
        for a in range(0, len(x), 1024):
            d = square - 2 * x[a : a + 1024] @ c.T
            mine = own[a : a + 1024]
            apart = np.sqrt(np.maximum(square[mine][:, None] + square - 2 * c[mine] @ c.T, 1e-12))
            near = (d - d[np.arange(len(mine)), mine][:, None]) / (2 * apart) <= radius + 1e-4
            near &= np.sqrt(np.maximum((x[a : a + 1024] ** 2).sum(1)[:, None] + d, 0)) <= radius + self.reach + 1e-3
            near[np.arange(len(mine)), mine] = True
            out += [np.flatnonzero(r) for r in near]
        return out

    def distances(self, x: np.ndarray, own: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to one list's codes, from a table for each query and subspace."""
        rest = x - self.coarse[own]
        total = np.zeros((len(x), len(codes)), np.float32)
        for k, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            r = rest[:, p]
            table = (r * r).sum(1)[:, None] - 2 * r @ b.T + (b * b).sum(1)
            total += table[:, codes[:, k]]
        return np.sqrt(np.maximum(total, 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of vectors of one length, as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def restored(column: pa.ChunkedArray, single: bool) -> np.ndarray:
    """Vectors from their bytes, as doubles."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float32 if single else np.float64).reshape(len(rows), -1).astype(np.float64)


def units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def reaches(models: dict[int, Quantiser]):
    """For each list, the largest distance of a partition's vectors from its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = {size: np.full(len(q.coarse), -1.0) for size, q in models.items()}
        for batch in batches:
            sizes = np.fromiter(map(len, batch.column("embedding")), np.int64, batch.num_rows)
            for size in np.unique(sizes).tolist():
                x, q = units(matrix(batch.column("embedding").take(pa.array(np.flatnonzero(sizes == size))))), models[size]
                own = nearest(x, q.coarse)
                np.maximum.at(most[size], own, np.sqrt(((x - q.coarse[own]) ** 2).sum(1)))
        rows = [(size, k, v) for size, own in most.items() for k, v in enumerate(own.tolist()) if v >= 0]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["size", "list", "reach"])

    return run


POSTED = "unit long, side int, node long, weight long, list int, vector binary, codes binary, error float"


def postings(models: dict[int, Quantiser], radius: float, single: bool):
    """Each vector as an entry of its own list (side 0) and as a query of the lists it probes (side 1); vectors travel as the bytes of their own type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sizes = np.fromiter(map(len, table.column("embedding")), np.int64, len(table))
            for size in np.unique(sizes).tolist():
                part, q = table.take(np.flatnonzero(sizes == size)), models[size]
                exact = matrix(part.column("embedding"))
                x = units(exact)
                own = nearest(x, q.coarse)
                codes, error = q.encode(x, own)
                lists = q.probes(x, own, radius)
                n = np.fromiter(map(len, lists), np.int64, len(lists))
                asks = np.repeat(np.arange(len(x)), n)
                at = np.concatenate([np.arange(len(x)), asks])
                raw = [v.tobytes() for v in exact.astype(np.float32 if single else np.float64)]
                stored = [c.tobytes() for c in codes] + [None] * len(asks)
                yield pa.RecordBatch.from_arrays(
                    [part.column("label").combine_chunks().take(pa.array(at)), pa.array(np.repeat(np.array([0, 1], np.int32), [len(x), len(asks)])), part.column("node").combine_chunks().take(pa.array(at)), part.column("weight").combine_chunks().take(pa.array(at)),
                     pa.array(np.concatenate([own, *lists]).astype(np.int32)), pa.array([raw[k] for k in at.tolist()], pa.binary()), pa.array(stored, pa.binary()), pa.array(error[at].astype(np.float32))],
                    names=["unit", "side", "node", "weight", "list", "vector", "codes", "error"],
                )

    return run


def links_of_unit(q: Quantiser, own: int, queries: tuple, entries: tuple, radius: float, least: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(weight linked with, for each query; a spanning forest of the links)."""
    (qn, qx), (en, ex, codes, error, weight) = queries, entries
    q_unit, e_unit = units(qx), units(ex)
    gap = q.distances(q_unit, own, codes)
    found = (gap <= radius + error + 1e-3) & (qn[:, None] != en)
    single = q_unit @ e_unit.T
    found &= single >= least - 1e-4
    i, j = np.nonzero(found & (single <= least + 1e-4))  # within rounding: exact
    q_len, e_len = np.sqrt((qx * qx).sum(1)), np.sqrt((ex * ex).sum(1))
    for a in range(0, len(i), 1 << 15):
        r, c = i[a : a + (1 << 15)], j[a : a + (1 << 15)]
        found[r, c] = (qx[r] * ex[c]).sum(1) / (q_len[r] * e_len[c]) >= least
    total = found @ weight
    label_q, label_e = qn.copy(), en.copy()
    linked_q, linked_e = found.any(1), found.any(0)
    top = np.int64(2**63 - 1)
    while True:  # smallest names spread over the links
        new_e = np.minimum(label_e, np.where(found, label_q[:, None], top).min(0, initial=top))
        new_q = np.minimum(label_q, np.where(found, new_e[None], top).min(1, initial=top))
        if (new_e == label_e).all() and (new_q == label_q).all():
            break
        label_q, label_e = new_q, new_e
    forest = {(a, b) for n, lab, on in ((qn, label_q, linked_q), (en, label_e, linked_e)) for a, b in zip(n[on].tolist(), lab[on].tolist(), strict=True) if a != b}
    return total, sorted(forest)


def linked(models: dict[int, Quantiser], radius: float, least: float, single: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        unit, side, node, weight, lists = (table.column(c).to_numpy() for c in ("unit", "side", "node", "weight", "list"))
        order = np.lexsort((node, side, unit))
        edges = np.flatnonzero(np.concatenate([[True], np.diff(unit[order]) != 0, [True]])).tolist()
        kind, a, b = [], [], []
        for low, high in zip(edges, edges[1:], strict=False):
            at = order[low:high]
            entries, queries = at[side[at] == 0], at[side[at] == 1]
            if not len(entries) or not len(queries):
                continue
            part = table.take(entries)
            ex, qx = restored(part.column("vector"), single), restored(table.column("vector").take(pa.array(queries)), single)
            q = models[ex.shape[1]]
            codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(len(entries), -1)
            total, forest = links_of_unit(q, int(lists[entries[0]]), (node[queries], qx), (node[entries], ex, codes, part.column("error").to_numpy(), weight[entries]), radius, least)
            on = np.flatnonzero(total)
            kind += [0] * len(on) + [1] * len(forest)
            a += node[queries][on].tolist() + [x for x, _ in forest]
            b += total[on].tolist() + [y for _, y in forest]
        yield pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_vectors(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """Per row of rows (vec_id, embedding, label): vec_id, n_links, component_id."""
    spark, n = rows.sparkSession, partitions(rows.sparkSession)
    single = rows.schema["embedding"].dataType.simpleString() == "array<float>"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    good = F.coalesce(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    classes = rows.where(good).groupBy("label", "embedding").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("weight"))
    numbered = classes.withColumn("_h", F.xxhash64("label", "embedding")).repartitionByRange(n, "least_id", "_h").sortWithinPartitions("least_id", "_h").drop("_h")
    nodes = cut(numbered.withColumn("node", F.monotonically_increasing_id()), "vectors")
    radius = float(np.sqrt(2 - 2 * least))

    models: dict[int, Quantiser] = {}
    sizes = nodes.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count")).collect()  # lengths of vectors: a few
    for size, many in sizes:
        drawn = nodes.where((F.size("embedding") == size) & (F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < max(1, int(1_000_000 * min(1.0, SAMPLE / many)))))
        sample = drawn.select("node", "embedding").limit(2 * SAMPLE).toArrow().sort_by("node")
        if not len(sample):
            sample = nodes.where(F.size("embedding") == size).select("node", "embedding").limit(1).toArrow()
        models[size] = Quantiser(units(matrix(sample.column("embedding"))), many)

    fitted = spark.sparkContext.broadcast(models)  # at most LISTS centres a length
    far = nodes.select("embedding").mapInArrow(lambda batches: reaches(fitted.value)(batches), "size int, list int, reach double").groupBy("size", "list").agg(F.max("reach").alias("reach")).collect()
    for q in models.values():
        q.reach[:] = -np.inf  # an empty list
    for r in far:
        models[r["size"]].reach[r["list"]] = r["reach"]
    fitted.unpersist()
    shared = spark.sparkContext.broadcast(models)
    posted = nodes.select(F.xxhash64("label", F.size("embedding")).alias("label"), "node", "weight", "embedding")
    posted = cut(posted.mapInArrow(lambda batches: postings(shared.value, radius, single)(batches), POSTED), "postings")
    count = F.count(F.when(F.col("side") == 0, 1))
    blocks = cut(posted.groupBy("unit", "list").agg(F.greatest(F.lit(1), F.ceil(count / BLOCK)).cast("int").alias("eb"), F.greatest(F.lit(1), F.ceil((F.count("*") - count) / BLOCK)).cast("int").alias("qb"), count.alias("n")).where("n > 0").drop("n"), "lists")
    cells = posted.join(blocks, ["unit", "list"])
    mine, others = F.when(F.col("side") == 0, F.col("eb")).otherwise(F.col("qb")), F.when(F.col("side") == 0, F.col("qb")).otherwise(F.col("eb"))
    cells = cells.withColumn("mine", F.pmod(F.xxhash64("node"), mine)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("int"), others - 1)))
    entry, query = F.when(F.col("side") == 0, F.col("mine")).otherwise(F.col("other")), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("mine"))
    cells = cells.select(F.xxhash64("unit", "list", entry.cast("long"), query.cast("long")).alias("unit"), "side", "node", "weight", "list", "vector", "codes", "error")
    found = cut(cells.repartition(n, "unit").mapInArrow(lambda batches: linked(shared.value, radius, least, single)(batches), "kind int, a long, b long"), "links")
    named = components(found.where("kind = 1").select("a", "b"))
    linked_to = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    heads = nodes.select(F.col("node").alias("component"), F.col("least_id").alias("head"))
    named = named.join(heads, "component").select("node", "head")
    whole = nodes.join(linked_to, "node", "left").join(named, "node", "left")
    whole = cut(whole.select("label", "embedding", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("head", "least_id").alias("component")), "classes")
    left = rows.withColumn("key", F.when(good, F.xxhash64("label", "embedding")))
    right = whole.withColumn("own_key", F.xxhash64("label", "embedding")).withColumnsRenamed({"label": "l", "embedding": "e"})
    both = left.join(right, (left["key"] == right["own_key"]) & (left["label"] == right["l"]) & (left["embedding"] == right["e"]), "left")
    return both.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))


def op6_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_vectors(documents(spark, sf_dir, "vec_id", "embedding", "label", table="embeddings"))
    return out.withColumn("kept", F.col("component_id").isNull() | (F.col("vec_id") == F.col("component_id")))
