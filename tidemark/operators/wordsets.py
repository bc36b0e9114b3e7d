"""Sets of words of many items, packed once, for log odds that are taken again and again while items fall.

A chunk holds items of one fold as a stream of its own numbers of their words. Its distinct words travel once, dealt into buckets by hash, where each gets a number;
later only counts travel to the buckets and the others' counts back, packed as arrays. Words within a chunk follow each other by bucket and letters, so equal sets of one
fold are summed in the same order and have equal scores, wherever they are. An item's place is its chunk and its row there.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import checkpointed

#: Words of a chunk, repeats included; one batch of items may go beyond.
CHUNK = 1 << 22
#: Stands for an item without a fold: it counts nowhere and its score is 0.
NO_FOLD = -1

SETS = "chunk long, fold int, bucket int, words array<string>, known binary, cell binary, counts binary, numbers binary, edges binary"
VALUES = "chunk long, fold int, bucket int, k binary, u binary, n array<long>"


def packed(a: np.ndarray) -> bytes:
    """Numbers byte by byte of their width: high bytes, mostly zero, take next to nothing."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes())


def unpacked(b: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield {name: b.column(j)[k].as_py() for j, name in enumerate(b.schema.names)}


def by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each chunk; they follow each other."""
    own: list[dict] = []
    for r in rows_of(batches):
        if own and own[0]["chunk"] != r["chunk"]:
            yield own
            own = []
        own.append(r)
    if own:
        yield own


def records(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({f.name: pa.array([r.get(f.name) for r in rows], f.type) for f in schema}, schema)


class WordSets:
    """items: (id, known, cell, _fold, words), `words` without repeats; texts are not read again after this."""

    def __init__(self, items: DataFrame):
        spark = items.sparkSession
        self.n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.id = items.schema["id"].dataType
        sets = checkpointed(items.select("id", "known", "cell", F.coalesce("_fold", F.lit(NO_FOLD)).cast("int").alias("_fold"), "words").mapInArrow(chunks(self.n, CHUNK), f"{SETS}, ids array<{self.id.simpleString()}>"))
        self.streams = sets.where("bucket is null").drop("words")
        blobs = sets.where("bucket is not null").select("chunk", "fold", "bucket", "words")
        self.folds = [r["fold"] for r in self.streams.select("fold").distinct().collect()]  # five
        self.uses = checkpointed(blobs.repartitionById(self.n, F.col("bucket")).mapInArrow(numbered, "chunk long, fold int, bucket int, uses binary"))
        self.fell: DataFrame | None = None

    def drop(self, places: DataFrame) -> None:
        """Leaves out the items at these (chunk, row) from now on."""
        places = places.select("chunk", "row")
        self.fell = checkpointed(places if self.fell is None else self.fell.unionByName(places))

    def together(self, *more: DataFrame) -> DataFrame:
        """Chunks with what fell and whatever else is asked for, chunk by chunk."""
        rows = self.streams
        if self.fell is not None:
            more = (*more, self.fell.groupBy("chunk").agg(F.collect_list("row").alias("gone")))
        for m in more:
            rows = rows.unionByName(m, allowMissingColumns=True)
        for name, kind in (("gone", "array<int>"), ("k", "binary"), ("u", "binary")):
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast(kind))
        return rows.repartition(self.n, "chunk").sortWithinPartitions("chunk", "bucket")

    def scores(self) -> DataFrame:
        """(id, known, cell, chunk, row, score) of the items left: out-of-fold log odds of their words, Laplace-smoothed, vocabulary of the other folds."""
        counts = self.together().mapInArrow(counted, VALUES)
        both = counts.unionByName(self.uses, allowMissingColumns=True)
        values = checkpointed(both.repartitionById(self.n, F.col("bucket")).mapInArrow(others(self.folds), VALUES))
        sums = values.where("chunk is null").groupBy("fold").agg(*[F.sum(F.col("n")[j]).alias(f"n{j}") for j in range(5)]).collect()  # a row a fold
        every = [sum(r[f"n{j}"] for r in sums) for j in (0, 1)]
        odds = {r["fold"]: (math.log((every[0] - r["n0"] + 1) / (every[1] - r["n1"] + 1)), float(r["n2"] + r["n4"] or 1), float(r["n3"] + r["n4"] or 1)) for r in sums}
        found = self.together(values.where("chunk is not null").select("chunk", "fold", "bucket", "k", "u"))
        return found.mapInArrow(scored(odds), f"id {self.id.simpleString()}, known boolean, cell int, chunk long, row int, score double")


def chunks(buckets: int, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        held: dict[int, list[pa.RecordBatch]] = {}
        size: dict[int, int] = {}

        def close(fold: int) -> Iterator[pa.RecordBatch]:
            nonlocal k
            own = pa.Table.from_batches(held.pop(fold)).combine_chunks()
            size.pop(fold)
            chunk, k = (part << 20) + k, k + 1
            column = {n: own.column(n).combine_chunks() for n in own.schema.names}
            column = {n: c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for n, c in column.items()}
            lists = column["words"]
            words = lists.flatten().dictionary_encode()
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint32)
            names = words.dictionary.to_pylist()
            bucket = np.fromiter((zlib.crc32(w.encode()) for w in names), np.int64, len(names)) % buckets
            order = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
            order = order[np.argsort(bucket[order], kind="stable")]
            rank = np.empty(len(names), np.uint32)
            rank[order] = np.arange(len(names), dtype=np.uint32)
            numbers = rank[words.indices.to_numpy(zero_copy_only=False)]
            numbers = numbers[np.lexsort((numbers, np.repeat(np.arange(len(counts)), counts)))]
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1)).astype(np.uint32)
            sorted_names = words.dictionary.take(pa.array(order))
            known = column["known"].cast(pa.int8()).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int8)
            ids = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), column["id"])
            kinds = {"chunk": pa.int64(), "fold": pa.int32(), "bucket": pa.int32(), "words": pa.list_(pa.string()), **dict.fromkeys(("known", "cell", "counts", "numbers", "edges"), pa.binary()), "ids": ids.type}
            blobs = (known, column["cell"].to_numpy(zero_copy_only=False).astype(np.int32), counts, numbers, edges)
            row = [pa.array([x], kinds[n]) for n, x in zip(kinds, (chunk, fold, None, None, *map(packed, blobs)), strict=False)]
            yield pa.RecordBatch.from_arrays([*row, ids], names=list(kinds))
            if fold == NO_FOLD or not len(names):
                return
            filled = np.flatnonzero(np.diff(edges))
            lists = pa.ListArray.from_arrays(pa.array(np.append(edges[filled], edges[-1]).astype(np.int32)), sorted_names)
            m = len(filled)
            some = {"chunk": pa.array([chunk] * m, pa.int64()), "fold": pa.array([fold] * m, pa.int32()), "bucket": pa.array(filled.astype(np.int32)), "words": lists}
            yield pa.RecordBatch.from_arrays([some[n] if n in some else pa.nulls(m, t) for n, t in kinds.items()], names=list(kinds))

        for b in batches:
            folds = b.column("_fold").to_numpy()
            for fold in np.unique(folds).tolist():
                own = b.filter(pa.array(folds == fold))
                held.setdefault(fold, []).append(own)
                size[fold] = size.get(fold, 0) + len(own.column("words").flatten())
                if size[fold] >= most:
                    yield from close(fold)
        for fold in list(held):
            yield from close(fold)

    return run


NUMBERED = pa.schema([("chunk", pa.int64()), ("fold", pa.int32()), ("bucket", pa.int32()), ("uses", pa.binary())])
COUNTED = pa.schema([("chunk", pa.int64()), ("fold", pa.int32()), ("bucket", pa.int32()), ("k", pa.binary()), ("u", pa.binary()), ("n", pa.list_(pa.int64()))])


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's words as its own numbers, for each chunk."""
    rows, lists = [], []
    for b in batches:
        lists.append(b.column("words"))
        rows += b.select(["chunk", "fold", "bucket"]).to_pylist()
    if not rows:
        return
    places = pa.chunked_array([x.flatten() for x in lists]).combine_chunks()
    places = (places.chunk(0) if isinstance(places, pa.ChunkedArray) else places).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.uint32)
    ends = np.cumsum(np.concatenate([x.value_lengths().to_numpy() for x in lists])).tolist()
    for r, a, b in zip(rows, [0, *ends], ends, strict=False):
        r["uses"] = packed(places[a:b])
    yield records(NUMBERED, rows)


def stream_of(rows: list[dict]) -> tuple:
    """(row of the stream, left, known, counts, numbers, edges) of a chunk: `left` marks the items that have not fallen."""
    stream = next(r for r in rows if r["counts"] is not None)
    counts = unpacked(stream["counts"], np.uint32).astype(np.int64)
    left = np.ones(len(counts), bool)
    for r in rows:
        if r["gone"] is not None:
            left[r["gone"]] = False
    return stream, left, unpacked(stream["known"], np.int8), counts, unpacked(stream["numbers"], np.uint32), unpacked(stream["edges"], np.uint32).astype(np.int64)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many known and uncertain items of a chunk hold each of its words, by bucket; n of one row a chunk has its items."""
    for rows in by_chunk(batches):
        stream, left, known, counts, numbers, edges = stream_of(rows)
        own = {k: left & (known == k) for k in (1, 0)}
        head = {"chunk": stream["chunk"], "fold": stream["fold"]}
        out = [head | {"bucket": stream["chunk"] % (len(edges) - 1), "n": [int(own[1].sum()), int(own[0].sum())]}]
        if stream["fold"] != NO_FOLD and len(numbers):
            many = [np.bincount(numbers[np.repeat(own[k], counts)], minlength=edges[-1]).astype(np.uint32) for k in (1, 0)]
            out += [head | {"bucket": b, "k": packed(many[0][edges[b] : edges[b + 1]]), "u": packed(many[1][edges[b] : edges[b + 1]])} for b in np.flatnonzero(np.diff(edges)).tolist()]
        yield records(COUNTED, out)


def others(every_fold: list[int]) -> Callable:
    """A bucket's counts without those of a chunk's own fold, for each of its words; n of a row a fold: items known and uncertain, sums of both counts, and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses: dict[int, np.ndarray] = {}
        counts, items, bucket = [], {f: np.zeros(2, np.int64) for f in every_fold}, None
        for r in rows_of(batches):
            bucket = r["bucket"]
            if r["uses"] is not None:
                uses[r["chunk"]] = unpacked(r["uses"], np.uint32)
            elif r["n"] is not None:
                items[r["fold"]] += r["n"]
            else:
                counts.append((r["chunk"], r["fold"], unpacked(r["k"], np.uint32), unpacked(r["u"], np.uint32)))
        if bucket is None:
            return
        size = max((int(x.max()) + 1 for x in uses.values()), default=0)
        total = {f: np.zeros((2, size), np.int64) for f in every_fold}
        for chunk, fold, k, u in counts:
            total[fold][0][uses[chunk]] += k
            total[fold][1][uses[chunk]] += u
        every = sum(total.values())
        for fold in every_fold:
            rest = every - total[fold]
            out = [{"fold": fold, "n": [*items[fold].tolist(), *rest.sum(1).tolist(), int((rest.sum(0) > 0).sum())]}]
            for chunk in (c[0] for c in counts if c[1] == fold):
                k, u = rest[:, uses[chunk]].astype(np.uint32)
                out.append({"chunk": chunk, "fold": fold, "bucket": bucket, "k": packed(k), "u": packed(u)})
            yield records(COUNTED, out)

    return run


def scored(odds: dict[int, tuple[float, float, float]]) -> Callable:
    """odds: of each fold the prior, and what the counts of known and of uncertain items are divided by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_chunk(batches):
            stream, left, known, counts, numbers, _ = stream_of(rows)
            sums = np.zeros(len(counts))
            if stream["fold"] != NO_FOLD:
                prior, of_known, of_uncertain = odds.get(stream["fold"], (0.0, 1.0, 1.0))
                own = sorted((r for r in rows if r["k"] is not None), key=lambda r: r["bucket"])
                if own:
                    k, u = (np.concatenate([unpacked(r[n], np.uint32) for r in own]).astype(np.float64) for n in "ku")
                    value = np.where(k + u > 0, np.log((k + 1) / of_known) - np.log((u + 1) / of_uncertain), 0.0)
                    sums = np.bincount(np.repeat(np.arange(len(counts)), counts), weights=value[numbers], minlength=len(counts))
                sums = sums + prior
            at = np.flatnonzero(left)
            mark = known[at]
            ids = pa.array(stream["ids"])
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at)), pa.array(mark == 1, mask=mark < 0), pa.array(unpacked(stream["cell"], np.int32)[at]), pa.array(np.full(len(at), stream["chunk"])), pa.array(at.astype(np.int32)), pa.array(sums[at])],
                names=["id", "known", "cell", "chunk", "row", "score"],
            )

    return run
