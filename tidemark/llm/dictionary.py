"""Corpus-wide joins on words without shuffling every occurrence.

A task reads documents in chunks of about CHUNK_BYTES. Each chunk numbers its own distinct words and keeps its documents as
one packed stream of those numbers, in their order: positions stay where they are. Only a chunk's distinct words
travel, dealt into buckets by hash and packed to one blob for each bucket. A bucket's task meets each word of the
corpus once, gives it its value, and the values travel back to the chunk, which reads its stream with them.

A word occurs in as many blobs as there are chunks that use it, never as often as it occurs, so frequent words are no hot keys.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, release
from .simple8b import grouped

CHUNK_BYTES = 16_000_000
GROUP_BYTES = 2_000_000
ROWS = "kind int, chunk long, part int, head binary, body binary, tail binary"


def squeeze(a: np.ndarray | bytes, level: int = 5) -> bytes:
    """Numbers are packed byte by byte of their width: high bytes, mostly zero, take next to nothing."""
    raw = a if isinstance(a, bytes) else np.ascontiguousarray(a.ravel()).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=level).compress(raw)


def loosen(b: bytes, kind: type | None = None):
    raw = zstandard.ZstdDecompressor().decompress(b)
    if kind is None:
        return raw
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def pack_words(words: list[bytes]) -> bytes:
    lens = np.fromiter(map(len, words), np.uint32, len(words))
    return len(words).to_bytes(4, "little") + lens.view(np.uint8).reshape(-1, 4).T.tobytes() + b"".join(words)


def unpack_words(blob: bytes) -> list[bytes]:
    n = int.from_bytes(blob[:4], "little")
    lens = np.ascontiguousarray(np.frombuffer(blob, np.uint8, 4 * n, 4).reshape(4, n).T).view(np.uint32).ravel()
    ends = np.cumsum(lens, dtype=np.int64) + 4 + 4 * n
    stops = ends.tolist()
    return [blob[a:b] for a, b in zip([4 + 4 * n, *stops], stops, strict=False)]


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["kind", "chunk", "part", "head", "body", "tail"])


def chunk_rows(new_coder: Callable, buckets: int, weigh: Callable[[list[int]], np.ndarray] | None):
    """A chunk's stream (kind 0: ids, counts, numbers) and its words for each bucket (kind 1: words, steps of their numbers, weights).

    new_coder() gives (code, words): code(texts) numbers words and gives (numbers, count for each text); words() are the distinct words, as
    bytes, in the order of their numbers. weigh(ids) marks the documents whose words are counted as weights.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        ids, counts, numbers, size = [], [], [], 0
        code, words = new_coder()

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal code, words
            flat = np.concatenate(numbers) if numbers else np.zeros(0, np.uint32)
            per = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            numbers.clear()
            own = words()
            code = words = None
            times = np.bincount(flat, minlength=len(own))
            bucket = np.fromiter(map(zlib.crc32, own), np.int64, len(own)) % buckets
            alphabetical = np.empty(len(own), np.int64)
            alphabetical[sorted(range(len(own)), key=own.__getitem__)] = np.arange(len(own))
            # frequent words get small numbers, which pack well; of about equal ones, a bucket's words follow each other in order
            order = np.lexsort((alphabetical, bucket, -np.log2(np.maximum(times, 1)).astype(np.int64)))
            rank = np.empty(len(own), np.uint32)
            rank[order] = np.arange(len(own), dtype=np.uint32)
            stream = squeeze(rank[flat], 7)
            chunk = (part << 20) + k
            yield batch([(0, chunk, part + 7919 * k, squeeze(np.array(ids, np.int64)), stream, squeeze(per.astype(np.uint32)))])
            weights = None
            if weigh is not None:
                weights = np.bincount(flat[np.repeat(weigh(ids), per)], minlength=len(own))[order]
            own = [own[i] for i in order.tolist()]
            bucket = bucket[order]
            by = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[by], np.arange(buckets + 1)).tolist()
            rows = []
            for b in range(buckets):
                at = by[edges[b] : edges[b + 1]]  # ascending: their steps pack well
                if len(at):
                    rows.append((1, chunk, b, squeeze(pack_words([own[i] for i in at.tolist()])), squeeze(np.diff(at, prepend=0).astype(np.uint32)), None if weights is None else squeeze(weights[at].astype(np.int64))))
            yield batch(rows)

        for new_ids, group in grouped(batches, GROUP_BYTES):
            flat, per = code(group)
            ids += new_ids
            counts.append(per)
            numbers.append(flat.astype(np.uint32))
            size += sum(map(len, group))
            if size >= CHUNK_BYTES:
                yield from close()
                k, ids, counts, numbers, size = k + 1, [], [], [], 0
                code, words = new_coder()
                release()
        if ids:
            yield from close()
        ids, counts, numbers, code, words = [], [], [], None, None
        release()

    return run


def chunked(docs: DataFrame, new_coder: Callable, weigh: Callable[[list[int]], np.ndarray] | None = None) -> DataFrame:
    """The chunk table of (_id, text) rows, written to the shared folder."""
    return cut(docs.mapInArrow(chunk_rows(new_coder, partitions(docs.sparkSession), weigh), ROWS), "chunks", "none")


def by_bucket(table: DataFrame) -> DataFrame:
    n = partitions(table.sparkSession)
    return table.where("kind = 1").repartitionById(n, F.pmod("part", F.lit(n)).cast("int"))


def with_values(table: DataFrame, values: Callable[[list[bytes], np.ndarray], list[np.ndarray]]) -> DataFrame:
    """kind 1 rows with, for each word of the chunk, its value: values(distinct words, weights) gives (lens, flat).

    The value of a word is a row of numbers; head holds the steps of the words' numbers, body the lens, tail the flat values (int64).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        place: dict[bytes, int] = {}
        uses, weights = [], []
        for r in rows:
            own = unpack_words(loosen(r["head"]))
            uses.append(np.fromiter((place.setdefault(w, len(place)) for w in own), np.int64, len(own)))
            if r["tail"] is not None:
                weights.append(loosen(r["tail"], np.int64))
        total = np.bincount(np.concatenate(uses), weights=np.concatenate(weights), minlength=len(place)).astype(np.int64) if weights else np.zeros(len(place), np.int64)
        if not rows:
            return
        lens, flat = values(list(place), total)
        starts = np.cumsum(lens) - lens
        for low in range(0, len(rows), 256):
            out = []
            for r, at in zip(rows[low : low + 256], uses[low : low + 256], strict=True):
                own = lens[at]
                ends = np.cumsum(own)
                out.append((1, r["chunk"], r["part"], r["body"], squeeze(own.astype(np.uint32)), squeeze(flat[np.repeat(starts[at] - (ends - own), own) + np.arange(int(ends[-1]))].astype(np.int64))))
            yield batch(out)

    return by_bucket(table).mapInArrow(run, ROWS)


def read_chunks(table: DataFrame, valued: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """finish(ids, counts, numbers, lens, flat) of each chunk, as a record batch: lens and flat hold the words' values by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, list[dict]] = {}
        for b in batches:
            for r in b.to_pylist():
                chunks.setdefault(r["chunk"], []).append(r)
        while chunks:
            _, rows = chunks.popitem()
            stream = next(r for r in rows if r["kind"] == 0)
            numbers = loosen(stream["body"], np.uint32).astype(np.int64)
            words = [r for r in rows if r["kind"] == 1]
            at = np.concatenate([np.cumsum(loosen(r["head"], np.uint32)) for r in words] or [np.zeros(0, np.uint32)])
            lens = np.concatenate([loosen(r["body"], np.uint32) for r in words] or [np.zeros(0, np.uint32)]).astype(np.int64)
            flat = np.concatenate([loosen(r["tail"], np.int64) for r in words] or [np.zeros(0, np.int64)])
            order = np.argsort(at)
            starts, lens = (np.cumsum(lens) - lens)[order], lens[order]
            ends = np.cumsum(lens)
            flat = flat[np.repeat(starts - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)]
            yield from finish(loosen(stream["head"], np.int64), loosen(stream["tail"], np.uint32).astype(np.int64), numbers, lens, flat)
            del rows, stream, words, numbers, at, lens, flat, order, starts, ends
            release()

    n = partitions(table.sparkSession)
    streams = table.where("kind = 0")
    both = streams.unionByName(valued).withColumn("home", F.pmod(F.shiftright("chunk", 20) + 7919 * F.col("chunk").bitwiseAND((1 << 20) - 1), F.lit(n)).cast("int"))
    return both.repartitionById(n, F.col("home")).drop("home").mapInArrow(run, schema)
