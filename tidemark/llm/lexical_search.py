"""Ranked lexical search over compressed postings, a document at a time.

A shard (a stretch of documents of about SHARD_BYTES) is one row of the index: its documents in ascending order of id with their numbers of terms, and
its postings in blocks of about BLOCK_POSTINGS. A block holds its terms in order, their document frequencies and, term by term, the gaps between the
places of their documents and the term frequencies, compressed. The index is written once and read for any number of query blocks.

Query items are dealt to blocks of about QUERY_BYTES; a block's weights go to all tasks, the index is read once for its document
frequencies and once for its results. In a shard, the postings of an item's terms are merged by a heap of k cursors, in the order of documents. Terms
whose largest contributions together stay below the worst of the results kept so far open no document (they are only looked up in documents that others
open), which leaves the results exact. The results of an item are a heap of bounded size keyed by score and then id, kept through all shards of a task; those
of all tasks are ranked once more.

Defined results: a null or empty text has no terms and doesn't count in N; an item without terms, and one whose terms no document holds, has no rows; each row
of the items is an item of its own, repeated ids or not, null ids too; rows of documents that repeat each count and rank; null doc_ids come last among equal
scores and stay null; texts of any length are indexed whole; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NO_ID, cut, documents, release, texts
from .dictionary import loosen, pack_words, squeeze, unpack_words
from .simple8b import grouped

TOP = 10
SHARD_BYTES = 16_000_000
BLOCK_POSTINGS = 1 << 17
QUERY_BYTES = 2_000_000
#: Bytes that belong to terms stay, A to Z in lower case; all others part terms.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

INDEX = "docs binary, lengths binary, n_docs long, n_terms long, blocks array<struct<terms: binary, dfs: binary, gaps: binary, tfs: binary>>"
BLOCKS = pa.list_(pa.struct([(k, pa.binary()) for k in ("terms", "dfs", "gaps", "tfs")]))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERMS).split()


def shard_row(ids: list[int], group: list[str]) -> dict:
    """The index of some documents."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    numbers: dict[bytes, int] = {}
    found = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in terms_of(group[k])), np.int64) for k in order]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.concatenate(found) if found else np.zeros(0, np.int64)
    names = sorted(numbers)
    rank = np.empty(len(names), np.int64)
    rank[[numbers[w] for w in names]] = np.arange(len(names))
    pairs, tfs = np.unique(rank[flat] * max(1, len(ids)) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
    term, place = pairs // max(1, len(ids)), pairs % max(1, len(ids))
    dfs = np.bincount(term, minlength=len(names))
    stops = np.cumsum(dfs)
    gaps = place.copy()
    gaps[1:] -= np.where(term[1:] == term[:-1], place[:-1], 0)
    blocks, low = [], 0
    while low < len(names):
        before = int(stops[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(stops, before + BLOCK_POSTINGS, side="right")))
        own = slice(before, int(stops[high - 1]))
        blocks.append({"terms": squeeze(pack_words(names[low:high])), "dfs": squeeze(dfs[low:high].astype(np.uint32)), "gaps": squeeze(gaps[own].astype(np.uint32)), "tfs": squeeze(tfs[own].astype(np.uint32))})
        low = high
    return {"docs": squeeze(np.array([ids[k] for k in order], np.int64)), "lengths": squeeze(lengths), "n_docs": int((lengths > 0).sum()), "n_terms": int(lengths.sum()), "blocks": blocks}


def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, group in grouped(batches, SHARD_BYTES):
        row = shard_row(ids, group)
        kinds = {"docs": pa.binary(), "lengths": pa.binary(), "n_docs": pa.int64(), "n_terms": pa.int64(), "blocks": BLOCKS}
        yield pa.RecordBatch.from_pydict({k: pa.array([row[k]], t) for k, t in kinds.items()})
        del row, ids, group
        release()


def build_index(docs: DataFrame) -> DataFrame:
    """The index of all documents, written to the shared folder: a row a shard."""
    return cut(texts(docs).mapInArrow(index_rows, INDEX), "postings", "none")


def frequencies(sought):
    """Document frequencies of the sought terms (a broadcast dictionary of numbers) in a partition's shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sought.value), np.int64)
        for b in batches:
            for terms, dfs in zip(b.column("terms").to_pylist(), b.column("dfs").to_pylist(), strict=True):
                for t, d in zip(terms, dfs, strict=True):
                    own = np.fromiter((sought.value.get(w, -1) for w in unpack_words(loosen(t))), np.int64)
                    at = np.flatnonzero(own >= 0)
                    total[own[at]] += loosen(d, np.uint32)[at]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])
        release()

    return run


def contributions(row: dict, weights: dict[bytes, tuple[int, int]], n: int, total: int) -> dict[int, tuple[list[int], list[int]]]:
    """By number of a sought term in a shard: places of its documents, and what the term adds to their scores."""
    lengths = loosen(row["lengths"], np.int64)
    m = 10 + 90 * lengths * n // total
    out = {}
    for block in row["blocks"]:
        names = unpack_words(loosen(block["terms"]))
        own = [(k, *weights[w]) for k, w in enumerate(names) if w in weights]
        if not own:
            continue
        gaps, tfs = loosen(block["gaps"], np.uint32).astype(np.int64), loosen(block["tfs"], np.uint32).astype(np.int64)
        stops = np.cumsum(loosen(block["dfs"], np.uint32).astype(np.int64)).tolist()
        for k, number, weight in own:
            cells = slice(stops[k - 1] if k else 0, stops[k])
            place, tf = np.cumsum(gaps[cells]), tfs[cells]
            out[number] = (place.tolist(), (weight * (1_000_000_000 * tf // (1000 * tf + 8 * m[place]))).tolist())
    return out


def merge_shard(lists: list[tuple[list[int], list[int]]], docs: list[int], heap: list[tuple[int, int]], top: int, tables: list[dict[int, int]]) -> None:
    """Takes a shard's best documents for an item into its heap of (score, -doc_id), whose first is the worst.

    lists are (places, contributions) in ascending order of their largest contribution, tables the same as dictionaries.
    """
    limits, most = [], 0
    for _, adds in lists:
        most += max(adds)
        limits.append(most)  # of this list and all before it together

    def opened() -> int:
        """Lists before this one open no document: all of them together stay below the worst result."""
        return bisect_right(limits, heap[0][0] - 1) if len(heap) == top else 0

    first = opened()
    cursors = [(lists[k][0][0], k, 0) for k in range(first, len(lists))]
    heapq.heapify(cursors)
    while cursors:
        place, score = cursors[0][0], 0
        while cursors and cursors[0][0] == place:  # the k-way merge: all cursors at this document
            _, k, at = cursors[0]
            score += lists[k][1][at]
            if at + 1 < len(lists[k][0]):
                heapq.heapreplace(cursors, (lists[k][0][at + 1], k, at + 1))
            else:
                heapq.heappop(cursors)
        worst = heap[0][0] if len(heap) == top else 0
        for k in range(first - 1, -1, -1):
            if score + limits[k] < worst:
                break
            score += tables[k].get(place, 0)
        else:
            entry = (score, -docs[place])
            if len(heap) < top:
                if score > 0:
                    heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == top and (now := opened()) > first:
                first = now
                cursors = [c for c in cursors if c[1] >= first]
                heapq.heapify(cursors)


def searched(block, n: int, total: int, top: int):
    """Results of a block of items, a broadcast (term -> (number, weight), [(item, numbers of its terms)]), in a partition's shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, items = block.value
        heaps: dict[int, list[tuple[int, int]]] = {}
        for b in batches:
            for row in b.to_pylist():
                found = contributions(row, weights, n, total)
                docs = loosen(row["docs"], np.int64).tolist()
                most = {k: max(adds) for k, (_, adds) in found.items()}
                tables: dict[int, dict[int, int]] = {}
                for item, numbers in items:
                    own = sorted((k for k in numbers if k in found), key=most.__getitem__)
                    if own:
                        for k in own:
                            if k not in tables:
                                tables[k] = dict(zip(*found[k], strict=True))
                        merge_shard([found[k] for k in own], docs, heaps.setdefault(item, []), top, [tables[k] for k in own])
                del found, tables, docs
                release()
        rows = [(item, -d, s) for item, heap in heaps.items() for s, d in heap]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item", "doc", "score"])

    return run


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [sorted(set(terms_of(t))) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """Per row of items (item_id, text): its `top` best documents, as item_id, rank, doc_id, score."""
    spark, index = docs.sparkSession, build_index(docs)
    n, total = (x or 0 for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(item_terms, "item_id long, terms array<binary>").where("size(terms) > 0")
    asked = cut(asked.withColumn("item", F.monotonically_increasing_id()), "items")
    size = asked.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t) + 8))).first()[0] or 0
    blocks, found = max(1, -(-size // QUERY_BYTES)), []
    for k in range(blocks if n else 0):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).select("item", "terms").collect()  # QUERY_BYTES or so
        numbers: dict[bytes, int] = {}
        own = [(r["item"], [numbers.setdefault(bytes(w), len(numbers)) for w in r["terms"]]) for r in rows]
        sought = spark.sparkContext.broadcast(numbers)
        dfs = index.select("blocks.terms", "blocks.dfs").mapInArrow(frequencies(sought), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        df = {r["term"]: r["df"] for r in dfs.collect()}  # of the block's terms alone
        weights = {w: (i, math.floor(1000 * math.log((2 * n + 2) / (2 * df[i] + 1)))) for w, i in numbers.items() if i in df}
        block = spark.sparkContext.broadcast((weights, own))
        found.append(cut(index.mapInArrow(searched(block, n, total, top), "item long, doc long, score long"), "found"))
        sought.unpersist()
        block.unpersist()
    if not found:
        found = [spark.createDataFrame([], "item long, doc long, score long")]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    ranked = every.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= top)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "score")


def op11_postings_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir, "doc_id", "text"), documents(spark, sf_dir, "item_id", "text", table="benchmark"))
