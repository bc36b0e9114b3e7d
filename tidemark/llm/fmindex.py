"""Benchmark decontamination with an FM-index for each training shard.

A shard (a stretch of documents of about SHARD_BYTES) becomes a sequence of word numbers. Words that no benchmark item
uses cannot lie inside an occurrence, so only stretches of benchmark words that are long enough for the shortest
phrase are kept, each ended by a separator of its own. The suffix array of that sequence gives its Burrows-Wheeler
transform, held as a wavelet matrix; all test phrases are searched backwards at once by its ranks, occurrences are
located by walking to the nearest sampled suffix position, and the spans found are merged to the words to remove.

The benchmark's texts are cut into stretches of STRETCH words that overlap by a window less a word, and dealt to blocks of about BLOCK_BYTES. A block
is sent to all tasks, searched for in one pass over the documents and given up; the hits of several passes are merged by document. So
neither the driver nor a task ever holds more than a block, and the plan of a pass does not grow with the benchmark.

Defined results: a null or empty text has no words; an item without words has no phrases; repeated items and repeated
rows each count; words of an item without an id are hit like any others, but such items are not listed; null doc_ids are kept; texts of any length
are searched whole; a phrase that several items share counts for each; empty tables give no rows, or clean documents;
columns beyond doc_id, text and item_id are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, id_out, release, texts
from .simple8b import grouped

WINDOW = 13
SHARD_BYTES = 24_000_000
BLOCK_BYTES = 2_000_000
STRETCH = 20_000
#: Occurrences located at once.
SLICE = 1 << 20
SAMPLE = 8
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


class WaveletMatrix:
    """Ranks of symbols in a sequence of small numbers, one bit vector a level."""

    def __init__(self, seq: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for k in reversed(range(self.levels)):
            bit = (seq >> k & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(len(seq) - int(self.ones[-1][-1]))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def start(self, symbols: np.ndarray) -> np.ndarray:
        """Where each symbol's stretch starts on the last level; rank() is relative to it."""
        return self.follow(symbols, np.zeros(len(symbols), np.int64))

    def follow(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, k in enumerate(reversed(range(self.levels))):
            ones = self.ones[level][at]
            at = np.where(symbols >> k & 1, self.zeros[level] + ones, at - ones)
        return at

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            ones, after = self.ones[level][at], self.ones[level][at + 1]
            bit = after > ones
            out = out * 2 + bit
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return out


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """By prefix doubling, until all ranks differ."""
    n, step = len(ranks), 1
    order = np.argsort(ranks, kind="stable")
    while n:
        key = ranks.astype(np.int64) * (n + 1)
        key[: n - step] += ranks[step:] + 1 if step < n else 0
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        ranks = np.empty(n, np.int64)
        ranks[order] = new
        if new[-1] == n - 1:
            break
        step *= 2
    return order


class FMIndex:
    """Over words numbered from 1; 0 marks the separators, and each stretch ends with one."""

    def __init__(self, seq: np.ndarray, top: int, sample: int = SAMPLE):
        n = len(seq)
        marks = seq == 0
        first = np.cumsum(marks)
        ranks = np.where(marks, first - 1, seq.astype(np.int64) + int(first[-1] if n else 0))
        self.sa_rank = np.unique(ranks, return_inverse=True)[1] if n else ranks
        order = suffix_array(self.sa_rank.astype(np.int64))
        self.n = n
        self.bwt = seq[order - 1].astype(np.int64) if n else seq.astype(np.int64)
        self.wave = WaveletMatrix(self.bwt, top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=top + 1))])
        self.base = self.wave.start(np.arange(top + 1)) if n else np.zeros(top + 1, np.int64)
        starts = np.flatnonzero(np.concatenate([[True], marks[:-1]])) if n else np.zeros(0, np.int64)
        into = np.arange(n) - np.repeat(starts, np.diff(np.concatenate([starts, [n]])))
        kept = (into % sample == 0)[order]  # the first word of each stretch is sampled: no walk passes a separator
        self.kept, self.place, self.positions = kept, np.cumsum(kept) - 1, order[kept]

    def step(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.before[symbols] + self.wave.follow(symbols, at) - self.base[symbols]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffix array for each phrase; phrases are padded at the right."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in reversed(range(phrases.shape[1])):
            live = np.flatnonzero((k < lengths) & (low < high))
            symbols = phrases[live, k]
            low[live], high[live] = self.step(symbols, low[live]), self.step(symbols, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps, live = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(live):
            done = self.kept[rows]
            out[live[done]] = self.positions[self.place[rows[done]]] + steps
            live, rows = live[~done], rows[~done]
            rows = self.step(self.bwt[rows], rows)
            steps += 1
        return out


class Phrases:
    """Word numbers (from 1) and the distinct phrases of a block: a table padded at the right, lengths, and the numbers of the items of each."""

    def __init__(self, rows: list[tuple[int | None, bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({i for i, _ in rows if i is not None})
        place = {i: k for k, i in enumerate(self.items)}
        tables, owners = [np.zeros((0, WINDOW), np.int32)], [np.zeros(0, np.int64)]
        for item, text in rows:
            numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in text.split()], np.int32)
            if not len(numbers):
                continue
            short = WINDOW - min(WINDOW, len(numbers))
            tables.append(np.lib.stride_tricks.sliding_window_view(np.pad(numbers, (0, short)), WINDOW))
            owners.append(np.full(len(tables[-1]), place.get(item, -1), np.int64))
        table, owner = np.concatenate(tables), np.concatenate(owners)
        keys = np.ascontiguousarray(table).view(f"V{4 * WINDOW}").ravel()
        _, first, own = np.unique(keys, return_index=True, return_inverse=True)
        self.table = table[first].astype(np.int64)
        self.lengths = (self.table > 0).sum(1)
        pairs = np.unique(own[owner >= 0] * max(1, len(self.items)) + owner[owner >= 0])
        self.listed = pairs % max(1, len(self.items))
        self.edges = np.searchsorted(pairs // max(1, len(self.items)), np.arange(len(self.table) + 1))

    def items_of(self, phrases: np.ndarray) -> list[int]:
        return sorted({self.items[k] for p in phrases.tolist() for k in self.listed[self.edges[p] : self.edges[p + 1]].tolist()})


def shard_hits(docs: list[list[bytes]], sought: Phrases) -> list[tuple[np.ndarray, np.ndarray, list[int]]]:
    """Per document of a shard: starts and ends of the merged word spans inside occurrences, and the items found."""
    counts = np.fromiter(map(len, docs), np.int64, len(docs))
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    out: list[tuple[np.ndarray, np.ndarray, list[int]]] = [(*none, []) for _ in docs]
    if not total or not len(sought.table):
        return out
    numbers = np.fromiter(map(sought.vocabulary.get, chain.from_iterable(docs), repeat(0)), np.int64, total)
    known = numbers > 0
    edge = np.zeros(total + 1, bool)
    edge[ends] = edge[ends - counts] = True
    first = known & (edge[:-1] | np.concatenate([[True], ~known[:-1]]))
    last = known & (edge[1:] | np.concatenate([~known[1:], [True]]))
    low, high = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = high - low >= sought.lengths.min()
    low, high = low[long], high[long]
    if not len(low):
        return out
    size = high - low + 1
    stop = np.cumsum(size)
    source = np.repeat(low - (stop - size), size) + np.arange(int(stop[-1]))  # place in the shard of each place in the sequence
    seq = numbers[np.minimum(source, total - 1)]
    seq[stop - 1] = 0
    index = FMIndex(seq, len(sought.vocabulary))
    a, b = index.search(sought.table, sought.lengths)
    hits = np.flatnonzero(b > a)
    if not len(hits):
        return out
    many = b[hits] - a[hits]
    upto = np.cumsum(many)
    depth, pairs = np.zeros(total + 1, np.int64), np.zeros(0, np.int64)
    for begin in range(0, int(upto[-1]), SLICE):
        each = np.arange(begin, min(begin + SLICE, int(upto[-1])))
        k = np.searchsorted(upto, each, side="right")
        at = source[index.locate(a[hits[k]] + each - (upto - many)[k])]
        depth += np.bincount(at, minlength=total + 1) - np.bincount(at + sought.lengths[hits[k]], minlength=total + 1)
        pairs = np.union1d(pairs, np.searchsorted(ends, at, side="right") * len(sought.table) + hits[k])
    hit = np.cumsum(depth)[:-1] > 0
    starts = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([[False], hit[:-1]])))
    stops = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]]))) + 1
    owner, of = np.searchsorted(ends, starts, side="right"), pairs // len(sought.table)
    for d in np.unique(owner).tolist():
        own, begin = slice(*np.searchsorted(owner, [d, d + 1])), ends[d] - counts[d]
        mine = slice(*np.searchsorted(of, [d, d + 1]))
        out[d] = (starts[own] - begin, stops[own] - begin, sought.items_of(pairs[mine] % len(sought.table)))
    return out


SPANS = "_id long, sha256 string, n_words long, spans array<struct<start: long, end: long>>, items array<long>"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def searched(block):
    """One block of the benchmark (a broadcast value) against the shards of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = Phrases(block.value)
        for ids, group in grouped(batches, SHARD_BYTES):
            docs = [words_of(t) for t in group]
            rows = shard_hits(docs, sought)
            spans = [[{"start": s, "end": e} for s, e in zip(a.tolist(), b.tolist(), strict=True)] for a, b, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in group], pa.string()), pa.array(list(map(len, docs)), pa.int64()), pa.array(spans, SPAN), pa.array([x for _, _, x in rows], pa.list_(pa.int64()))],
                names=["_id", "sha256", "n_words", "spans", "items"],
            )
            del docs, rows, spans
            release()

    return run


def merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def merged_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = [merged([s for own in row for s in own]) for row in b.column("spans").to_pylist()]
        items = [sorted({i for own in row for i in own}) for row in b.column("items").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("sha256"), pa.array(spans, SPAN), pa.array(items, pa.list_(pa.int64()))], names=["_id", "sha256", "spans", "items"])


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, number, words) of benchmark texts: at most STRETCH windows each."""
    for b in batches:
        rows = []
        for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
            words = words_of(text)
            for k, low in enumerate(range(0, max(1, len(words) - WINDOW + 1), STRETCH)):
                rows.append((item, k, b" ".join(words[low : low + STRETCH + WINDOW - 1])))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["item", "k", "words"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: _id, sha256 of the text, n_words, merged word spans inside occurrences, and items with occurrences."""
    spark, docs = docs.sparkSession, texts(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item"), "text").where("text is not null")
    items = cut(items.mapInArrow(stretches, "item long, k long, words binary"), "phrases")
    size = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    whole, hits = None, []
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "k", "words"), F.lit(blocks)) == k).select("item", "words").collect()  # BLOCK_BYTES or so
        block = spark.sparkContext.broadcast([(r["item"], bytes(r["words"])) for r in rows])
        found = docs.mapInArrow(searched(block), SPANS)
        if blocks == 1:
            return found
        if whole is None:
            whole = cut(found, "searched")
            hits.append(whole.where("size(spans) > 0").select("_id", "sha256", "spans", "items").dropDuplicates(["_id", "sha256"]))
        else:
            hits.append(cut(found.where("size(spans) > 0").select("_id", "sha256", "spans", "items").dropDuplicates(["_id", "sha256"]), "searched"))
        block.unpersist()
    both = hits[0]
    for h in hits[1:]:
        both = both.unionByName(h)
    lists = both.groupBy("_id", "sha256").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))  # one list a block
    lists = lists.mapInArrow(merged_rows, "_id long, sha256 string, spans array<struct<start: long, end: long>>, items array<long>")
    out = whole.drop("spans", "items").join(lists, ["_id", "sha256"], "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(whole.schema[c].dataType)).alias(c)
    return out.select("_id", "sha256", "n_words", empty("spans"), empty("items"))


def hit_words() -> Column:
    return F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]), F.lit(0))


def contaminated() -> Column:
    """A twentieth or more of the words are hit."""
    return (hit_words() > 0) & (20 * hit_words() >= F.col("n_words"))


def op5_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir, "doc_id", "text"), documents(spark, sf_dir, "item_id", "text", table="benchmark"))
    digest = F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ","), 256)
    return found.select(id_out(), "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), contaminated().alias("contaminated"))
