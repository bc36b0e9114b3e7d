"""Removal of long repeats with a logarithmic family of suffix arrays.

A byte is removed if a string of LENGTH bytes that covers it also starts earlier: in a document of smaller id, or earlier in
the same one. Matches don't cross documents.

The suffixes (the starts of all strings of LENGTH bytes) are dealt out by anchor: the smallest of the hashes of the GRAM-byte
grams inside the string, so equal strings have equal anchors and neighbouring suffixes mostly share one. Such a run of
suffixes travels as one piece of text. Anchors that occur once in the corpus cannot repeat and never travel.

Each task holds the family of its anchors. A batch of suffixes gets a suffix array (sorted by their first LENGTH bytes), is merge-scanned
against the arrays of the existing levels, and where two are equal the later one is marked. What is new becomes a level, and levels of
about equal size are merged, so that sizes grow geometrically and a suffix is moved a logarithmic number of times.

Equal pieces of text are brought together before, in the chunk of documents and again in the task. Anchors that occur more than HOT times
(the edges of very common passages) are dealt out suffix by suffix, by a hash of the whole string, so no task gets
all of one anchor; those suffixes travel with their LENGTH bytes and go through a family of suffix arrays like all others.

Defined results: null and empty texts, and texts of fewer than LENGTH bytes, lose nothing by themselves; rows that repeat (id and text) share
one result; rows that share an id only (or have none: null ids come last) are taken in the order of a hash of id and text, by which they are dealt
to chunks, so no id is a hot key; texts of any length are cut into segments of SEGMENT bytes that overlap; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, id_out, partitions, release, texts
from .dictionary import loosen, pack_words, squeeze, unpack_words
from .minhash import mixed

LENGTH = 100
GRAM = 24
HOT = 512
CHUNK_BYTES = 8_000_000
PACK_BYTES = 32_000_000
SEGMENT = 1 << 22
GROUP = 1 << 18
BATCH = 1 << 15
FAMILY = 150_000
#: Texts of one id lie this far apart, so that all their places are ordered.
APART = 1 << 40
_PLACE = np.uint64((1 << 28) - 1)
_BASE = 0x9E3779B97F4A7C15


def power(k: int, base: int = _BASE) -> np.uint64:
    return np.uint64(pow(base, k, 1 << 64))


def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all grams: polynomial, by doubling, from the binary digits of the length."""
    level, size, out, done = buf.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if gram & size:
            out = level if out is None else level[: len(out) - size] * power(done) + out[size:] if done else level
            done += size
        if size * 2 > gram:
            break
        level = level[:-size] * power(size) + level[size:]
        size *= 2
    return mixed(out[: len(buf) - gram + 1])


def runs(buf: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of suffixes with one anchor in a buffer of segments: (first, last, anchor's hash, segment)."""
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none, none.astype(np.uint64), none
    h = gram_hashes(buf, gram)
    keys = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width, low = length - gram + 1, keys
    size = 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    anchor = (low & _PLACE).astype(np.int64)
    n = len(anchor)
    starts = np.concatenate([[0], ends[:-1]])
    valid = np.zeros(n + 1, np.int32)
    long = ends - starts >= length
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - length + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    change = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    edge = np.zeros(n, bool)
    edge[starts[starts < n]] = True
    first = valid & (change | edge | np.concatenate([[True], ~valid[:-1]]))
    last = valid & np.concatenate([first[1:] | ~valid[1:], [True]])
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    return lo, hi, h[anchor[lo]], np.searchsorted(ends, lo, side="right")


def distinct_rows(rows: list[tuple[int, int, bytes]]) -> tuple[list[tuple[int, int, bytes]], list[int]]:
    """(id, place of its first byte, text) of the distinct (id, hash, text) rows, and for each row which of them it is."""
    of: dict[tuple[int, int, bytes], int] = {}
    for r in sorted({r[:3] for r in rows}):
        of[r] = len(of)
    out: list[tuple[int, int, bytes]] = []
    for i, _, t, *_ in of:
        out.append((i, out[-1][1] + APART if out and out[-1][0] == i else 0, t))
    return out, [of[r[:3]] for r in rows]


def grouped_runs(docs: list[tuple[int, int, bytes]], length: int, gram: int) -> Iterator[tuple]:
    """Runs of a chunk's documents, a group of GROUP bytes at a time: (buffer, first, last, hash, id, place)."""
    segments: list[tuple[int, int, bytes]] = []
    size = 0

    def close():
        buf = np.frombuffer(b"".join(s for _, _, s in segments), np.uint8)
        ends = np.cumsum(np.fromiter((len(s) for _, _, s in segments), np.int64, len(segments)))
        lo, hi, h, of = runs(buf, ends, length, gram)
        starts = np.concatenate([[0], ends[:-1]])
        ids, bases = np.array([i for i, _, _ in segments], np.int64), np.array([b for _, b, _ in segments], np.int64)
        return buf, lo, hi, h, ids[of], bases[of] + lo - starts[of]

    for i, base, t in docs:
        if len(t) < length:
            continue
        for at in range(0, len(t) - length + 1, SEGMENT):
            segments.append((i, base + at, t[at : at + SEGMENT + length - 1]))
            size += len(segments[-1][2])
            if size >= GROUP:
                yield close()
                segments, size = [], 0
    if segments:
        yield close()


def kept_first(strings: np.ndarray, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, marks of the first of each group of equal strings in it)."""
    order = np.lexsort((places, ids, strings))
    strings = strings[order]
    return order, np.concatenate([[True], strings[1:] != strings[:-1]])


class Levels:
    """A family of suffix arrays. Suffixes are numbers into arrays of (id, home, place), which order them; equal strings keep the earliest.

    A home is the chunk of documents that a suffix comes from; chunks are ordered by the hash that deals rows to them.
    """

    def __init__(self, ids: np.ndarray, homes: np.ndarray, places: np.ndarray):
        self.ids, self.homes, self.places, self.late = ids, homes, places, np.zeros(len(ids), bool)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def earlier(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        same = self.ids[a] == self.ids[b]
        home, other = self.homes[a], self.homes[b]
        return (self.ids[a] < self.ids[b]) | (same & (home < other)) | (same & (home == other) & (self.places[a] < self.places[b]))

    def add(self, keys: np.ndarray, own: np.ndarray) -> None:
        """A batch: its suffix array, the scan of each level, the levels' merges."""
        by = np.lexsort((self.places[own], self.homes[own], self.ids[own]))
        keys, own = keys[by], own[by]
        order = np.argsort(keys, kind="stable")
        keys, own = keys[order], own[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        self.late[own[~new]] = True
        keys, own = keys[new], own[new]
        for k, (have, held) in enumerate(self.levels):
            at = np.searchsorted(have, keys)
            hit = np.flatnonzero(have[np.minimum(at, len(have) - 1)] == keys)
            old = held[at[hit]]
            before = self.earlier(own[hit], old)
            self.late[np.where(before, old, own[hit])] = True
            held[at[hit]] = np.where(before, own[hit], old)
            rest = np.ones(len(keys), bool)
            rest[hit] = False
            keys, own = keys[rest], own[rest]
        if len(keys):
            self.levels.append((keys, own))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            (a, x), (b, y) = self.levels.pop(-2), self.levels.pop()
            keys, own = np.concatenate([a, b]), np.concatenate([x, y])
            order = np.argsort(keys, kind="stable")  # two sorted runs: one pass
            self.levels.append((keys[order], own[order]))


def suffix_repeats(pieces: list[bytes], ids: np.ndarray, places: np.ndarray, homes: np.ndarray, length: int) -> list[tuple[int, int, int, int]]:
    """(home, id, start, end) of the removed stretches of pieces of text that share anchors."""
    out: list[tuple[int, int, int, int]] = []
    first: dict[bytes, int] = {}
    for k in np.lexsort((places, homes, ids)).tolist():  # equal pieces: all but the earliest go whole
        if first.setdefault(pieces[k], k) != k:
            out.append((int(homes[k]), int(ids[k]), int(places[k]), int(places[k]) + len(pieces[k])))
    own = sorted(first.values())
    if not own:
        return out
    lens = np.fromiter((len(pieces[k]) for k in own), np.int64, len(own))
    buf = np.frombuffer(b"".join(pieces[k] for k in own), np.uint8)
    many = lens - length + 1
    ends, stops = np.cumsum(lens), np.cumsum(many)
    inner = np.arange(int(stops[-1])) - np.repeat(stops - many, many)
    at = np.repeat(ends - lens, many) + inner
    chosen = np.array(own)
    home = np.repeat(homes[chosen], many)
    family = Levels(np.repeat(ids[chosen], many), home, np.repeat(places[chosen], many) + inner)
    for low in range(0, len(at), BATCH):
        part = np.arange(low, min(low + BATCH, len(at)))
        keys = buf[at[part][:, None] + np.arange(length)].view(f"S{length}").ravel()
        family.add(keys, part)
    late = family.late
    edge = np.zeros(len(late) + 1, bool)
    edge[stops - many] = edge[stops] = True
    begin = np.flatnonzero(late & (edge[:-1] | ~np.concatenate([[False], late[:-1]])))
    end = np.flatnonzero(late & (edge[1:] | ~np.concatenate([late[1:], [False]])))
    out += zip(home[begin].tolist(), family.ids[begin].tolist(), family.places[begin].tolist(), (family.places[end] + length).tolist(), strict=True)
    return out


ROWS = "kind int, chunk long, part int, a binary, b binary, c binary, d binary"


def row_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4)
    cols = list(zip(*[(*r, *[None] * (7 - len(r))) for r in rows], strict=True)) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["kind", "chunk", "part", "a", "b", "c", "d"])


def dealt(values: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Where the values of each part are."""
    part = (values >> np.uint64(20)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64)).tolist()
    for p in range(parts):
        if edges[p] < edges[p + 1]:
            yield p, order[edges[p] : edges[p + 1]]


def packed_docs(chunk: int, rows: list[tuple[int, int, bytes, bytes]]) -> tuple:
    ids, hashes, texts_, more = zip(*rows, strict=True)
    return 0, chunk, 0, squeeze(np.array(ids, np.int64)), squeeze(pack_words(texts_), 6), squeeze(np.array(hashes, np.int64)), squeeze(pack_words(more))


def unpacked_docs(row: dict) -> list[tuple[int, int, bytes, bytes]]:
    """(id, hash, text, what the caller sends along) of a chunk's rows."""
    return list(zip(loosen(row["a"], np.int64).tolist(), loosen(row["c"], np.int64).tolist(), *(unpack_words(loosen(row[k])) for k in "bd"), strict=True))


def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's documents for each chunk, packed, PACK_BYTES of text at a time."""
    by: dict[int, list[tuple[int, int, bytes, bytes]]] = {}
    size = 0

    def close() -> pa.RecordBatch:
        return row_batch([(c, *packed_docs(c, rows)[1:]) for c, rows in by.items()])

    for b in batches:
        for c, i, h, t, x in zip(*(b.column(k).to_pylist() for k in ("chunk", "_id", "hash")), *(b.column(k).cast(pa.binary()).to_pylist() for k in ("text", "along")), strict=True):
            by.setdefault(c, []).append((i, h, t, x))
            size += len(t)
        if size >= PACK_BYTES:
            yield close()
            by, size = {}, 0
    if by:
        yield close()
    release()


def chunk_table(docs: DataFrame) -> tuple[DataFrame, int]:
    """Documents dealt by a hash of id and text to chunks of about CHUNK_BYTES, one row each; ranges of the hash, so chunks are in its order."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(partitions(docs.sparkSession), -(-size // CHUNK_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[tuple[int, int, bytes, bytes]]] = {}
        for b in batches:
            for row in b.to_pylist():
                by.setdefault(row["chunk"], []).extend(unpacked_docs(row))
        while by:
            yield row_batch([packed_docs(*by.popitem())])
        release()

    hashed = docs.withColumn("hash", F.shiftrightunsigned(F.xxhash64("_id", "text"), 32))
    packed = hashed.withColumn("chunk", F.shiftright(F.col("hash") * chunks, 32)).mapInArrow(packs, ROWS)
    return cut(packed.repartitionById(chunks, F.col("kind")).mapInArrow(run, ROWS), "chunks", "none"), chunks


def anchors_of_chunks(parts: int, length: int, gram: int):
    """Each chunk's distinct anchors for each part, with how often they occur in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            docs, _ = distinct_rows(unpacked_docs(row))
            found = [h for _, _, _, h, _, _ in grouped_runs(docs, length, gram)]
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield row_batch([(1, row["chunk"], p, h[at].tobytes(), squeeze(np.minimum(n[at], HOT + 1).astype(np.uint16))) for p, at in dealt(h, parts)])
            del docs, found
            release()

    return run


def repeated_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk, those of its anchors that occur more than once in the corpus, and which are hot."""
    rows = [r for b in batches for r in b.to_pylist()]
    if not rows:
        return
    each = [np.frombuffer(r["a"], np.uint64) for r in rows]
    h, at = np.unique(np.concatenate(each), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([loosen(r["b"], np.uint16) for r in rows]), minlength=len(h))
    low = 0
    for r, own in zip(rows, each, strict=True):
        times = total[at[low : low + len(own)]]
        low += len(own)
        again = times > 1
        if again.any():
            yield row_batch([(1, r["chunk"], r["part"], own[again].tobytes(), (times[again] > HOT).astype(np.uint8).tobytes())])


def strings_of(buf: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings of `length` bytes that start at these places, and a hash of each."""
    h = np.zeros(len(at), np.uint64)
    for k in range(length):
        h = h * np.uint64(_BASE) + (buf[at + k].astype(np.uint64) + np.uint64(1))
    return buf[at[:, None] + np.arange(length)].view(f"S{length}").ravel(), mixed(h)


def pieces_of_chunks(parts: int, length: int, gram: int):
    """Each chunk's pieces of text with repeated anchors (kind 1), hot suffixes (kind 2), and what is known to go (kind 3)."""

    def of_chunk(chunk: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        docs, _ = distinct_rows(unpacked_docs(next(r for r in rows if r["kind"] == 0)))
        sent = [r for r in rows if r["kind"] == 1]
        if not sent:
            return
        again, hot = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in sent]), np.concatenate([np.frombuffer(r["b"], np.uint8) for r in sent])
        order = np.argsort(again)
        again, hot = again[order], hot[order]
        first: dict[bytes, tuple] = {}
        gone: list[tuple[int, int, int]] = []
        singles: list[list[np.ndarray]] = [[], [], [], []]  # strings, hashes, ids, places
        for buf, lo, hi, h, ids, places in grouped_runs(docs, length, gram):
            at = np.minimum(np.searchsorted(again, h), len(again) - 1)
            repeats = again[at] == h
            raw = buf.tobytes()
            for k in np.flatnonzero(repeats & (hot[at] == 0)).tolist():  # documents come in order, so the first is the earliest
                text = raw[lo[k] : hi[k] + length]
                if first.setdefault(text, (int(h[k]), int(ids[k]), int(places[k])))[1:] != (ids[k], places[k]):
                    gone.append((int(ids[k]), int(places[k]), int(places[k]) + len(text)))
            own = np.flatnonzero(repeats & (hot[at] == 1))
            if len(own):
                many = hi[own] - lo[own] + 1
                stops = np.cumsum(many)
                inner = np.arange(int(stops[-1])) - np.repeat(stops - many, many)
                strings = strings_of(buf, np.repeat(lo[own], many) + inner, length)
                for s, v in zip(singles, (*strings, np.repeat(ids[own], many), np.repeat(places[own], many) + inner), strict=True):
                    s.append(v)
        if first:
            texts_, info = list(first), list(first.values())
            h, ids, places = np.array([x[0] for x in info], np.uint64), np.array([x[1] for x in info], np.int64), np.array([x[2] for x in info], np.int64)
            yield row_batch([(1, chunk, p, squeeze(pack_words([texts_[k] for k in at.tolist()])), squeeze(h[at]), squeeze(ids[at]), squeeze(places[at])) for p, at in dealt(h, parts)])
        if singles[0]:
            strings, h, ids, places = map(np.concatenate, singles)
            order, new = kept_first(strings, ids, places)
            later = order[~new]
            gone += zip(ids[later].tolist(), places[later].tolist(), (places[later] + length).tolist(), strict=True)
            keep = order[new]
            yield row_batch([(2, chunk, p, squeeze(strings[keep[at]].tobytes()), None, squeeze(ids[keep[at]]), squeeze(places[keep[at]])) for p, at in dealt(h[keep], parts)])
        if gone:
            yield row_batch([(3, chunk, chunk % parts, squeeze(np.array(gone, np.int64)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, list[dict]] = {}
        for r in (r for b in batches for r in b.to_pylist()):
            chunks.setdefault(r["chunk"], []).append(r)
        while chunks:
            yield from of_chunk(*chunks.popitem())
            release()

    return run


def repeats_of_parts(length: int):
    """Each chunk's removed stretches, found by the families of a part's anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        out: dict[int, list[np.ndarray]] = {}
        for r in rows:
            if r["kind"] == 3:
                out.setdefault(r["chunk"], []).append(loosen(r["a"], np.int64).reshape(-1, 3))
        pieces = [r for r in rows if r["kind"] == 1]
        if pieces:
            texts_ = [t for r in pieces for t in unpack_words(loosen(r["a"]))]
            h, ids, places = (np.concatenate([loosen(r[k], t) for r in pieces]) for k, t in (("b", np.uint64), ("c", np.int64), ("d", np.int64)))
            homes = np.repeat([r["chunk"] for r in pieces], [len(loosen(r["b"])) // 8 for r in pieces])
            order = np.argsort(h, kind="stable")
            size = np.cumsum(np.fromiter((len(texts_[k]) - length + 1 for k in order.tolist()), np.int64, len(order)))
            low = 0
            while low < len(order):  # several anchors to a family, and no anchor in two
                high = int(np.searchsorted(size, (size[low - 1] if low else 0) + FAMILY, side="right"))
                high = max(high, low + 1)
                while high < len(order) and h[order[high]] == h[order[high - 1]]:
                    high += 1
                own = order[low:high]
                for home, i, a, b in suffix_repeats([texts_[k] for k in own.tolist()], ids[own], places[own], homes[own], length):
                    out.setdefault(home, []).append(np.array([[i, a, b]], np.int64))
                low = high
        single = [r for r in rows if r["kind"] == 2]
        if single:
            strings = np.frombuffer(b"".join(loosen(r["a"]) for r in single), f"S{length}")
            ids, places = (np.concatenate([loosen(r[k], np.int64) for r in single]) for k in "cd")
            homes = np.repeat([r["chunk"] for r in single], [len(loosen(r["d"])) // 8 for r in single])
            family = Levels(ids, homes, places)
            for low in range(0, len(strings), BATCH):
                family.add(strings[low : low + BATCH], np.arange(low, min(low + BATCH, len(strings))))
            later = np.flatnonzero(family.late)
            for home in np.unique(homes[later]).tolist():
                at = later[homes[later] == home]
                out.setdefault(home, []).append(np.stack([ids[at], places[at], places[at] + length], 1))
            del strings, family
        for home, found in out.items():
            spans = np.concatenate(found)
            order = np.lexsort((spans[:, 1], spans[:, 0]))
            yield row_batch([(1, home, 0, squeeze(spans[order]))])
        del rows, out
        release()

    return run


def cleaned(keep_text: bool):
    """Per row of a chunk: bytes, bytes and stretches removed, digest of the rest, the rest if asked for, and what the caller sent along.

    Bytes of characters that are cut in two are left out of the rest as text.
    """

    def of_chunk(rows: list[dict]) -> pa.RecordBatch:
        all_rows = unpacked_docs(next(r for r in rows if r["kind"] == 0))
        docs, of = distinct_rows(all_rows)
        where = {(i, base // APART): k for k, (i, base, _) in enumerate(docs)}
        spans: list[list[tuple[int, int]]] = [[] for _ in docs]
        for r in rows:
            if r["kind"] == 1:
                for i, a, b in loosen(r["a"], np.int64).reshape(-1, 3).tolist():
                    k = where[i, a // APART]
                    spans[k].append((a - docs[k][1], b - docs[k][1]))
        done = []
        for (_, _, text), found in zip(docs, spans, strict=True):
            kept, removed, merged, at = [], 0, 0, 0
            end = -1
            for a, b in sorted(found):
                if a > end:
                    merged += 1
                    kept.append(text[at:a])
                if b > end:
                    removed += b - max(a, end)
                    at = end = b
            kept.append(text[at:])
            rest = b"".join(kept)
            done.append((len(text), removed, merged, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if keep_text else None))
        cols = list(zip(*[(i, *done[k], x.decode()) for (i, _, _, x), k in zip(all_rows, of, strict=True)], strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 4, *[pa.string()] * 3), strict=True)], names=["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "along"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, list[dict]] = {}
        for r in (r for b in batches for r in b.to_pylist()):
            chunks.setdefault(r["chunk"], []).append(r)
        while chunks:
            yield of_chunk(chunks.popitem()[1])
            release()

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False, along: Column | None = None) -> DataFrame:
    """Per row of docs: _id, n_bytes, n_removed, n_spans, kept_sha256, kept (the rest, if asked for) and along (a text that the caller wants back with each row)."""
    table, chunks = chunk_table(texts(docs.withColumn("along", F.lit("") if along is None else F.coalesce(along, F.lit(""))), "along"))
    parts = partitions(docs.sparkSession)
    home = F.col("chunk").cast("int")
    to_part = lambda df: df.repartitionById(parts, F.col("part"))
    again = to_part(table.mapInArrow(anchors_of_chunks(parts, length, gram), ROWS)).mapInArrow(repeated_anchors, ROWS)
    pieces = table.unionByName(again).repartitionById(chunks, home).mapInArrow(pieces_of_chunks(parts, length, gram), ROWS)
    spans = to_part(pieces).mapInArrow(repeats_of_parts(length), ROWS)
    return table.unionByName(spans).repartitionById(chunks, home).mapInArrow(cleaned(keep_text), "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, along string")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir, "doc_id", "text"))
    return out.select(id_out(), "n_bytes", "n_removed", "n_spans", "kept_sha256")
