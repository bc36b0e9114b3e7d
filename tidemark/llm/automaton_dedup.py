"""Removal of repeated stretches of words with suffix automata of reference shards.

A window is LENGTH consecutive words of one document. A word is removed if a window that covers it has a word sequence that also starts earlier: in a
document of smaller id, or earlier in the same one.

A suffix automaton knows for each state where its strings end first. The words of a shard's reference stretches make one automaton, in the order of
documents, each stretch ended by a sign of its own. Documents stream through it: the state and the length of the longest match that ends at each word (the
matching statistics, held at LENGTH) give the window's earliest place. If that is another, earlier one, the window goes, and windows that go
merge to maximal spans.

An automaton of all documents in every task would make the work grow with the square of the corpus, so a shard's automaton is sent only where stretches
can match it. Windows are dealt out by anchor, the smallest hash of the GRAM-word grams inside, so equal windows meet; neighbouring windows mostly
share an anchor and travel as one stretch. Anchors with one stretch in the corpus cannot repeat and never travel. Equal stretches are brought together
before, in the chunk of documents and again in the task: the earliest is kept, the others go whole. Anchors of more than HOT different stretches (the edges of very
common passages) are dealt out again window by window, by a hash of the whole window. A task forms shards of about SHARD_WORDS words of its anchors, one at a time.

Defined results: a null or empty text has no words; texts of fewer than LENGTH words lose nothing by themselves; rows that repeat (id and text) share one result;
rows that share an id only (or have none: null ids come last) are taken in the order of a hash of the text; texts of any length are taken whole, in
segments of SEGMENT words that overlap; empty tables give no rows; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, id_out, partitions, release, texts
from .dictionary import loosen, pack_words, squeeze, unpack_words
from .suffix_dedup import ROWS, gram_hashes, row_batch, runs

LENGTH = 20
GRAM = 5
HOT = 512
CHUNK_BYTES = 8_000_000
SEGMENT = 1 << 24
GROUP = 1 << 18
SHARD_WORDS = 60_000


class SuffixAutomaton:
    """Of one sequence of numbers. first[state] is the place where the state's strings end first."""

    def __init__(self, sequence: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.first = [-1], [0], [-1]
        nxt, link, length, first, last = self.next, self.link, self.len, self.first, 0
        for at, c in enumerate(sequence):
            new = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(at + 1)
            first.append(at)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(nxt)
                    nxt.append(nxt[q].copy())
                    link.append(link[q])
                    length.append(length[p] + 1)
                    first.append(first[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new

    def statistics(self, words: list[int], most: int) -> tuple[list[int], list[int]]:
        """For each word, the length (at most `most`) of the longest match that ends with it and the place where that match ends first."""
        nxt, link, length, first = self.next, self.link, self.len, self.first
        state = held = 0
        out, ends = [], []
        for c in words:
            while state and c not in nxt[state]:
                state = link[state]
                held = length[state]
            to = nxt[state].get(c)
            if to is None:
                state = held = 0
            else:
                state, held = to, held + 1
                if held > most:
                    held = most
                while length[link[state]] >= held and link[state] > 0:
                    state = link[state]
            out.append(held)
            ends.append(first[state] if held else -1)
        return out, ends


def late_windows(stretches: list[list[int]], keys: list[tuple[int, int, int]], length: int) -> list[list[tuple[int, int]]]:
    """For each stretch, the runs (first, end) of its windows that also occur at an earlier (id, hash, place). Stretches are in the order of their keys."""
    flat, starts, signs = [], [], -1
    for own in stretches:
        starts.append(len(flat))
        flat += own
        flat.append(signs)  # occurs once: no match passes it
        signs -= 1
    held, ends = SuffixAutomaton(flat).statistics(flat, length)
    begins = np.array(starts)
    at = np.array(ends, np.int64) - (length - 1)  # where the window that ends here starts first
    here = np.arange(len(flat)) - (length - 1)
    seen = np.flatnonzero((np.array(held, np.int64) == length) & (at < here))  # an occurrence further on is no earlier one
    at, here = at[seen], here[seen]
    ids, hashes, places = (np.array([k[j] for k in keys], np.int64) for j in range(3))
    other, own = np.searchsorted(begins, at, side="right") - 1, np.searchsorted(begins, here, side="right") - 1
    same = (ids[other] == ids[own]) & (hashes[other] == hashes[own])
    late = ~same | (places[other] + at - begins[other] < places[own] + here - begins[own])
    own, at = own[late], (here - begins[own])[late]
    out: list[list[tuple[int, int]]] = [[] for _ in stretches]
    if len(own):
        new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]))
        last = np.concatenate([new[1:], [len(own)]]) - 1
        for k, a, b in zip(own[new].tolist(), at[new].tolist(), at[last].tolist(), strict=True):
            out[k].append((a, b + 1))
    return out


def numbered(group: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words by falling frequency, the numbers of all words, and how many each text has."""
    parts = pc.ascii_split_whitespace(pa.array(group, pa.large_string()))
    per, flat = pc.list_value_length(parts).to_numpy(zero_copy_only=False), parts.flatten()
    filled = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at the ends of a text leaves empty parts
    counts = np.bincount(np.repeat(np.arange(len(group)), per)[filled], minlength=len(group))
    coded = (flat if filled.all() else flat.filter(pa.array(filled))).dictionary_encode()
    words, flat = coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    return [words[i] for i in order.tolist()], rank[flat], counts


def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in chunks of about CHUNK_BYTES: ids, hashes and counts; numbers; distinct words."""
    from pyspark import TaskContext

    part, k = TaskContext.get().partitionId(), 0
    rows: list[tuple[int, int, str]] = []
    size = 0

    def close() -> pa.RecordBatch:
        words, numbers, counts = numbered([t for *_, t in rows])
        head = np.stack([np.array([i for i, *_ in rows], np.int64), np.array([h for _, h, _ in rows], np.int64), counts], 1)
        return row_batch([(0, (part << 20) + k, 0, squeeze(head), squeeze(numbers.astype(np.uint32)), squeeze(pack_words(words)))])

    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("_id", "hash", "text")), strict=True):
            rows.append(row)
            size += len(row[2])
            if size >= CHUNK_BYTES:
                yield close()
                rows, size, k = [], 0, k + 1
                release()
    if rows:
        yield close()
    release()


class Chunk:
    """A chunk's documents, each (id, hash) once, in order; wanted: the words too."""

    def __init__(self, row: dict):
        import xxhash

        self.head = loosen(row["a"], np.int64).reshape(-1, 3)
        self.numbers = loosen(row["b"], np.uint32).astype(np.int64)
        self.words = unpack_words(loosen(row["c"]))
        self.starts = np.cumsum(self.head[:, 2]) - self.head[:, 2]
        self.hash = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))

    def groups(self, length: int, gram: int) -> Iterator[tuple]:
        """Runs of windows with one anchor, a group of words at a time: (numbers, word hashes, first, last, anchor, id, hash, place)."""
        order = np.lexsort((self.head[:, 1], self.head[:, 0]))
        segments, size, before = [], 0, None
        for d in order.tolist():
            i, h, n = self.head[d].tolist()
            if (i, h) == before or n < length:
                continue
            before = i, h
            for low in range(0, n - length + 1, SEGMENT):
                high = min(n, low + SEGMENT + length - 1)
                segments.append((i, h, low, int(self.starts[d]) + low, high - low))
                size += high - low
                if size >= GROUP:
                    yield self.close(segments, length, gram)
                    segments, size = [], 0
        if segments:
            yield self.close(segments, length, gram)

    def close(self, segments: list[tuple], length: int, gram: int) -> tuple:
        numbers = np.concatenate([self.numbers[a : a + n] for *_, a, n in segments])
        ends = np.cumsum([n for *_, n in segments])
        hashes = self.hash[numbers]
        lo, hi, anchor, of = runs(hashes, ends, length, gram)
        table = np.array([(i, h, low) for i, h, low, *_ in segments], np.int64)
        begin = np.concatenate([[0], ends[:-1]])
        return numbers, hashes, lo, hi, anchor, table[of, 0], table[of, 1], table[of, 2] + lo - begin[of]


def by_part(values: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    part = ((values >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    own, first = np.unique(part[order], return_index=True)
    for p, at in zip(own.tolist(), np.split(order, first[1:]), strict=True):
        yield p, at


def anchors_of_chunks(parts: int, length: int, gram: int):
    """Each chunk's distinct anchors for each part, how many different stretches each has, and a hash of the first of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            found = []
            for _, hashes, lo, hi, anchor, *_ in Chunk(row).groups(length, gram):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * hashes, dtype=np.uint64)])  # a sum tells stretches apart well enough to count them
                found.append(np.stack([anchor, (sums[hi + length] - sums[lo]) ^ (hi - lo).astype(np.uint64)], 1))
            if found:
                each, times = np.unique(np.concatenate(found), axis=0, return_counts=True)
                anchor, first, many = np.unique(each[:, 0], return_index=True, return_counts=True)
                again = np.add.reduceat(times, first) > 1
                mark = np.minimum(many, HOT + 1).astype(np.uint16) * 2 + again
                yield row_batch([(1, row["chunk"], p, anchor[at].tobytes(), squeeze(mark[at].astype(np.uint16)), (each[first[at], 1] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()) for p, at in by_part(anchor, parts)])
            del found
            release()

    return run


def repeated_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk, those of its anchors that occur more than once in the corpus, and which have more than HOT stretches."""
    rows = [r for b in batches for r in b.to_pylist()]
    if not rows:
        return
    each = [np.frombuffer(r["a"], np.uint64) for r in rows]
    anchor, at = np.unique(np.concatenate(each), return_inverse=True)
    mark = np.concatenate([loosen(r["b"], np.uint16) for r in rows]).astype(np.int64)
    print_ = np.concatenate([np.frombuffer(r["c"], np.uint32) for r in rows]).astype(np.int64)
    chunks = np.bincount(at, minlength=len(anchor))
    again = (chunks > 1) | (np.bincount(at, weights=mark & 1, minlength=len(anchor)) > 0)
    many = np.bincount(at, weights=(mark >> 1) - 1, minlength=len(anchor)).astype(np.int64)  # beside the first of each chunk
    different = np.unique(at * (1 << 32) + print_) >> 32
    hot = many + np.bincount(different, minlength=len(anchor)) > HOT
    low = 0
    for r, own in zip(rows, each, strict=True):
        here = at[low : low + len(own)]
        low += len(own)
        kept = again[here]
        if kept.any():
            yield row_batch([(1, r["chunk"], r["part"], own[kept].tobytes(), hot[here][kept].astype(np.uint8).tobytes())])


def stretches_of_chunks(parts: int, length: int, gram: int):
    """Each chunk's different stretches with repeated anchors, for each part (kind 1), and what is known to go (kind 3)."""

    def of_chunk(chunk: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        sent = [r for r in rows if r["kind"] == 1]
        if not sent:
            return
        own = Chunk(next(r for r in rows if r["kind"] == 0))
        again, hot = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in sent]), np.concatenate([np.frombuffer(r["b"], np.uint8) for r in sent])
        order = np.argsort(again)
        again, hot = again[order], hot[order]
        first: dict[bytes, tuple[int, int, int, int]] = {}
        gone: list[tuple[int, int, int, int]] = []
        for numbers, hashes, lo, hi, anchor, ids, keys, places in own.groups(length, gram):
            at = np.minimum(np.searchsorted(again, anchor), len(again) - 1)
            repeats = again[at] == anchor
            single = repeats & (hot[at] == 1)
            whole = np.flatnonzero(repeats & ~single)
            dealt = [(lo[whole], hi[whole], anchor[whole], ids[whole], keys[whole], places[whole])]
            if single.any():
                k = np.flatnonzero(single)
                many = hi[k] - lo[k] + 1
                stops = np.cumsum(many)
                inner = np.arange(int(stops[-1])) - np.repeat(stops - many, many)
                begin, k = np.repeat(lo[k], many) + inner, np.repeat(k, many)
                dealt.append((begin, begin, gram_hashes(hashes, length)[begin], ids[k], keys[k], places[k] + inner))
            narrow = numbers.astype(np.uint32)
            for low, high, anchors, i, h, p in dealt:
                for a, b, x, *key in zip(low.tolist(), (high + length).tolist(), anchors.tolist(), i.tolist(), h.tolist(), p.tolist(), strict=True):
                    found = first.setdefault(narrow[a:b].tobytes(), (x, *key))
                    if found[1:] != tuple(key):  # documents come in order, so the first is the earliest
                        gone.append((*key, key[2] + b - a))
        if first:
            stretches = list(first)
            info = np.array([(x - (1 << 64) if x >> 63 else x, *key) for x, *key in first.values()], np.int64)
            lens = np.fromiter((len(s) // 4 for s in stretches), np.int64, len(stretches))
            out = []
            for p, at in by_part(info[:, 0].view(np.uint64), parts):
                flat = np.frombuffer(b"".join(stretches[k] for k in at.tolist()), np.uint32)
                used, local = np.unique(flat, return_inverse=True)
                out.append((1, chunk, p, squeeze(pack_words([own.words[w] for w in used.tolist()])), squeeze(local.astype(np.uint32)), squeeze(info[at]), squeeze(lens[at])))
            yield row_batch(out)
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


def spans_of_shards(length: int):
    """Each chunk's removed spans (id, hash, start, end), found by the automata of a part's shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        out: dict[int, list[np.ndarray]] = {}
        words: dict[bytes, int] = {}
        stretches: list[bytes] = []
        info: list[np.ndarray] = []
        homes: list[int] = []
        for r in rows:
            if r["kind"] == 3:
                out.setdefault(r["chunk"], []).append(loosen(r["a"], np.int64).reshape(-1, 4))
                continue
            own = np.array([words.setdefault(w, len(words)) for w in unpack_words(loosen(r["a"]))], np.uint32)
            raw, stops = own[loosen(r["b"], np.uint32)].tobytes(), np.cumsum(loosen(r["d"], np.int64) * 4).tolist()
            stretches += [raw[x:y] for x, y in zip([0, *stops], stops, strict=False)]
            info.append(loosen(r["c"], np.int64).reshape(-1, 4))
            homes += [r["chunk"]] * len(stops)
        del rows
        if stretches:
            table = np.concatenate(info)
            keys = list(map(tuple, table[:, 1:].tolist()))
            first: dict[bytes, int] = {}
            also: dict[int, list[int]] = {}  # of a kept stretch: chunks in which the same row has it
            whole: dict[int, list[tuple]] = {}
            for k in np.lexsort((table[:, 3], table[:, 2], table[:, 1])).tolist():
                kept = first.setdefault(stretches[k], k)
                if kept == k or keys[kept] == keys[k]:
                    also.setdefault(kept, []).append(homes[k])
                else:
                    i, h, p = keys[k]
                    whole.setdefault(homes[k], []).append((i, h, p, p + len(stretches[k]) // 4))
            for home, gone in whole.items():
                out.setdefault(home, []).append(np.array(gone, np.int64))
            kept = np.array(list(also))
            # windows of one stretch have its anchor at different places, so they differ: an anchor with one stretch left has no more repeats
            _, of, many = np.unique(table[kept, 0], return_inverse=True, return_counts=True)
            kept = kept[many[of] > 1]
            own = kept[np.argsort(table[kept, 0], kind="stable")]
            anchors, size = table[own, 0].tolist(), np.cumsum([len(stretches[k]) // 4 for k in own.tolist()]).tolist()
            low, found = 0, {}
            while low < len(own):  # several anchors to a shard, and no anchor in two
                high = max(low + 1, bisect_right(size, (size[low - 1] if low else 0) + SHARD_WORDS))
                while high < len(own) and anchors[high] == anchors[high - 1]:
                    high += 1
                shard = sorted(own[low:high].tolist(), key=keys.__getitem__)
                for k, late in zip(shard, late_windows([np.frombuffer(stretches[k], np.uint32).tolist() for k in shard], [keys[k] for k in shard], length), strict=True):
                    i, h, p = keys[k]
                    for a, b in late:
                        for home in also[k]:
                            found.setdefault(home, []).append((i, h, p + a, p + b - 1 + length))
                low = high
            for home, gone in found.items():
                out.setdefault(home, []).append(np.array(gone, np.int64))
        for home, found in out.items():
            spans = np.concatenate(found)
            yield row_batch([(1, home, 0, squeeze(spans[np.lexsort(spans.T[::-1])]))])
        del stretches, words, out
        release()

    return run


KEPT = "_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: long, end: long>>, kept string"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def cleaned(keep_text: bool):
    """Per row of a chunk: words, words removed, the digest of the words that are left, the maximal spans, and the words left if asked for."""

    def of_chunk(rows: list[dict]) -> pa.RecordBatch:
        own = Chunk(next(r for r in rows if r["kind"] == 0))
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r in rows:
            if r["kind"] == 1:
                for i, h, a, b in loosen(r["a"], np.int64).reshape(-1, 4).tolist():
                    spans.setdefault((i, h), []).append((a, b))
        out = [[], [], [], [], [], []]
        for (i, h, n), begin in zip(own.head.tolist(), own.starts.tolist(), strict=True):
            merged: list[list[int]] = []
            for a, b in sorted(spans.get((i, h), ())):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            numbers, kept, at = own.numbers[begin : begin + n].tolist(), [], 0
            for a, b in merged:
                kept += numbers[at:a]
                at = b
            kept += numbers[at:]
            rest = b" ".join([own.words[w] for w in kept])
            for column, value in zip(out, (i, n, n - len(kept), hashlib.sha256(rest).hexdigest(), [{"start": a, "end": b} for a, b in merged], rest.decode() if keep_text else None), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), SPAN, pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["_id", "n_words", "n_removed", "kept_sha256", "spans", "kept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, list[dict]] = {}
        for r in (r for b in batches for r in b.to_pylist()):
            chunks.setdefault(r["chunk"], []).append(r)
        while chunks:
            yield of_chunk(chunks.popitem()[1])
            release()

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """Per row of docs: _id, n_words, n_removed, kept_sha256, spans (of words removed, start to end) and kept (the words left, if asked for)."""
    table = cut(texts(docs).withColumn("hash", F.xxhash64("text")).select("_id", "hash", "text").mapInArrow(chunk_rows, ROWS), "chunks", "none")
    parts = max(partitions(docs.sparkSession), table.count())  # a part's work is bounded by a chunk's, whatever the input
    # chunks of one task lie close together in number and are dealt apart
    home = F.pmod(F.shiftright("chunk", 20) + 7919 * F.col("chunk").bitwiseAND((1 << 20) - 1), F.lit(parts)).cast("int")
    to_part = lambda df: df.repartitionById(parts, F.col("part"))
    again = to_part(table.mapInArrow(anchors_of_chunks(parts, length, gram), ROWS)).mapInArrow(repeated_anchors, ROWS)
    stretches = table.unionByName(again).repartitionById(parts, home).mapInArrow(stretches_of_chunks(parts, length, gram), ROWS)
    spans = to_part(stretches).mapInArrow(spans_of_shards(length), ROWS)
    return table.unionByName(spans).repartitionById(parts, home).mapInArrow(cleaned(keep_text), KEPT)


def op12_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir, "doc_id", "text"))
    return out.select(id_out(), "n_words", "n_removed", "kept_sha256")
