"""Alignment of two tokenizers by byte-owner arrays.

np.repeat of token numbers by byte lengths gives, for each byte, the token of A and the token of B that own it. Consecutive distinct pairs of owners are the
overlaps; places where both owners change are cuts, which part a text into groups. Tokens of one group are linked, each of A with each of B.

Both tokenizers start anew at a lone space between two other characters, so a text is aligned piece by piece; a worker aligns each piece once, in strings of
many, and keeps a bounded store. A chunk of documents (about CHUNK_BYTES) is one row: its documents' numbers of pieces, its distinct pieces with what they hold (ids,
groups, linked id pairs), and its documents' results so far. Only its distinct id pairs travel, with the numbers of documents that hold them, dealt by A id,
so a task meets all pairs of an id: it adds up the counts and marks the highest. Counts travel back to the chunk, where they are summed over pieces and
then over documents. So a frequent id is as many numbers as chunks, and never a row an occurrence.

Defined results: null and empty texts, and texts for which the bytes of the tokens of A or B are not a space and the text, have no tokens: zeros and an empty
digest; rows that repeat each have a row and count as documents of their own; null doc_ids are kept; texts of any length are taken whole; an
empty table gives no rows; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, id_out, partitions, release, texts
from .dictionary import loosen, squeeze
from .pieces import cut_at_spaces
from .suffix_dedup import ROWS, row_batch

CHUNK_BYTES = 8_000_000
#: Pieces aligned in one string.
STRING = 1024
#: Pieces that a worker holds.
MOST = 200_000
#: Links of a group that are written out one by one.
MANY = 256
#: Letters below this are Latin, and of one kind in all versions of Unicode.
LATIN = "\u0250"


def owners(lens: np.ndarray) -> np.ndarray:
    """For each byte, the number of the token that owns it."""
    return np.repeat(np.arange(len(lens)), lens)


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(token of A, token of B) of consecutive distinct pairs of owners."""
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    return np.stack([a[new], b[new]], 1)


def cuts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes at which both owners change."""
    return np.flatnonzero((a[1:] != a[:-1]) & (b[1:] != b[:-1])) + 1


class Pair:
    """Two tokenizers with their tokens' bytes.

    Pieces of which all but the first are Latin letters, digits and signs go to A's merges by rank (an id is its rank), which is several times as fast as
    the tokenizer of the file and gives the same ids; all others go to that.
    """

    def __init__(self, byte_level: str, pieces: str, pattern: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as themselves; the others follow from 256 on
        of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        added = set(self.a.get_added_tokens_decoder())
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [n.encode() if i in added else bytes(of[c] for c in n) for i, n in enumerate(names)]
        self.ranks = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={x: i for i, x in enumerate(self.a_bytes) if i not in added}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.a_width = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_width = np.array(list(map(len, self.b_bytes)), np.int64)
        # a token and what follows it in a group: another token of its side, or the end of its side
        self.said = [f"{i}{x}" for i in range(len(self.a_bytes)) for x in ",|"] + [f"{i}{x}" for i in range(len(self.b_bytes)) for x in ",;"]

    def encode(self, text: str, by_rank: bool = False) -> tuple[list[int], list[int], bool]:
        """Ids of a text that starts with a space by A, of the rest by B (which adds the space), and whether both give the text's bytes."""
        a = self.ranks.encode_ordinary(text) if by_rank else self.a.encode(text, add_special_tokens=False).ids
        b, raw = self.b.encode(text[1:]), text.encode()
        return a, b, b"".join([self.a_bytes[i] for i in a]) == raw and b"".join([self.b_bytes[i] for i in b]) == raw


class Aligned:
    """What distinct pieces hold, in the order of their numbers: groups as text, sizes, and linked id pairs with how often each is linked."""

    def __init__(self):
        self.names: list[str] = []
        self.tables: list[np.ndarray] = [np.zeros((0, 6), np.int64)]  # a row a piece: tokens of A, of B, groups, links, pairs stored, whether the bytes are right
        self.keys: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.times: list[np.ndarray] = [np.zeros(0, np.int64)]

    def add(self, names: list[str], table: np.ndarray, keys: np.ndarray, times: np.ndarray) -> None:
        self.names += names
        self.tables.append(table)
        self.keys.append(keys)
        self.times.append(times)

    def whole(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        for own in (self.tables, self.keys, self.times):
            if len(own) > 1:
                own[:] = [np.concatenate(own)]
        return self.tables[0], self.keys[0], self.times[0]


def linked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct id pairs of one group and how often each is linked: by distinct ids, so a group of any size has no more pairs than its ids."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    return (x[:, None] << 32 | y).ravel(), (n[:, None] * m).ravel()


def align(pair: Pair, pieces: list[str], out: Aligned, by_rank: bool = False) -> None:
    """Aligns pieces, all starting with a space, as one string; where the bytes differ, half by half."""
    ids, other, right = pair.encode("".join(pieces), by_rank)
    if not right:
        if len(pieces) == 1:
            out.add([""], np.zeros((1, 6), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            return
        half = len(pieces) // 2
        align(pair, pieces[:half], out, by_rank)
        align(pair, pieces[half:], out, by_rank)
        return
    a, b = np.array(ids, np.int64), np.array(other, np.int64)
    wide_a, wide_b = pair.a_width[a], pair.b_width[b]
    ends = np.concatenate([cuts(owners(wide_a), owners(wide_b)), [int(wide_a.sum())]])
    stops = np.cumsum([len(p.encode()) for p in pieces])
    upto = np.searchsorted(ends, stops) + 1  # groups up to each piece's end
    if len(pieces) > 1 and not (ends[np.minimum(upto - 1, len(ends) - 1)] == stops).all():  # a piece's end is no cut: each on its own
        for p in pieces:
            align(pair, [p], out, by_rank)
        return
    stop_a, stop_b = np.searchsorted(np.cumsum(wide_a), ends) + 1, np.searchsorted(np.cumsum(wide_b), ends) + 1
    n_a, n_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
    # the groups as text: each group's tokens of A, then of B, each with the sign behind it
    group_a, group_b = np.repeat(np.arange(len(ends)), n_a), np.repeat(np.arange(len(ends)), n_b)
    code = np.empty(len(a) + len(b), np.int64)
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[stop_a - 1] = last_b[stop_b - 1] = 1
    code[np.arange(len(a)) + (stop_b - n_b)[group_a]] = 2 * a + last_a
    code[np.arange(len(b)) + stop_a[group_b]] = 2 * (len(pair.a_bytes) + b) + last_b
    said = list(map(pair.said.__getitem__, code.tolist()))
    bounds = [0, *(stop_a + stop_b)[upto - 1].tolist()]
    names = ["".join(said[x:y])[:-1] for x, y in zip(bounds, bounds[1:], strict=False)]
    # all pairs of a group; a group of many goes by distinct ids
    links = n_a * n_b
    few = np.where(links <= MANY, links, 0)
    base, total = np.cumsum(few) - few, int(few.sum())
    of = np.repeat(np.arange(len(ends)), few)
    inner = np.arange(total) - base[of]
    keys = a[(stop_a - n_a)[of] + inner // n_b[of]] << 32 | b[(stop_b - n_b)[of] + inner % n_b[of]]
    times, stored = np.ones(total, np.int64), few.copy()
    large = np.flatnonzero(links > MANY)
    if len(large):
        found = [linked(a[stop_a[g] - n_a[g] : stop_a[g]], b[stop_b[g] - n_b[g] : stop_b[g]]) for g in large.tolist()]
        stored[large] = [len(k) for k, _ in found]
        where = np.repeat(base[large], stored[large])
        keys, times = np.insert(keys, where, np.concatenate([k for k, _ in found])), np.insert(times, where, np.concatenate([t for _, t in found]))
    sums = [np.diff(np.concatenate([[0], x])[np.concatenate([[0], upto])]) for x in (np.cumsum(n_a), np.cumsum(n_b), np.arange(1, len(ends) + 1), np.cumsum(links), np.cumsum(stored))]
    out.add(names, np.stack([*sums, np.ones(len(pieces), np.int64)], 1), keys, times)


_workers: dict[tuple[str, str, str], Store] = {}


def pieces_of(text: str | None) -> list[str]:
    """A space and the text, cut before lone spaces; each piece starts with a space."""
    parts = cut_at_spaces(text or "")
    if parts:
        parts[0] = " " + parts[0]
    return parts


class Store:
    """A worker's pieces: number -> what it holds. Emptied between chunks when MOST are held, so memory is bounded."""

    def __init__(self, byte_level: str, pieces: str, pattern: str):
        self.pair = Pair(byte_level, pieces, pattern)
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.held = Aligned()

    def numbers(self, pieces: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.code.get, pieces, repeat(-1)), np.int64, len(pieces))
        unknown = np.flatnonzero(out < 0).tolist()
        if not unknown:
            return out
        ranked, joined, single = [], [], []
        for p in dict.fromkeys([pieces[i] for i in unknown]):
            if len(p) < 2 or p[1].isspace() or p[-1].isspace():
                single.append(p)
            elif len(p.split()) == 1 and (p.isascii() or max(p) < LATIN):
                ranked.append(p)
            else:
                joined.append(p)
        for group, by_rank in (*(([p], False) for p in single), *((own[i : i + STRING], by) for own, by in ((ranked, True), (joined, False)) for i in range(0, len(own), STRING))):
            align(self.pair, group, self.held, by_rank)
            self.code.update(zip(group, range(len(self.code), len(self.code) + len(group)), strict=True))
        out[unknown] = [self.code[pieces[i]] for i in unknown]
        return out


def store_of(byte_level: str, pieces: str, pattern: str) -> Store:
    key = byte_level, pieces, pattern
    if key not in _workers:
        _workers[key] = Store(*key)
    return _workers[key]


def chunk_rows(byte_level: str, pieces: str, pattern: str):
    """Chunks (kind 0): ids and results so far; pieces of each document; links of each piece; distinct id pairs and the documents that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        store = store_of(byte_level, pieces, pattern)
        ids: list[int] = []
        flats: list[np.ndarray] = []
        counts: list[int] = []
        digests: list[str] = []

        def take(group_ids: list[int], group: list[str]) -> None:
            per = [pieces_of(t) for t in group]
            lens = np.fromiter(map(len, per), np.int64, len(per))
            flat = store.numbers(list(chain.from_iterable(per)))
            del per
            wrong = np.concatenate([[0], np.cumsum(store.held.whole()[0][flat, 5] == 0)])
            stops = np.cumsum(lens)
            right = wrong[stops] == wrong[stops - lens]
            names, low, every = store.held.names, 0, flat.tolist()
            for n, good in zip(lens.tolist(), right.tolist(), strict=True):
                digests.append(hashlib.sha256(";".join(map(names.__getitem__, every[low : low + n])).encode()).hexdigest() if good and n else "")
                low += n
            flats.append(flat[np.repeat(right, lens)])
            counts.extend(np.where(right, lens, 0).tolist())
            ids.extend(group_ids)

        def close() -> pa.RecordBatch:
            flat, per = np.concatenate(flats), np.array(counts, np.int64)
            used, numbers = np.unique(flat, return_inverse=True)
            order = np.argsort(-np.bincount(numbers, minlength=len(used)), kind="stable")  # frequent pieces get small numbers, which pack well
            rank = np.empty(len(used), np.int64)
            rank[order] = np.arange(len(used))
            own = used[order]
            numbers = rank[numbers]
            sizes, all_keys, all_times = store.held.whole()
            table, lens = sizes[own, :4], sizes[own, 4]
            starts, ends = np.cumsum(sizes[:, 4]) - sizes[:, 4], np.cumsum(lens)
            at = np.repeat(starts[own] - (ends - lens), lens) + np.arange(int(lens.sum()))
            keys, times = all_keys[at], all_times[at]
            distinct, place = np.unique(keys, return_inverse=True)
            owner = np.repeat(np.arange(len(per)), per)
            each = np.unique(owner * max(1, len(own)) + numbers)  # the distinct pieces of each document
            doc, piece = each // max(1, len(own)), each % max(1, len(own))
            starts = np.cumsum(lens) - lens
            holds, step = np.zeros(len(distinct), np.int64), 1 << 17
            low = 0
            while low < len(each):  # whole documents at a time
                high = min(len(each), low + step)
                while high < len(each) and doc[high] == doc[high - 1]:
                    high += 1
                n = lens[piece[low:high]]
                ends = np.cumsum(n)
                at = place[np.repeat(starts[piece[low:high]] - (ends - n), n) + np.arange(int(ends[-1]))]
                holds += np.bincount(np.unique(np.repeat(doc[low:high], n) * max(1, len(distinct)) + at) % max(1, len(distinct)), minlength=len(distinct))
                low = high
            totals = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(table[numbers], axis=0)])
            stops = np.cumsum(per)
            done = totals[stops] - totals[stops - per]
            head = squeeze(np.concatenate([np.array(ids, np.int64)[:, None], done, per[:, None]], axis=1))
            links = squeeze(np.concatenate([lens, place, times]).astype(np.uint32)), squeeze(np.stack([distinct, holds]))
            shas = b"".join(bytes.fromhex(x) if x else bytes(32) for x in digests)
            return row_batch([(0, (part << 20) + k, len(lens), head + shas, squeeze(numbers.astype(np.uint32)), *links)])

        def grouped() -> Iterator[tuple[list[int], list[str], bool]]:
            own, group, small, whole = [], [], 0, 0
            for b in batches:
                for i, t in zip(b.column("_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    own.append(i)
                    group.append(t)
                    small += len(t)
                    if small >= CHUNK_BYTES // 8:
                        whole += small
                        yield own, group, whole >= CHUNK_BYTES
                        own, group, small, whole = [], [], 0, 0 if whole >= CHUNK_BYTES else whole
            if own:
                yield own, group, False

        for own, group, full in grouped():
            take(own, group)
            if full:
                yield close()
                k += 1
                for x in (ids, flats, counts, digests):
                    x.clear()
                if len(store.code) > MOST:
                    store.clear()
                release()
        if ids:
            yield close()
        store.clear()  # workers live on through the stages that follow
        for x in (ids, flats, counts, digests):
            x.clear()
        release()

    return run


def dealt_pairs(parts: int):
    """A chunk's distinct id pairs for each part, by A id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            keys, holds = loosen(row["d"], np.int64).reshape(2, -1)
            part = (keys >> 32) * 2654435761 % (1 << 32) % parts
            order = np.argsort(part, kind="stable")
            own, first = np.unique(part[order], return_index=True)
            yield row_batch([(1, row["chunk"], p, squeeze(keys[at]), squeeze(holds[at])) for p, at in zip(own.tolist(), np.split(order, first[1:]), strict=True)] if len(own) else [])

    return run


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk, its pairs' counts of documents in the corpus, and which are the highest of their A id."""
    rows = [r for b in batches for r in b.to_pylist()]
    if not rows:
        return
    each = [loosen(r["a"], np.int64) for r in rows]
    keys, at = np.unique(np.concatenate(each), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, np.concatenate([loosen(r["b"], np.int64) for r in rows]))
    a = keys >> 32
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    best = total == np.repeat(np.maximum.reduceat(total, first), np.diff(np.concatenate([first, [len(a)]])))
    low = 0
    for r, own in zip(rows, each, strict=True):
        here = at[low : low + len(own)]
        low += len(own)
        yield row_batch([(1, r["chunk"], r["part"], squeeze(own), squeeze(total[here]), squeeze(best[here].astype(np.uint8)))])
    release()


DIGESTS = "_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts summed over a chunk's pieces and then over its documents."""
    chunks: dict[int, list[dict]] = {}
    for r in (r for b in batches for r in b.to_pylist()):
        chunks.setdefault(r["chunk"], []).append(r)
    while chunks:
        _, rows = chunks.popitem()
        row = next(r for r in rows if r["kind"] == 0)
        sent = [r for r in rows if r["kind"] == 1]
        keys, _ = loosen(row["d"], np.int64).reshape(2, -1)
        found = [np.concatenate([loosen(r[k], t) for r in sent] or [np.zeros(0, np.int64)]).astype(np.int64) for k, t in (("a", np.int64), ("b", np.int64), ("c", np.uint8))]
        at = np.searchsorted(keys, found[0])
        values = np.zeros((len(keys), 2), np.int64)
        values[at, 0], values[at, 1] = found[2], found[1]
        links, pieces = loosen(row["c"], np.uint32).astype(np.int64), row["part"]
        lens = links[:pieces]
        place, times = links[pieces:].reshape(2, -1)
        sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(values[place] * times[:, None], axis=0)])
        stops = np.cumsum(lens)
        by_piece = sums[stops] - sums[stops - lens]
        numbers = loosen(row["b"], np.uint32).astype(np.int64)
        import zstandard

        reader = zstandard.ZstdDecompressor().decompressobj()
        raw = reader.decompress(row["a"])
        head = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.int64).reshape(-1, 6)
        shas = reader.unused_data
        per = head[:, 5]
        totals = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(by_piece[numbers], axis=0)])
        ends = np.cumsum(per)
        last = totals[ends] - totals[ends - per]
        digests = [shas[32 * k : 32 * k + 32].hex() if n else "" for k, n in enumerate(per.tolist())]
        cols = [head[:, 0], head[:, 1], head[:, 2], head[:, 3], head[:, 4], last[:, 0], last[:, 1]]
        yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in cols), pa.array(digests, pa.string())], names=[x.split()[0] for x in DIGESTS.split(", ")])
        release()


def token_links(docs: DataFrame, byte_level: str, pieces: str, pattern: str) -> DataFrame:
    """Per document: _id, tokens of A and B, groups, links, links whose id pair is the most frequent of its A id, the sum of the links' counts, and the groups' digest."""
    table = cut(texts(docs).mapInArrow(chunk_rows(byte_level, pieces, pattern), ROWS), "chunks", "none")
    parts = max(partitions(docs.sparkSession), table.count())  # a part's pairs are bounded by a chunk's, whatever the input
    home = F.pmod(F.shiftright("chunk", 20) + 7919 * F.col("chunk").bitwiseAND((1 << 20) - 1), F.lit(parts)).cast("int")
    counts = table.select("chunk", "d").mapInArrow(dealt_pairs(parts), ROWS).repartitionById(parts, F.col("part")).mapInArrow(counted, ROWS)
    return table.unionByName(counts).repartitionById(parts, home).mapInArrow(finished, DIGESTS)


def aligned(docs: DataFrame, byte_level: str, pieces: str, pattern: str) -> DataFrame:
    """Per document: _id, ids of both tokenizers, the bytes at which both have an end, and the overlaps as pairs of token places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = store_of(byte_level, pieces, pattern).pair
        for batch in batches:
            out = [[], [], [], []]
            for text in batch.column("text").to_pylist():
                a, b, right = pair.encode(" " + text) if text else ([], [], False)
                if not right:
                    a, b = [], []
                own, other = owners(pair.a_width[a]) if a else np.zeros(0, np.int64), owners(pair.b_width[b]) if b else np.zeros(0, np.int64)
                both = overlaps(own, other)
                for column, value in zip(out, (a, b, [*cuts(own, other).tolist(), len(own)] if a else [], [{"a": x, "b": y} for x, y in both.tolist()]), strict=True):
                    column.append(value)
            kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=["_id", "a", "b", "cuts", "overlaps"])

    return texts(docs).mapInArrow(run, "_id long, a array<long>, b array<long>, cuts array<long>, overlaps array<struct<a: long, b: long>>")


def op13_byte_owner_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    out = token_links(documents(spark, sf_dir, "doc_id", "text"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN)
    return out.select(id_out(), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
