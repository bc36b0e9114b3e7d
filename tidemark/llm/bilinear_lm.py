"""Scoring texts with a log-bilinear language model.

Counts of all training words are summed over the whole corpus (see dictionary.py). The VECTORS * sqrt(training tokens) commonest words
have vectors of their own, so the vocabulary follows the corpus; every other word, seen or not, shares the vector of its ending (one of ENDINGS
classes of the last three bytes) and has the class's probability times its share of the class's smoothed counts.

The next token is predicted from the ORDER tokens before it. A context's vector is the sum of their vectors, each turned by the matrix of its
position; a target's score is the product with the target's vector plus a bias. Targets stand in groups, by rank: one of probability p stands with
about WIDTH / sqrt(p) others, which makes the alternatives of a token fewest. P(target) = P(group) * P(target in its group), each normalised over all
its alternatives by matrix products over batches of contexts, so all words and one unknown word for each ending sum to 1 in every context.

Noise-contrastive estimation in numpy: every training token of the corpus is read once, in ROUNDS turns. Documents are dealt to shards and turns by a
hash of id and words. In a turn, a task for each shard starts from the shared parameters, goes through batches of BATCH tokens against NOISE samples
drawn from the unigram distribution (of groups, and of each group's targets) with AdaGrad, and reports what it changed; changes are averaged row by
row, weighted by the squared gradients behind them, block by block in tasks of their own, in the order of the shards. The number of shards follows
the training tokens and the parameters alone, and a shard's documents are put in order of their hashes, so cores and partitions do not matter.

Bounds (parameters): words that occur LEAST_COUNT times or more in training, and MOST of them at most (reached at 7.6 billion training tokens), have
vectors of their own, so the parameters, the one thing sent to all tasks, stay below 80 MB. All other words share vectors by ending.

Defined results: null and empty texts are one end token; without training texts the model is the base model, whose
probabilities are then 1; repeated rows count each; ties of words in count are broken by their bytes; very long texts are scored whole, in batches;
null ids are held by crc32('') like any other; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, cut, documents, drop_cut, id_out, keep_heap, one_thread, release, texts
from .dictionary import by_bucket, chunked, loosen, read_chunks, squeeze, unpack_words, with_values

VECTORS = 3
MOST = 1 << 18
LEAST_COUNT = 4
ENDINGS = 2048
ORDER = 4
DIMENSIONS = 32
ROUNDS = 2
BATCH = 8192
NOISE = 64
RATIO = 10.0
RATE = 0.1
#: Alternatives of a token within its group, against those among groups.
WIDTH = 2.0
#: Contexts scored at once.
SCORE_BATCH = 32768
#: Parameter rows averaged by one task; fewer where there are over 64 shards.
BLOCK = 4096
#: A shard has SHARD_TOKENS tokens, or SHARD_ROWS for each row of parameters if that is more: reports stay a small part of the work.
SHARD_TOKENS = 1 << 22
SHARD_ROWS = 64
#: The end of a text; no word is empty.
END = b""


def held_out(ids: list[int]) -> np.ndarray:
    return np.fromiter((zlib.crc32(b"" if i == NO_ID else str(i).encode()) % 7 == 2 for i in ids), bool, len(ids))


def words_of(text: str) -> list[bytes]:
    return [*text.encode().lower().split(), END]


def new_coder():
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__  # a new word's number

    def code(group: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [words_of(t) for t in group]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(map(numbers.__getitem__, chain.from_iterable(found)), np.int64, int(counts.sum())), counts

    return code, lambda: list(numbers)


def endings(words: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w[-3:]) for w in words), np.int64, len(words)) % ENDINGS


def corpus_counts(table: DataFrame) -> tuple[int, int, list[tuple[bytes, int]], np.ndarray, np.ndarray]:
    """(N, V, words with vectors of their own and their counts, each ending's tokens, and its distinct words) over all training texts.

    Endings are counted without the words that have vectors of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        for b in batches:
            for head, tail in zip(b.column("head").to_pylist(), b.column("tail").to_pylist(), strict=True):
                for w, n in zip(unpack_words(loosen(head)), loosen(tail, np.int64).tolist(), strict=True):
                    if n:
                        total[w] = total.get(w, 0) + n
        words, counts = list(total), np.fromiter(total.values(), np.int64, len(total))
        ending = endings(words)
        own = [w for w, n in total.items() if n >= LEAST_COUNT]
        tokens, kinds = np.bincount(ending, weights=counts, minlength=ENDINGS).astype(np.int64), np.bincount(ending, minlength=ENDINGS)
        yield pa.RecordBatch.from_pydict({
            "word": pa.array([None, *own], pa.binary()), "n": pa.array([int(counts.sum()), *[total[w] for w in own]], pa.int64()),
            "tokens": pa.array([squeeze(tokens), *repeat(None, len(own))], pa.binary()), "kinds": pa.array([squeeze(kinds), *repeat(None, len(own))], pa.binary()),
        })

    found = cut(by_bucket(table).select("head", "tail").mapInArrow(run, "word binary, n long, tokens binary, kinds binary"), "counts")
    tokens, kinds, n = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64), 0
    for r in found.where("word is null").select("n", "tokens", "kinds").toLocalIterator():  # a row a bucket
        n, tokens, kinds = n + r.n, tokens + loosen(bytes(r.tokens), np.int64), kinds + loosen(bytes(r.kinds), np.int64)
    v = int(kinds.sum())
    top = [(bytes(r.word), r.n) for r in found.where("word is not null").orderBy(F.desc("n"), "word").limit(min(MOST, int(VECTORS * np.sqrt(n)))).select("word", "n").collect()]
    ending = endings([w for w, _ in top])
    np.subtract.at(tokens, ending, [c for _, c in top])
    np.subtract.at(kinds, ending, 1)
    drop_cut(found)
    return n, v, top, tokens, kinds


def contexts_of(cells: np.ndarray, starts: np.ndarray, before: int, order: int = ORDER) -> np.ndarray:
    """(order, tokens): the cells 1, 2, ... tokens before each; `before` stands in front of each text."""
    n = len(cells)
    into = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    out = np.full((order, n), before, np.int64)
    for k in range(order):
        at = np.flatnonzero(into > k)
        out[k, at] = cells[at - k - 1]
    return out


def segment_sums(rows: np.ndarray, by: np.ndarray | None, first: np.ndarray) -> np.ndarray:
    """Sums of the stretches of rows (in the order `by`) that begin at `first`. Most have one row or a few, which are added stretch beside stretch."""
    lens = np.diff(np.append(first, len(rows)))
    at = (lambda x: x) if by is None else by.__getitem__
    out, k, left = np.take(rows, at(first), axis=0), 1, np.flatnonzero(lens > 1)
    while len(left) and k < 6:
        out[left] += np.take(rows, at(first[left] + k), axis=0)
        k += 1
        left = left[lens[left] > k]
    if len(left):
        more = lens[left] - k
        ends = np.cumsum(more)
        rest = np.repeat(first[left] + k - (ends - more), more) + np.arange(int(ends[-1]))
        out[left] += np.add.reduceat(np.take(rows, at(rest), axis=0), ends - more)
    return out


class LogBilinear:
    """Vectors of cells (words, then endings) as contexts and, by group, as targets.

    All parameters are the rows of one table: contexts (the last is the start), targets in the order of their groups, groups, and the
    matrices of the positions; the last column holds the biases of targets and groups.
    """

    def __init__(self, counts: np.ndarray, dimensions: int = DIMENSIONS, order: int = ORDER):
        n, rng = len(counts), np.random.default_rng(11)
        self.n, self.d, self.order = n, dimensions, order
        share = (counts + 1.0) / (counts + 1.0).sum()
        ranked = np.argsort(-counts, kind="stable")
        width = np.sqrt(share[ranked]) / WIDTH
        self.group = np.empty(n, np.int64)
        self.group[ranked] = np.cumsum(width) - width
        self.groups = int(self.group[ranked[-1]]) + 1
        place = np.argsort(self.group, kind="stable")
        self.edges = np.searchsorted(self.group[place], np.arange(self.groups + 1))
        self.inner = np.empty(n, np.int64)
        self.inner[place] = np.arange(n) - self.edges[self.group[place]]
        self.row = np.empty(n, np.int64)
        self.row[place] = np.arange(n)
        self.noise_groups = np.bincount(self.group, weights=share, minlength=self.groups)
        self.noise_targets = (share / self.noise_groups[self.group])[place]
        self.group_of_row = self.group[place]
        reach = np.cumsum(self.noise_targets)
        before = np.append(0, reach)[self.edges]
        inside = (reach - before[self.group_of_row]) / np.diff(before)[self.group_of_row]
        self.reach_groups, self.reach_targets = np.cumsum(self.noise_groups), self.group_of_row + np.minimum(inside, 1.0)
        self.kind = np.uint16 if n < 1 << 16 else np.int64  # short numbers are sorted by radix
        self.log_groups, self.log_targets = np.log(self.noise_groups).astype(np.float32), np.log(self.noise_targets).astype(np.float32)
        self.table = np.zeros((2 * n + 1 + self.groups + order * dimensions, dimensions + 1), np.float32)
        self.table[: n + 1, :dimensions] = rng.normal(0, 0.1, (n + 1, dimensions))
        self.table[n + 1 : 2 * n + 1, dimensions] = self.log_targets
        self.table[2 * n + 1 : 2 * n + 1 + self.groups, dimensions] = self.log_groups
        self.table[2 * n + 1 + self.groups :, :dimensions] = np.concatenate([np.eye(dimensions) * 0.8**k for k in range(order)])
        self.squares = np.full(len(self.table), 1e-6, np.float32)

    def parts(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Views of contexts, targets, groups and position matrices."""
        a, b, c = self.n + 1, 2 * self.n + 1, 2 * self.n + 1 + self.groups
        return table[:a], table[a:b], table[b:c], table[c:].reshape(self.order, self.d, *table.shape[1:])

    def distinct(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context rows that occur, and for each position and token its place among them."""
        mark = np.zeros(self.n + 1, bool)
        mark[contexts.ravel()] = True
        rows, place = np.flatnonzero(mark), np.cumsum(mark) - 1
        return rows, place.astype(np.uint16 if len(rows) < 1 << 16 else np.int64)[contexts]

    def vectors(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Context vectors with a last column of 1, for the biases."""
        seen, _, _, turn = self.parts(self.table)
        base = seen[rows, : self.d]
        out = np.ones((at.shape[1], self.d + 1), np.float32)
        total = np.take(base @ turn[0, :, : self.d], at[0], axis=0)
        for k in range(1, self.order):
            total += np.take(base @ turn[k, :, : self.d], at[k], axis=0)
        out[:, : self.d] = total
        return out

    def by_group(self, cells: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Order of the tokens by group and place in it, and (group, first, end) of the groups that occur."""
        order = np.argsort(self.row[cells].astype(self.kind), kind="stable")
        edges = np.append(0, np.cumsum(np.bincount(self.group[cells], minlength=self.groups))).tolist()
        return order, [(g, a, b) for g, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]

    @np.errstate(over="ignore")
    def step(self, cells: np.ndarray, contexts: np.ndarray, rng: np.random.Generator) -> None:
        """One batch: the data against sampled noise, for the groups and within each. Only rows of the batch and of the noise are touched."""
        seen, targets, groups, turn = self.parts(self.table)
        seen2, targets2, groups2, turn2 = self.parts(self.squares)
        odds = np.float32(np.log(RATIO))

        def from_data(q, log_noise, own):
            """(gradient of the context vectors, first token of each row of q, the rows' gradients) of the data's losses; own ascends."""
            mine = np.take(q, own, axis=0)
            data = np.einsum("ij,ij->i", r, mine)
            data -= log_noise[own] + odds
            data *= 0.5
            np.tanh(data, out=data)
            data -= 1
            data *= 0.5
            mine *= data[:, None]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            return mine, first, segment_sums(data[:, None] * r, None, first)

        def weights(q, log_noise, times):
            """What gives the negative logits (the contexts' last column is 1), each row's weight, and the rows times it."""
            negative = -q
            negative[:, self.d] += log_noise + odds
            weight = (times * (RATIO / NOISE)).astype(np.float32)[:, None]
            return negative, weight, q * weight

        def from_noise(r, negative, weight, weighted):
            """(what the noise adds to the gradient of the context vectors, gradients of its rows)."""
            false = r @ negative.T
            np.exp(false, out=false)  # beyond float32 the probability is 0
            false += 1
            np.reciprocal(false, out=false)
            rows = false.T @ r
            rows *= weight
            return false @ weighted, rows

        def descend(rows, squares, at, gradient):
            total = squares[at] + np.einsum("ij,ij->i", gradient, gradient) / np.float32(gradient.shape[1])
            squares[at] = total
            gradient *= (np.float32(RATE) / np.sqrt(total))[:, None]
            rows[at] = np.take(rows, at, axis=0) - gradient

        def union(n, own, sums, on, noise):
            mark = np.zeros(n, bool)
            mark[own] = mark[on] = True
            rows, place = np.flatnonzero(mark), np.cumsum(mark) - 1
            out = np.zeros((len(rows), self.d + 1), np.float32)
            out[place[on]] = noise
            out[place[own]] += sums
            return rows, out

        order, stretches = self.by_group(cells)
        row, contexts = self.row[cells[order]], np.take(contexts, order, axis=1)
        group = self.group_of_row[row]
        rows, at = self.distinct(contexts)
        r = self.vectors(rows, at)
        # the groups
        dr, first, sums = from_data(groups, self.log_groups, group)
        times = np.bincount(np.minimum(np.searchsorted(self.reach_groups, rng.random(NOISE) * self.reach_groups[-1], side="right"), self.groups - 1), minlength=self.groups)
        on = np.flatnonzero(times)
        back, noise = from_noise(r, *weights(groups[on], self.log_groups[on], times[on]))
        dr += back
        on, dg = union(self.groups, group[first], sums, on, noise)
        # the targets of each group that has more than one
        back, first, sums = from_data(targets, self.log_targets, row)
        many = np.diff(self.edges) > 1
        if not many.all():
            back[~many[group]] = 0
            sums[~many[group[first]]] = 0
        dr += back
        which = [k for k, (g, _, _) in enumerate(stretches) if many[g]]
        drawn = np.array([stretches[k][0] for k in which], np.int64)[:, None]
        drawn = np.minimum(np.searchsorted(self.reach_targets, drawn + rng.random((len(which), NOISE)), side="right"), self.edges[drawn + 1] - 1)
        times = np.bincount(drawn.ravel(), minlength=self.n)
        sampled = np.flatnonzero(times)
        negative, weight, weighted = weights(np.take(targets, sampled, axis=0), self.log_targets[sampled], times[sampled])
        noise = np.empty((len(sampled), self.d + 1), np.float32)
        for k in which:
            g, a, b = stretches[k]
            part = slice(*np.searchsorted(sampled, self.edges[g : g + 2]).tolist())
            back, noise[part] = from_noise(r[a:b], negative[part], weight[part], weighted[part])
            dr[a:b] += back
        touched, dq = union(self.n, row[first], sums, sampled, noise)
        # the contexts and the matrices of their positions
        dr = np.ascontiguousarray(dr[:, : self.d])
        base, to_seen = seen[rows, : self.d], np.zeros((len(rows), self.d + 1), np.float32)
        for k in range(self.order):
            by = np.argsort(at[k], kind="stable")
            own = at[k][by].astype(np.int64)
            first = np.flatnonzero(np.diff(own, prepend=-1))
            own, sums = own[first], segment_sums(dr, by, first)
            to_turn = np.take(base, own, axis=0).T @ sums
            to_seen[own, : self.d] += sums @ turn[k, :, : self.d].T
            turn2[k] += (to_turn * to_turn).mean(1)
            turn[k, :, : self.d] -= 0.1 * RATE * to_turn / np.sqrt(turn2[k])[:, None]
        descend(seen, seen2, rows, to_seen)
        descend(targets, targets2, touched, dq)
        descend(groups, groups2, on, dg)

    def logs(self, cells: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Normalised natural log-probabilities of the cells in their contexts."""
        _, targets, groups, _ = self.parts(self.table)
        out = np.empty(len(cells))

        def normalised(r, q, own):
            s = r @ q.T
            mine = s[np.arange(len(own)), own]
            with np.errstate(over="ignore"):
                total = np.exp(s, out=s) @ np.ones(s.shape[1], np.float32)  # faster than sums of short rows
            if np.isfinite(total).all() and total.all():
                return mine - np.log(total)
            s = r @ q.T
            top = s.max(1, keepdims=True)
            return mine - top[:, 0] - np.log(np.exp(s - top).sum(1))

        for low in range(0, len(cells), SCORE_BATCH):
            own = cells[low : low + SCORE_BATCH]
            order, stretches = self.by_group(own)
            own = own[order]
            r, inner, group = self.vectors(*self.distinct(contexts[:, low : low + SCORE_BATCH][:, order])), self.inner[own], self.group[own]
            found = np.empty(len(own))
            for a in range(0, len(own), 2048):  # small enough for a core's cache
                found[a : a + 2048] = normalised(r[a : a + 2048], groups, group[a : a + 2048])
            for g, a, b in stretches:
                part = targets[self.edges[g] : self.edges[g + 1]]
                step = max(64, (1 << 18) // len(part))
                for c in range(a, b, step) if len(part) > 1 else ():
                    d = min(b, c + step)
                    found[c:d] += normalised(r[c:d], part, inner[c:d])
            out[low + order] = found
        return out


STREAMS = "ids binary, counts binary, known binary, base binary, extra binary, cells binary"


def streams(table: DataFrame, valued: DataFrame, n: int, v: int, rest: int, mass: np.ndarray) -> DataFrame:
    """A row for each chunk: its documents' base scores and their tokens as cells; extra is what words add to their endings' probabilities."""

    def finish(ids: np.ndarray, counts: np.ndarray, numbers: np.ndarray, lens: np.ndarray, flat: np.ndarray) -> Iterator[pa.RecordBatch]:
        c, cell = flat[0::2], flat[1::2]
        starts = np.cumsum(counts) - counts
        plain = np.log10((c + 1.0) / (n + v + 1.0))
        share = np.where(cell >= rest, np.log10((c + 1.0) / mass[np.maximum(cell - rest, 0)]), 0.0)
        sums = [np.add.reduceat(x[numbers], starts) for x in ((c > 0).astype(np.int64), plain, share)]
        row = [squeeze(x) for x in (ids, counts.astype(np.uint32), *sums, cell.astype(np.uint32)[numbers])]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=["ids", "counts", "known", "base", "extra", "cells"])

    return cut(read_chunks(table, valued, finish, STREAMS), "streams")


def unpacked(row: dict) -> tuple[np.ndarray, ...]:
    kinds = (("ids", np.int64), ("counts", np.uint32), ("known", np.int64), ("base", np.float64), ("extra", np.float64), ("cells", np.uint32))
    out = [loosen(row[k], t) for k, t in kinds]
    return out[0], out[1].astype(np.int64), *out[2:5], out[5].astype(np.int64)


PIECES = "shard int, keys binary, counts binary, cells binary"


def dealt(shards: int, turn: int):
    """A turn's training documents of each chunk, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            ids, counts, _, _, _, cells = unpacked(row)
            starts = np.cumsum(counts) - counts
            key = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (np.add.reduceat(cells, starts) * 31 + counts).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            for by in (29, 32):  # spread to all bits
                key = (key ^ (key >> np.uint64(by))) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(31)
            at = np.flatnonzero(~held_out(ids.tolist()) & (key % np.uint64(ROUNDS) == turn))
            shard = ((key[at] >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            at, shard = at[by], shard[by]
            edges = [*np.flatnonzero(np.diff(shard, prepend=-1)).tolist(), len(at)]
            for a, b in zip(edges, edges[1:], strict=False):
                own = at[a:b]
                lens = counts[own]
                ends = np.cumsum(lens)
                flat = cells[np.repeat(starts[own] - (ends - lens), lens) + np.arange(int(ends[-1]))]
                blobs = [squeeze(key[own], 1), squeeze(lens.astype(np.uint32), 1), squeeze(flat.astype(np.uint32), 1)]
                yield pa.RecordBatch.from_arrays([pa.array([int(shard[a])], pa.int32()), *[pa.array([x], pa.binary()) for x in blobs]], names=["shard", "keys", "counts", "cells"])

    return run


def shard_tokens(pieces: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(cells, starts of texts) of a shard's documents in the order of their keys, wherever they came from."""
    keys, counts, cells = (np.concatenate([loosen(p[k], t) for p in pieces]) for k, t in (("keys", np.uint64), ("counts", np.uint32), ("cells", np.uint32)))
    counts = counts.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    starts, lens = (np.cumsum(counts) - counts)[order], counts[order]
    ends = np.cumsum(lens)
    return cells[np.repeat(starts - (ends - lens), lens) + np.arange(int(ends[-1]))].astype(np.int64), ends - lens


def trained(rows: DataFrame, counts: np.ndarray, tokens: int) -> LogBilinear:
    spark = rows.sparkSession
    model = LogBilinear(counts)
    shards = -(-tokens // max(SHARD_TOKENS, SHARD_ROWS * len(model.table)))
    height = max(32, min(BLOCK, BLOCK * 64 // shards))
    blocks = -(-len(model.table) // height)
    schema = "shard int, block int, change binary, weight binary"
    names = ["shard", "block", "change", "weight"]
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((model.table, model.squares))

        def learn(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:
            one_thread()
            keep_heap()
            by: dict[int, list[dict]] = {}
            for r in (r for b in batches for r in b.to_pylist()):
                by.setdefault(r["shard"], []).append(r)
            table, squares = shared.value
            own = LogBilinear(counts) if by else None
            for shard in sorted(by):
                own.table, own.squares = table.copy(), squares.copy()
                cells, starts = shard_tokens(by.pop(shard))
                rng = np.random.default_rng([turn, shard])
                for low in range(0, len(cells), BATCH):
                    inside = starts[np.searchsorted(starts, low, side="right") : np.searchsorted(starts, low + BATCH)]
                    part = cells[low : low + BATCH]
                    own.step(part, contexts_of(part, np.append(0, inside - low), own.n), rng)
                for k in range(blocks):
                    part = slice(k * height, (k + 1) * height)
                    change = (own.table[part] - table[part]).astype(np.float16)
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([k], pa.int32()), pa.array([squeeze(change, 1)], pa.binary()), pa.array([squeeze(own.squares[part] - squares[part], 1)], pa.binary())], names=names)
            release()

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come by block and shard; one block's sums are held."""

            def close(k: int, change, weight, n: int) -> pa.RecordBatch:
                mean = (change / np.maximum(weight, 1e-30)[:, None]).astype(np.float32)
                return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([k], pa.int32()), pa.array([squeeze(mean)], pa.binary()), pa.array([squeeze((weight / n).astype(np.float32))], pa.binary())], names=names)

            at, change, weight, n = None, 0.0, 0.0, 0
            for r in (r for b in batches for r in b.to_pylist()):
                if r["block"] != at:
                    if at is not None:
                        yield close(at, change, weight, n)
                    at, change, weight, n = r["block"], 0.0, 0.0, 0
                w = loosen(r["weight"], np.float32).astype(np.float64)
                change, weight, n = change + w[:, None] * loosen(r["change"], np.float16).reshape(len(w), -1), weight + w, n + 1
            if at is not None:
                yield close(at, change, weight, n)

        n = min(blocks, 4 * spark.sparkContext.defaultParallelism)
        changes = rows.mapInArrow(dealt(shards, turn), PIECES).repartitionById(shards, F.col("shard")).mapInArrow(learn, schema)
        changed = changes.repartitionById(n, F.col("block") % n).sortWithinPartitions("block", "shard").mapInArrow(average, schema).collect()  # the parameters: below 80 MB
        table, squares = model.table.copy(), model.squares.copy()
        for r in changed:
            part = slice(r.block * height, (r.block + 1) * height)
            table[part] += loosen(bytes(r.change), np.float32).reshape(-1, model.d + 1)
            squares[part] += loosen(bytes(r.weight), np.float32)
        model.table, model.squares = table, squares
        shared.destroy()
    return model


SCORES = "_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def scores(docs: DataFrame) -> tuple[DataFrame, int]:
    """Per document the columns of SCORES, and N."""
    spark = docs.sparkSession
    table = chunked(texts(docs), new_coder, lambda ids: ~held_out(ids))
    n, v, top, tokens, kinds = corpus_counts(table)
    number, rest = {w: i for i, (w, _) in enumerate(top)}, len(top)

    def values(own: list[bytes], total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A word's value: its training count and its cell."""
        cells = np.fromiter(map(number.get, own, repeat(-1)), np.int64, len(own))
        cells = np.where(cells < 0, rest + endings(own), cells)
        return np.full(len(own), 2, np.int64), np.stack([total, cells], 1).ravel()

    rows = streams(table, with_values(table, values), n, v, rest, tokens + kinds + 1.0)
    drop_cut(table)
    counts = np.concatenate([[c for _, c in top], tokens]).astype(np.float64)
    model = None
    if n:
        fitted = trained(rows, counts, n)
        model = spark.sparkContext.broadcast(fitted.table)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        keep_heap()
        own = LogBilinear(counts)
        if model is not None:
            own.table = model.value
        for row in (r for b in batches for r in b.to_pylist()):
            ids, sizes, known, base, extra, cells = unpacked(row)
            score = base
            if model is not None:
                starts = np.cumsum(sizes) - sizes
                score = extra + np.add.reduceat(own.logs(cells, contexts_of(cells, starts, own.n)), starts) / np.log(10)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(held_out(ids.tolist())), pa.array(sizes), pa.array(known), pa.array(base), pa.array(score)], names=["_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
        release()

    return rows.mapInArrow(finish, SCORES), n


def op3_log_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, n = scores(documents(spark, sf_dir, "doc_id", "text"))
    return out.select(id_out(), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
