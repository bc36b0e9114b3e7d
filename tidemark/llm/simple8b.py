"""Token ids in a binary file format: Simple-8b words in blocks.

A 64-bit word holds a selector in its four high bits and, in the other 60, as many ids as the selector says, all of
the selector's width. Selector 0 is the escape: the word holds the place, in the block's list of wide values, of one id
of more than 60 bits. Ids are coded in blocks of BLOCK; each block starts on a word of its own and the places of
its first word and first escape are stored, so that all words of many blocks are decoded at once by array operations.

A file row (Parquet holds the rows, so that Spark's commit protocol guards the write) is a run of whole documents:
their ids, token counts, words, block places and escapes.

Texts are encoded as the library does with add_special_tokens=False alone: added tokens that stand in a text become their own ids.

Defined results: null and empty texts have only the end id; texts of any length are encoded whole; null ids sort last; rows that share an id are ordered by
their text's hash; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, documents, id_out, texts
from .pieces import Pieces

BLOCK = 2048
#: Ids a word, and bits an id, for selectors 0 (escape) to 14. Fixed values of the format.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)

#: Bits of ids below 65,536.
SHORT = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, escapes, first escape of each block) for unsigned ids."""
    n = len(ids)
    ids = ids.astype(np.uint64)
    blocks = -(-n // block)
    ends = np.minimum(np.arange(1, blocks + 1, dtype=np.int64) * block, n)
    # bits of each id, every block followed by zeros: a last word may reach beyond its block
    reach = np.arange(n, dtype=np.int64)
    reach += reach // block * int(COUNTS.max())
    bits = np.zeros(blocks * (block + int(COUNTS.max())), np.uint8)
    bits[reach] = SHORT[ids] if n and int(ids.max()) < len(SHORT) else np.frexp(ids.astype(np.float64))[1]
    choice = np.zeros(n, np.int8)
    left = np.flatnonzero(bits[reach] <= WIDTHS[-1])
    choice[left] = len(COUNTS) - 1
    reach, held = reach[left], 1
    most = bits[reach]
    for s in range(len(COUNTS) - 2, 0, -1):  # what a wide selector doesn't fit, no narrower one fits
        while held < COUNTS[s]:
            most = np.maximum(most, bits[reach + held])
            held += 1
        fits = most <= WIDTHS[s]
        if not fits.all():
            left, reach, most = left[fits], reach[fits], most[fits]
        choice[left] = s
    pos, places, picks = ends - np.diff(np.concatenate([[0], ends])), [], []
    own = np.arange(blocks)
    while len(own):
        s = choice[pos]
        places.append((own, pos))
        picks.append(s)
        pos = pos + COUNTS[s]
        left = pos < ends[own]
        own, pos = own[left], pos[left]
    if not places:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.concatenate([o for o, _ in places])
    start = np.concatenate([p for _, p in places])
    order = np.lexsort((start, owner))
    owner, start, picked = owner[order], start[order], np.concatenate(picks)[order].astype(np.int64)
    words = picked.astype(np.uint64) << np.uint64(60)
    for s in np.unique(picked):
        rows = np.flatnonzero(picked == s)
        if s == 0:
            continue
        reach = start[rows][:, None] + np.arange(COUNTS[s])
        inside = reach < ends[owner[rows]][:, None]
        values = np.where(inside, ids[np.minimum(reach, n - 1)], np.uint64(0))
        words[rows] |= np.bitwise_or.reduce(values << (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64), axis=1)
    wide = picked == 0
    first_word = np.searchsorted(owner, np.arange(blocks))
    wide_before = np.concatenate([[0], np.cumsum(wide)])
    first_escape = wide_before[first_word]
    words[wide] |= (wide_before[:-1] - first_escape[owner])[wide].astype(np.uint64)
    return words, first_word, ids[start[wide]], first_escape


def unpack(words: np.ndarray, first_word: np.ndarray, escapes: np.ndarray, first_escape: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n ids that pack() coded; every word is decoded independently."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    picked = (words >> np.uint64(60)).astype(np.int64)
    owner = np.repeat(np.arange(len(first_word)), np.diff(np.concatenate([first_word, [len(words)]])))
    held = COUNTS[picked]
    before = np.cumsum(held) - held
    start = owner * block + before - before[first_word][owner]
    end = np.minimum((owner + 1) * block, n)
    for s in np.unique(picked):
        rows = np.flatnonzero(picked == s)
        if s == 0:
            out[start[rows]] = escapes[first_escape[owner[rows]] + (words[rows] & np.uint64(2**60 - 1)).astype(np.int64)]
            continue
        values = words[rows][:, None] >> (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64) & np.uint64(2 ** int(WIDTHS[s]) - 1)
        reach = start[rows][:, None] + np.arange(COUNTS[s])
        inside = reach < end[rows][:, None]
        out[reach[inside]] = values[inside]
    return out


_stores: dict[str, Pieces] = {}


def encoder(path: str) -> Pieces:
    """The tokenizer of a file, behind the worker's store of pieces."""
    if path not in _stores:
        from tokenizers import Tokenizer

        tool = Tokenizer.from_file(path)
        letters = tool.pre_tokenizer.alphabet()
        width = np.array([0 if t is None else len(t) if all(c in letters for c in t) else len(t.encode()) for t in (tool.id_to_token(i) for i in range(tool.get_vocab_size()))], np.int64)

        def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Pieces with a lone space in front are encoded in strings of many; tokens fall to pieces by their byte lengths."""
            alone = [i for i, p in enumerate(pieces) if len(p) < 2 or p[0] != " " or p[1].isspace() or p[-1].isspace()]
            kept = set(alone)
            joined = [i for i in range(len(pieces)) if i not in kept]
            runs = [joined[i : i + 256] for i in range(0, len(joined), 256)]
            found = tool.encode_batch_fast([pieces[i] for i in alone] + ["".join(pieces[i] for i in run) for run in runs], add_special_tokens=False)
            flat = np.fromiter(chain.from_iterable(e.ids for e in found), np.int64, sum(map(len, found)))
            ends = np.concatenate([np.cumsum(np.fromiter(map(len, found[: len(alone)]), np.int64, len(alone))), np.zeros(len(joined), np.int64)])
            low = int(ends[len(alone) - 1]) if alone else 0
            # ends of pieces in bytes, over all strings: a token ends where a piece does
            sizes = np.cumsum(np.fromiter((len(pieces[i].encode()) for i in joined), np.int64, len(joined)))
            ends[len(alone) :] = low + np.searchsorted(np.cumsum(width[flat[low:]]), sizes) + 1
            order, lens = np.empty(len(pieces), np.int64), np.diff(ends, prepend=0)
            order[alone + joined] = np.arange(len(pieces))
            starts, lens = (ends - lens)[order], lens[order]
            stops = np.cumsum(lens)
            return flat[np.repeat(starts - (stops - lens), lens) + np.arange(len(flat))].astype(np.uint32), lens

        _stores[path] = Pieces(encode)
    return _stores[path]


FILE = "shard int, run int, doc_ids binary, counts binary, words binary, first_word binary, escapes binary, first_escape binary"


def file_rows(tokenizer: str, end_id: int, batch_bytes: int = 4_000_000):
    """A partition's documents, in order, as rows of the file format."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        store, shard, run = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for ids, group in grouped(batches, batch_bytes):
            flat, counts = store.rows(group)
            ends = np.cumsum(counts)
            tokens = np.insert(flat.astype(np.uint64), ends, end_id)
            parts = pack(tokens)
            row = [np.array(ids, np.int64), (counts + 1).astype(np.uint32), *parts]
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "run": pa.array([run], pa.int32())} | {k: pa.array([a.tobytes()], pa.binary()) for k, a in zip(("doc_ids", "counts", "words", "first_word", "escapes", "first_escape"), row, strict=True)})
            run += 1

    return write


def grouped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts in groups of about `most` characters, one document at least."""
    ids, group, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column("_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids.append(i)
            group.append(t)
            size += len(t)
            if size >= most:
                yield ids, group
                ids, group, size = [], [], 0
    if ids:
        yield ids, group


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Encodes documents and writes them in ascending id order; returns the file's rows as read back."""
    ordered = texts(docs).withColumn("_h", F.xxhash64("text")).repartitionByRange("_id", "_h").sortWithinPartitions("_id", "_h").select("_id", "text")
    return cut(ordered.mapInArrow(file_rows(tokenizer, end_id), FILE), "ids")


def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document of a file's rows: place in its shard run, tokens and the crc32 of its ids."""
    for batch in batches:
        for row in batch.to_pylist():
            own = np.frombuffer(row["doc_ids"], np.int64)
            counts = np.frombuffer(row["counts"], np.uint32).astype(np.int64)
            parts = [np.frombuffer(row[k], t) for k, t in (("words", np.uint64), ("first_word", np.int64), ("escapes", np.uint64), ("first_escape", np.int64))]
            ids = unpack(*parts, int(counts.sum())).astype("<u4")
            ends = np.cumsum(counts)
            view = memoryview(ids).cast("B")
            sums = [zlib.crc32(view[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
            n = len(own)
            yield pa.RecordBatch.from_pydict({"_id": pa.array(own), "shard": pa.array([row["shard"]] * n, pa.int32()), "run": pa.array([row["run"]] * n, pa.int32()), "at": pa.array(ends - counts), "n_tokens": pa.array(counts), "ids_crc32": pa.array(sums, pa.int64())})


def read_ids(files: DataFrame) -> DataFrame:
    """Per document: _id, start (ids of all documents before it), n_tokens, ids_crc32."""
    rows = cut(files.mapInArrow(decoded, "_id long, shard int, run int, at long, n_tokens long, ids_crc32 long"), "read")
    sizes = rows.groupBy("shard", "run").agg(F.sum("n_tokens").alias("n"))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    base = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("base"))
    runs = sizes.select("shard", "run", (F.sum("n").over(W.partitionBy("shard").orderBy("run")) - F.col("n")).alias("run_base"))
    places = runs.join(F.broadcast(base), "shard").select("shard", "run", (F.col("base") + F.col("run_base")).alias("before"))
    # one place for each run of 4 MB of text, some 20 bytes: 200 KB for 40 GB; the planner may still choose another join
    return rows.join(places, ["shard", "run"]).select("_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op1_simple8b_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write_ids(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(files).select(id_out(), "start", "n_tokens", "ids_crc32")
