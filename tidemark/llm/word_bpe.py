"""Byte-level BPE over a corpus's distinct words, and decoding.

Pre-tokens (matches of the tokenizer's pattern) are numbered in each chunk with their positions kept; each distinct
word of the corpus is encoded once, in the bucket of its hash, the ids are joined back to the chunks that use it and
the documents are put together by position. Decoding joins ids to the table of the tokens' bytes, which each task holds (50,256 rows here):
a word's ids once a chunk.

Defined results: null and empty texts have no ids; texts of any length are taken whole, in groups of 2 MB, one text at least; null ids of documents are kept; repeated rows each have a row; an
empty table gives none; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_out, texts
from .dictionary import chunked, read_chunks, with_values
from .pieces import Pieces

#: The white space of Unicode's property, as the tokenizers' \s.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def word_coder(pattern: str):
    """A coder for chunks: texts to numbers of their pre-tokens."""

    def new():
        import regex

        exact = regex.compile(pattern.replace("[^\\s", f"[^{SPACES}").replace("\\s", f"[{SPACES}]").replace("\\S", f"[^{SPACES}]"))
        numbers: dict[str, int] = {}

        def split(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found = [exact.findall(p) for p in pieces]
            lens = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((numbers.setdefault(w, len(numbers)) for f in found for w in f), np.int64, int(lens.sum())), lens

        store = Pieces(split)
        return store.rows, lambda: [w.encode() for w in numbers]

    return new


@cache
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table, by id; as large as the vocabulary, whatever the corpus."""
    found = {i: b for b, i in ranks(path).items()}
    return [found.get(i, b"") for i in range(max(found, default=-1) + 1)]


@cache
def merger(path: str):
    import tiktoken

    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks(path), special_tokens={})


def encode_words(path: str):
    """Ids of each distinct word by the merges of a rank file."""

    def values(words: list[bytes], _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tool = merger(path)
        rows = [tool.encode_ordinary(w.decode()) for w in words]
        lens = np.fromiter(map(len, rows), np.int64, len(rows))
        return lens, np.fromiter((x for r in rows for x in r), np.int64, int(lens.sum()))

    return values


def encoded(docs: DataFrame, path: str, pattern: str, finish, schema: str) -> DataFrame:
    table = chunked(texts(docs), word_coder(pattern))
    return read_chunks(table, with_values(table, encode_words(path)), finish, schema)


def documents_of_ids(ids: np.ndarray, counts: np.ndarray, numbers: np.ndarray, lens: np.ndarray, flat: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(_id, ids) rows, a few thousand at once."""
    per = lens[numbers]
    stops = np.concatenate([[0], np.cumsum(per)])[np.concatenate([[0], np.cumsum(counts)])]
    starts = np.cumsum(lens) - lens
    ends = np.cumsum(per)
    whole = flat[np.repeat(starts[numbers] - (ends - per), per) + np.arange(int(ends[-1]) if len(ends) else 0)].astype(np.int32)
    for low in range(0, len(ids), 2000):
        cuts = stops[low : low + 2001]
        yield pa.RecordBatch.from_arrays([pa.array(ids[low : low + 2000]), pa.ListArray.from_arrays(pa.array((cuts - cuts[0]).astype(np.int32)), pa.array(whole[cuts[0] : cuts[-1]]))], names=["_id", "ids"])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(_id, ids) of every document."""
    return encoded(docs, path, pattern, documents_of_ids, "_id long, ids array<int>")


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """(token, bytes), one row an id: a vocabulary's size, whatever the corpus."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in ranks(path).items()], "token int, bytes binary")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """(_id, bytes) of (_id, ids) rows; ids outside the table have no bytes.

    The table is read by each worker: its size is the vocabulary's, 50,256 rows here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = dict(enumerate(token_bytes(path)))
        for b in batches:
            out = [None if row is None else b"".join(table.get(i, b"") for i in row) for row in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(out, pa.binary())], names=["_id", "bytes"])

    return ids.select("_id", "ids").mapInArrow(run, "_id long, bytes binary")


DIGESTS = "_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(path: str):
    """Per document: tokens, the digest of its ids and of the bytes that they decode to; each word's ids decode once a chunk."""

    def finish(ids: np.ndarray, counts: np.ndarray, numbers: np.ndarray, lens: np.ndarray, flat: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        stops = np.cumsum(lens).tolist()
        tokens = flat.tolist()
        decimals = list(map(str, range(len(table))))
        said, read = [], []
        low = 0
        for high in stops:
            own = tokens[low:high]
            said.append(",".join([decimals[i] for i in own]))
            read.append(b"".join([table[i] for i in own]))
            low = high
        per, ends = lens[numbers], np.cumsum(counts).tolist()
        total = np.concatenate([[0], np.cumsum(per)])
        at, out = 0, ([], [], [])
        for end in ends:
            own = numbers[at:end].tolist()
            out[0].append(int(total[end] - total[at]))
            out[1].append(hashlib.sha256(",".join(map(said.__getitem__, own)).encode()).hexdigest())
            out[2].append(hashlib.sha256(b"".join(map(read.__getitem__, own))).hexdigest())
            at = end
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return finish


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    return encoded(docs, path, pattern, digests(path), DIGESTS)


def op9_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    out = token_digests(documents(spark, sf_dir, "doc_id", "text"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    return out.select(id_out(), "n_tokens", "ids_sha256", "decoded_sha256")
