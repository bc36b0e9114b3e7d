"""Splitting at lone spaces, and a worker's bounded store of what pieces encode to.

A lone space between two other characters always starts a new match of the byte-level BPE patterns (words take one
space in front, and runs of white space are not touched), so a text may be cut before each lone space, the pieces
encoded on their own and the ids joined.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def cut_at_spaces(text: str) -> list[str]:
    """The pieces of a text, each but the first starting with the lone space before it."""
    parts = text.split(" ")
    if len(parts) == 1:
        return parts if text else []
    if not text.isascii() or "" in parts or parts[0][-1:].isspace():
        plain = False
    else:
        plain = not any(c in text for c in ("\t ", " \t", "\n ", " \n", "\r ", " \r", "\v", "\f", "\x1c", "\x1d", "\x1e", "\x1f"))
    if plain:
        return [parts[0], *[" " + p for p in parts[1:]]]
    out, held = [], parts[0]
    for p in parts[1:]:
        if held and p and not held[-1].isspace() and not p[0].isspace():
            out.append(held)
            held = " " + p
        else:
            held += " " + p
    out.append(held)
    return out


class Pieces:
    """Piece -> row of numbers. Flat storage; emptied when `most` pieces are held, so memory is bounded."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 1_200_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.flat, self.starts, self.lens = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def dark(ends: pa.Array) -> np.ndarray:
        """Which of these characters are some, and not white."""
        coded = ends.dictionary_encode()
        seen = np.array([c != "" and not c.isspace() for c in coded.dictionary.to_pylist()], bool)
        return seen[coded.indices.to_numpy(zero_copy_only=False)]

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """(for each piece of all texts its place among the strings, strings, how many pieces each text has), cut as by cut_at_spaces.

        Only distinct parts between spaces are seen as Python strings. A cut depends on the parts at both its sides alone: neither is empty, nor white at that end.
        """
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        per = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        code, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        if not len(code):
            return np.zeros(0, np.int64), [], np.zeros(len(texts), np.int64)
        opens, shuts = (self.dark(pc.utf8_slice_codeunits(coded.dictionary, *k)) for k in ((0, 1), (-1,)))
        head = np.zeros(len(code), bool)
        head[np.cumsum(per) - per] = True
        begin = head.copy()
        begin[1:] |= opens[code[1:]] & shuts[code[:-1]]
        at = np.flatnonzero(begin)
        ends = np.append(at[1:], len(code))
        plain = (ends - at == 1) & ~head[at]  # one part after a space
        mark = np.zeros(len(names), bool)
        mark[code[at[plain]]] = True
        used = np.flatnonzero(mark)
        strings = [" " + names[i] for i in used.tolist()]
        place = np.empty(len(at), np.int64)
        place[plain] = (np.cumsum(mark) - 1)[code[at[plain]]]
        rest = np.flatnonzero(~plain)
        place[rest] = len(strings) + np.arange(len(rest))
        for a, b, first in zip(at[rest].tolist(), ends[rest].tolist(), head[at[rest]].tolist(), strict=True):
            piece = " ".join([names[i] for i in code[a:b].tolist()])
            strings.append(piece if first else " " + piece)
        return place, strings, np.add.reduceat(begin.astype(np.int64), np.cumsum(per) - per)

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all texts, how many for each text)."""
        place, strings, per = self.pieces(texts)
        if len(self.code) > self.most:
            self.clear()
        codes = np.fromiter(map(self.code.get, strings, repeat(-1)), np.int64, len(strings))
        unknown = np.flatnonzero(codes < 0).tolist()
        if unknown:
            new = list(dict.fromkeys([strings[i] for i in unknown]))  # first parts may repeat
            flat, lens = self.encode(new)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lens) - lens])
            self.flat, self.lens = np.concatenate([self.flat, flat.astype(np.uint32)]), np.concatenate([self.lens, lens])
            self.code.update(zip(new, range(len(self.code), len(self.code) + len(new)), strict=True))
            codes[unknown] = [self.code[strings[i]] for i in unknown]
        codes = codes[place]
        lens = self.lens[codes]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        out = self.flat[np.repeat(self.starts[codes] - (ends - lens), lens) + np.arange(total)]
        bound = np.concatenate([[0], ends])[np.cumsum([0, *per.tolist()])]
        return out, np.diff(bound)
