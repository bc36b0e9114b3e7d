"""The numbers of `operators.routes.drawn` for many counts at once, within tasks."""

from __future__ import annotations

import hashlib
import math

import numpy as np

FEW = 400  # below so many, one by one is faster
TABLE = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def first_words(blocks: list[list], n: int) -> np.ndarray:
    """The first eight hexadecimal digits, as numbers, of the MD5 of n padded messages: blocks of sixteen words, each an int if all messages share it, else an array."""
    whole = [np.full(n, s, np.uint32) for s in START]
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for words in blocks:
        a, b, c, d = (x.copy() for x in whole)
        for i in range(64):
            turn, k = i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
            if turn < 2:  # d ^ (b & (c ^ d)), c ^ (d & (b ^ c))
                x, y, z = (b, c, d) if turn == 0 else (d, b, c)
                np.bitwise_xor(y, z, out=f)
                np.bitwise_and(f, x, out=f)
                np.bitwise_xor(f, z, out=f)
            elif turn == 2:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
            else:
                np.invert(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, c, out=f)
            np.add(a, f, out=a)
            word = words[k]
            if isinstance(word, int):
                np.add(a, np.uint32((word + TABLE[i]) & 0xFFFFFFFF), out=a)
            else:
                np.add(a, word, out=a)
                np.add(a, np.uint32(TABLE[i]), out=a)
            shift = TURNS[turn][i % 4]
            np.left_shift(a, np.uint32(shift), out=t)
            np.right_shift(a, np.uint32(32 - shift), out=a)
            np.bitwise_or(a, t, out=a)
            np.add(a, b, out=a)
            a, b, c, d = d, a, b, c
        whole = [x + y for x, y in zip(whole, (a, b, c, d), strict=True)]
    return whole[0].byteswap()


def drawn_counts(before: str, counts: np.ndarray, after: str) -> np.ndarray:
    """The number drawn from before, each count and after, one text; counts ascend and are not negative."""
    head, tail = before.encode(), after.encode()
    out, low = np.empty(len(counts), np.int64), 0
    while low < len(counts):
        digits = len(str(int(counts[low])))
        high = int(np.searchsorted(counts, 10**digits))
        own = counts[low:high]
        if high - low < FEW:
            out[low:high] = [int.from_bytes(hashlib.md5(b"%b%d%b" % (head, c, tail)).digest()[:4]) for c in own.tolist()]
        else:
            size = len(head) + digits + len(tail)
            plain = head + b"0" * digits + tail + b"\x80" + b"\0" * ((55 - size) % 64) + (8 * size).to_bytes(8, "little")
            words: list = [int.from_bytes(plain[k : k + 4], "little") for k in range(0, len(plain), 4)]
            for k in range(digits):
                at, digit = len(head) + k, (own // 10 ** (digits - 1 - k) % 10).astype(np.uint32)
                words[at // 4] = words[at // 4] + (digit << np.uint32(8 * (at % 4)))  # the zero's code, and no carry
            words = [w if isinstance(w, int) else w.astype(np.uint32) for w in words]
            out[low:high] = first_words([words[k : k + 16] for k in range(0, len(words), 16)], high - low)
        low = high
    return out
