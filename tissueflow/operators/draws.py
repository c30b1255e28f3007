"""MD5 draws of transcripts, many at once: Spark's own md5 takes microseconds a transcript, and large tables have billions of them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_WORD = [(m * i + b) % 16 for m, b in ((1, 0), (5, 1), (3, 5), (7, 0)) for i in range(16)]
#: Transcripts hashed together: what that takes stays in a core's cache.
STEP = 1 << 15


def md5_words(words: list, n: int) -> list[np.ndarray]:
    """The four little-endian words of ``n`` digests; ``words`` has 16 a block of the padded messages, a number or an array each."""
    state = [np.full(n, x, np.uint32) for x in _START]
    f = np.empty(n, np.uint32)
    for at in range(0, len(words), 16):
        a, b, c, d = (x.copy() for x in state)
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            elif i < 32:
                np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            elif i < 48:
                np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            else:
                np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            word, more = words[at + _WORD[i]], _ADD[i]
            if isinstance(word, int):
                more = (more + word) % 2**32
            else:
                np.add(a, word, out=a)
            np.add(a, np.uint32(more), out=a), np.add(a, f, out=a)
            np.left_shift(a, np.uint32(_TURN[i]), out=f), np.right_shift(a, np.uint32(32 - _TURN[i]), out=a)
            np.bitwise_or(a, f, out=a), np.add(a, b, out=a)
            a, b, c, d = d, a, b, c
        for s, x in zip(state, (a, b, c, d), strict=True):
            s += x
    return state


def _alike(keys: np.ndarray, n: np.ndarray, limit: np.ndarray, digits: int, tail: bytes, draws: int) -> np.ndarray:
    """:func:`drawn` for keys of one length and the transcripts whose numbers have so many digits."""
    rows, length = keys.shape
    low, out = 10 ** (digits - 1), np.zeros((rows, draws), np.int64)
    end = length + 2 + digits + len(tail)
    base = np.zeros((rows, -(-(end + 9) // 64) * 64), np.uint8)
    base[:, :length], base[:, length], base[:, end] = keys, ord("|"), 0x80
    base[:, length + 1 + digits : end] = np.frombuffer(b"|" + tail, np.uint8)
    base[:, -8:] = np.frombuffer((8 * end).to_bytes(8, "little"), np.uint8)
    word = np.ascontiguousarray(base.view("<u4").T)
    own = (length + 1 + digits) // 4 + 1  # later words are the same in every message
    cum = np.concatenate([[0], np.cumsum(np.minimum(n, 10 * low - 1) - low + 1)])
    for lo in range(0, int(cum[-1]), STEP):
        hi = min(lo + STEP, int(cum[-1]))
        first, last = np.searchsorted(cum, [lo, hi - 1], "right") - 1
        part = np.minimum(cum[first + 1 : last + 2], hi) - np.maximum(cum[first : last + 1], lo)
        row = np.repeat(np.arange(first, last + 1), part)
        u = np.arange(lo, hi) - cum[row] + low
        words = [word[j][row] if j < own else int(word[j, 0]) for j in range(len(word))]
        for at in range(length + digits, length, -1):
            u, digit = np.divmod(u, 10)
            words[at // 4] += (digit + ord("0")).astype(np.uint32) << np.uint32(8 * (at % 4))
        state = md5_words(words, hi - lo)
        for k in range(draws):
            below = state[k // 2].astype("<u4").view("<u2")[k % 2 :: 2].byteswap() < limit[row]
            out[first : last + 1, k] += np.bincount(row[below] - first, minlength=last + 1 - first)
    return out


def drawn(keys: pa.Array, n: np.ndarray, limit: np.ndarray, tail: str, draws: int) -> np.ndarray:
    """For each key, of its transcripts 1 to ``n`` how many draw below ``limit``, in each of up to eight ``draws``.

    Draw k of transcript u is the number that the hexadecimal digits 4 k + 1 to 4 k + 4 of md5('key|u|tail') make. A limit of
    2**16 keeps all, and none is hashed.
    """
    out = np.where(limit >= 1 << 16, n, 0)[:, None].repeat(draws, axis=1)
    x = keys.cast(pa.large_binary())
    at = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
    data = np.frombuffer(x.buffers()[2] or b"", np.uint8)
    some, length = (limit < 1 << 16) & (limit > 0) & (n > 0), np.diff(at)
    for size in np.unique(length[some]).tolist():
        digits, low = 1, 1
        while len(rows := np.flatnonzero(some & (length == size) & (n >= low))):
            own = data[at[rows][:, None] + np.arange(size)]
            out[rows] += _alike(own, n[rows], limit[rows], digits, tail.encode(), draws)
            digits, low = digits + 1, low * 10
    return out
