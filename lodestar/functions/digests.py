"""MD5 of many short messages at once, on numpy arrays inside tasks: one message by the library takes ten times as long."""

from __future__ import annotations

import hashlib
import math

import numpy as np

WORD = np.uint32
_ADD = np.array([int(abs(math.sin(k + 1)) * (1 << 32)) for k in range(64)], WORD)
_TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
TILE = 32768  # messages at a time, so that the state stays in a core's cache


def first_words(words: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The first 32 bits (little-endian) of the digests of messages of one block, given by 16 arrays that broadcast to `shape`."""
    a, b, c, d = (np.full(shape, v, WORD) for v in _START)
    f, turned = np.empty(shape, WORD), np.empty(shape, WORD)
    for k in range(61):  # the last three of 64 steps leave this word alone
        if k < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
            at = k
        elif k < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
            at = (5 * k + 1) % 16
        elif k < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
            at = (3 * k + 5) % 16
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
            at = 7 * k % 16
        np.add(f, a, out=f)
        if words[at].shape == shape:
            np.add(f, words[at], out=f)
            np.add(f, _ADD[k], out=f)
        else:
            np.add(f, words[at] + _ADD[k], out=f)
        np.left_shift(f, WORD(_TURN[k]), out=turned)
        np.right_shift(f, WORD(32 - _TURN[k]), out=f)
        np.bitwise_or(f, turned, out=f)
        a, b, c, d, f = d, np.add(f, b, out=a), b, c, f
    return b + WORD(_START[0])


def _bytes(texts: list[bytes], at: int) -> np.ndarray:
    """Texts of equal length as rows of blocks of 64 bytes, from the place `at`."""
    out = np.zeros((len(texts), 64), np.uint8)
    out[:, at : at + len(texts[0])] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), -1)
    return out


def _words(blocks: np.ndarray) -> np.ndarray:
    return blocks.view("<u4").astype(WORD)


def low_half(heads: list[bytes], tails: list[bytes]) -> np.ndarray:
    """For each head and tail (rows, columns): is the MD5 of the two together in the lower half, its first bit 0?"""
    out = np.empty((len(heads), len(tails)), bool)
    sizes, wide = np.array([len(t) for t in heads]), max(1, min(len(tails), TILE))
    deep, ends = TILE // wide, [k for k in range(1, len(tails)) if len(tails[k]) != len(tails[k - 1])]
    for low, high in zip([0, *ends], [*ends, len(tails)], strict=True):  # tails of one length are side by side
        for c in range(low, high, wide):
            part = tails[c : min(high, c + wide)]
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                for r in range(0, len(rows), deep):
                    out[rows[r : r + deep], c : c + len(part)] = _low([heads[k] for k in rows[r : r + deep]], part)
    return out


def _low(heads: list[bytes], tails: list[bytes]) -> np.ndarray:
    """The same for heads of one length and tails of one length."""
    n, m = len(heads[0]), len(tails[0])
    if n + m > 55 or not m:  # more than a block
        return np.array([[hashlib.md5(h + t).digest()[0] < 128 for t in tails] for h in heads])
    right = _bytes(tails, n)
    right[:, n + m], right[:, 56], right[:, 57] = 128, (n + m) * 8 & 255, (n + m) * 8 >> 8
    right, left = _words(right), _words(_bytes(heads, 0)) if n else np.zeros((len(heads), 16), WORD)
    words = [(left[:, k : k + 1] if k * 4 < n else left[:1, k : k + 1]) | (right[None, :, k] if n < k * 4 + 4 and k * 4 < n + m else right[:1, k : k + 1]) for k in range(16)]
    return first_words(words, (len(heads), len(tails))) & WORD(128) == 0
