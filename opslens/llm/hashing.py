"""Vectorised 64-bit hashes of words in UTF-8 buffers.

A word's hash is the difference of two prefix sums of byte * ODD**position, shifted back by the inverse power,
then mixed; it depends on the word's bytes only. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from functools import cache

import numpy as np

ODD = 0x9E3779B97F4A7C15
PIECE = 1 << 20
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of MurmurHash3 (fixed values)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@cache
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD**i and its inverse modulo 2**64, for i below size."""
    up, down = np.full(size, ODD, np.uint64), np.full(size, pow(ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def spans(separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-separators."""
    edge = np.flatnonzero(np.diff(np.concatenate(([1], separator.view(np.int8), [1]))))
    return edge[::2], edge[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = 1 << max(20, int(len(data)).bit_length())
    up, down = powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, table: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of a UTF-8 buffer, in pieces of about PIECE bytes cut at separators."""
    at, hashes, begin = [], [], 0
    while begin < len(data):
        end = min(len(data), begin + PIECE)
        while end < len(data):
            gaps = np.flatnonzero(table[data[begin:end]])
            if len(gaps):
                end = begin + int(gaps[-1]) + 1
                break
            end = min(len(data), end + PIECE)  # a word longer than a piece
        piece = data[begin:end]
        starts, ends = spans(table[piece])
        at.append(starts + begin)
        hashes.append(span_hashes(piece, starts, ends))
        begin = end
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(at), np.concatenate(hashes)


def text_groups(texts: list[bytes], limit: int = PIECE) -> list[tuple[int, int]]:
    """Consecutive texts in groups of about `limit` bytes; a longer text is a group of its own."""
    groups, begin, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            groups.append((begin, i))
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        groups.append((begin, len(texts)))
    return groups
