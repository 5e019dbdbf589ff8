"""Blocked Bloom filter over 64-bit hashes: built by Spark, probed with numpy.

A hash names a block of 256 bits and one bit in each of its eight words, so a probe touches one block. The number of
blocks is bounded; a filter of more keys than fit well lets more through, but never denies a key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS_PER_BLOCK = 16
WORDS = 8


class BlockedFilter:
    """Bits of the listed keys' hashes: blocks of WORDS 32-bit words."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    @staticmethod
    def places(h: np.ndarray, blocks: int, words: slice = slice(0, WORDS)) -> tuple[np.ndarray, np.ndarray]:
        """Block of each hash, and its bit in each of the words."""
        block = (h >> np.uint64(40)).astype(np.int64) % blocks
        bit = (h[:, None] >> np.arange(0, 5 * WORDS, 5, dtype=np.uint64)[words]) & np.uint64(31)
        return block, np.uint32(1) << bit.astype(np.uint32)

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        """Two words of the block decide most absent keys; the others are looked at for what is left."""
        held = np.ones(len(h), bool)
        block, bit = self.places(h, len(self.bits), slice(0, 2))
        for i in (0, 1):
            held &= (self.bits[block, i] & bit[:, i]) == bit[:, i]
        some = np.flatnonzero(held)
        block, bit = self.places(h[some], len(self.bits))
        held[some] = ((self.bits[block] & bit) == bit).all(axis=1)
        return held


def build_filter(hashes: DataFrame, most: int) -> BlockedFilter:
    """Filter of the longs in `h`; Spark merges the bits per block, at most `most` blocks of 32 bytes come back."""
    keys = hashes.count()
    blocks = 1
    while blocks < most and blocks * KEYS_PER_BLOCK < keys:
        blocks *= 2
    words = [F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {5 * i}) & 31 AS int))")).alias(f"w{i}") for i in range(WORDS)]
    found = hashes.groupBy(F.expr(f"shiftrightunsigned(h, 40) % {blocks}L").alias("block")).agg(*words).toArrow()
    bits = np.zeros((blocks, WORDS), np.uint32)
    at = found["block"].to_numpy()
    for i in range(WORDS):
        bits[at, i] = found[f"w{i}"].to_numpy().astype(np.uint32)
    return BlockedFilter(bits)
