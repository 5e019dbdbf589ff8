"""Words of many texts at once: byte classes in numpy, exact word numbers from Arrow's dictionary encoding.

All separators are ASCII, so a UTF-8 text can be cut byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def byte_class(members: str) -> np.ndarray:
    """Table of 256 flags: the byte is one of these ASCII characters."""
    return np.isin(np.arange(256), np.frombuffer(members.encode("ascii"), np.uint8))


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive parts of about SLICE_BYTES (a longer text is a part of its own), with their first row; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        held = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, held + SLICE_BYTES, "right")))
        yield begin, texts.slice(begin, end - begin)
        begin = end


class Words:
    """Lower-cased (A-Z) words of a slice of texts: a number per word, the words by number, and where they stand.

    text is the row of each word. piece numbers the stretches without a break character; it changes between texts.
    """

    def __init__(self, texts: pa.Array, separators: np.ndarray, breaks: np.ndarray | None = None) -> None:
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        size = int(offsets[-1] - offsets[0])
        raw = np.frombuffer(texts.buffers()[2], np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8)
        edge = offsets - offsets[0]
        inside = ~separators[raw]
        # a word also starts where a text does
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        at_edge = edge[:-1][np.diff(edge) > 0]
        first[at_edge] = inside[at_edge]
        starts = np.flatnonzero(first)
        kept = LOWER[raw[inside]]
        narrow = np.int32 if size < 1 << 31 else np.int64
        before = np.cumsum(inside, dtype=narrow)
        begins = before[starts] - 1 if len(starts) else np.zeros(0, np.int64)
        bounds = np.append(begins, len(kept)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(kept)])
        coded = words.dictionary_encode()
        self.number = coded.indices.to_numpy()
        self.words = coded.dictionary
        self.text = np.searchsorted(edge, starts, "right") - 1
        if breaks is not None:
            self.piece = np.cumsum(breaks[raw], dtype=narrow)[starts] + self.text if size else starts
