"""Packing of documents into sequences of a fixed capacity by Karmarkar-Karp differencing.

A document is its token ids and an end id. It is cut into full pieces of `capacity` ids, which are sequences
of their own and take no part in the grouping, and a rest; a rest gives up a piece of half and then one of a quarter of the capacity if it is
longer, since small pieces balance better (1 % of padding instead of 3.5 %). Rests are dealt at random into blocks of about BLOCK pieces, and each block
is partitioned into windows by multiway differencing: every piece starts as a partial partition with one
filled window; again and again the two partial partitions with the largest imbalance are merged, the
fullest windows of one with the emptiest of the other. That gives windows of nearly equal fill. The
number of windows starts at the least possible and rises while the fullest exceeds the capacity.

Pieces carry positions and checksums, so ids are encoded once and are not moved. A null or empty text is
just the end id. Repeated rows are packed as often as they occur. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.functions.merging import union_all
from opslens.llm.tokens import tokenizer
from opslens.session import stage

CAPACITY = 2048
END_ID = 1
BLOCK = 512
WINDOW_BITS = 24
FULL = 1 << 62


def cuts(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n ids, in order."""
    full, rest = divmod(n, capacity)
    out = [capacity] * full
    for part in (capacity // 2, capacity // 4):
        if rest > part > 0:
            out.append(part)
            rest -= part
    return out + [rest] * (rest > 0)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, and the ids if asked for."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), tokenizer(path).encode(batch.column("text"))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                at = 0
                for n in cuts(len(ids), capacity):
                    part = ids[at:at + n]
                    rows.append((doc, at, n, zlib.crc32(part.tobytes()), len(ids), *([part.astype(np.int32)] * with_ids)))
                    at += n
            names = [f.split()[0] for f in schema.split(", ")]
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(batches, schema)


def _difference(sizes: list[int], windows: int) -> tuple[int, list]:
    """Karmarkar-Karp: the largest sum, and a tree of members for each filled one of `windows` windows.

    A partial partition lists its filled windows, emptiest first; the others are empty and come before them.
    """
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = max(0, len(a) + len(b) - windows)  # so many filled windows of one meet filled ones of the other
        met = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[:both], b[both - 1::-1] if both else ())]
        total = sorted(met + a[both:] + b[both:], key=itemgetter(0))
        low = total[0][0] if len(total) == windows else 0
        heapq.heappush(heap, (low - total[-1][0], turn, total))
        turn += 1
    filled = heap[0][2]
    return filled[-1][0], [tree for _, tree in filled]


def _leaves(tree) -> list[int]:
    out, todo = [], [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):
            todo += node
        else:
            out.append(node)
    return sorted(out)


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Members of every window; no window exceeds the capacity."""
    if not sizes:
        return []
    count = -(-sum(sizes) // capacity)
    while True:
        most, trees = _difference(sizes, count)
        over = most - capacity
        if over <= 0:
            return [_leaves(t) for t in trees]
        count += max(1, count * over // (2 * capacity))


def pack(parts: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """The pieces with sequence_id and offset. Every column of theirs is kept."""
    held = stage(parts.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    # a full piece is a sequence of its own, numbered by its row
    full = held.filter(F.col("length") >= capacity).select(
        *parts.columns, F.col("_row").bitwiseOR(F.lit(FULL)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    loose = held.filter(F.col("length") < capacity)
    blocks = max(1, -(-loose.count() // block))
    group = F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int")

    def solve(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("_row", "ascending")])
        sizes = rows["length"].to_pylist()
        window, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for k, members in enumerate(windows_of(sizes, capacity)):
            at = 0
            for i in members:
                window[i], offset[i] = k, at
                at += sizes[i]
        number = (rows["_block"].to_numpy().astype(np.int64) << WINDOW_BITS) + window
        return rows.drop_columns(["_row", "_block"]).append_column("sequence_id", pa.array(number)).append_column(
            "offset", pa.array(offset))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    return union_all(full, loose.withColumn("_block", group).groupBy("_block").applyInArrow(solve, schema))


def sequences(docs: DataFrame, path: str, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """sequence_id, doc_ids, lengths, ids: the packed ids, padded to the capacity except at a power of two."""
    packed = pack(pieces(docs, path, capacity, with_ids=True), capacity)
    whole = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("p"))
    ids = F.flatten(F.col("p.ids"))
    n = F.size(ids)
    padded = F.when(F.bit_count(n) == 1, ids).otherwise(F.concat(ids, F.array_repeat(F.lit(pad_id), F.lit(capacity) - n)))
    return whole.select("sequence_id", F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"), padded.alias("ids"))


def digest(docs: DataFrame, path: str) -> DataFrame:
    return pack(pieces(docs, path))
