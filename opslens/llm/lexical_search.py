"""Ranked lexical search with a K2-treap over the grid of query terms and documents.

Documents are cut into ranges (what a task reads, RANGE_DOCS at most). The impacts of a range, what a term adds to a
document's score, form a grid of terms by documents. Its K2-treap is a quadtree that keeps non-empty cells only: per
node a bit mask of its children, the place of the first one, and the largest impact below it. An item's terms are rows
of the grid. Their paths go down jointly: a document range has a node per term, the sum of their maxima bounds
all its scores, and the most promising ranges are cut in half until single documents are left. A search ends when
no open range can reach the item's k-th score, ties included, so results are exact.

Scores are integers as described at `impacts`. Statistics cover all documents: N, L and df come from the table of
postings, which is written to the shared folder once. Items are taken from their table in blocks of ITEMS: a block's terms
are the rows of the grid, and a block reads the documents once. The driver holds one block of items and a number
per term of it.

Defined results: a null or empty text has no terms; a document without terms is in no result and does not count in N. Rows
that repeat a doc_id are documents of their own, null ids sort last. Each row of the items table is an item; one
without terms, or whose terms occur nowhere, has no rows. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from opslens.functions.merging import union_all
from opslens.functions.ranking import top_n_per_key
from opslens.llm.words import Words, slices
from opslens.session import stage

ITEMS = 1000
RANGE_DOCS = 16384
BATCH = 256
BEST = 50
SEPARATORS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
BITS = np.array([bin(i).count("1") for i in range(16)], np.int64)


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n (terms with repeats), and which of `terms` it holds, how often; documents without any term are left out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = pa.array(terms, pa.large_string())

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for begin, part in slices(batch.column("text")):
                words = Words(part, SEPARATORS)
                n = np.bincount(words.text, minlength=len(part))
                term = pc.fill_null(pc.index_in(words.words, known), -1).to_numpy()[words.number]
                asked = term >= 0
                pair, tf = np.unique(words.text[asked] * len(known) + term[asked], return_counts=True)
                row = pair // max(1, len(known))
                offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(part))))).astype(np.int32)
                out = pa.record_batch([
                    batch.column("doc_id").slice(begin, len(part)), pa.array(n.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array((pair % max(1, len(known))).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(tf.astype(np.int32))),
                ], names=["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))

    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")


def impacts(tf: np.ndarray, n: np.ndarray, w: np.ndarray, documents: int, length: int) -> np.ndarray:
    """w * ((10^9 tf) div (1000 tf + 20 m)) with m = 50 + (50 n N) div L, in 64-bit integers."""
    m = 50 + (50 * n * documents) // length
    return w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class K2Treap:
    """Quadtree of positive values at (row, column), compressed to non-empty cells, with maxima."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> None:
        self.height = max(1, int(max(rows.max(initial=0), columns.max(initial=0))).bit_length())
        code = np.zeros(len(rows), np.int64)
        for i in range(self.height):
            code |= ((rows >> i & 1) << (2 * i + 1)) | ((columns >> i & 1) << (2 * i))
        order = np.argsort(code, kind="stable")
        code, value = code[order], values[order]
        levels = [(value, np.zeros(len(value), np.int64), np.zeros(len(value), np.int64))]
        for _ in range(self.height):
            parent = code >> 2
            start = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1]))) if len(code) else np.zeros(0, np.int64)
            mask = np.bitwise_or.reduceat(1 << (code & 3), start) if len(start) else start
            value = np.maximum.reduceat(value, start) if len(start) else value
            levels.append((value, mask, start))
            code = parent[start]
        # one numbering from the root down; a child's number is its place in its level plus where the level begins
        levels.reverse()
        sizes = np.cumsum([0] + [len(v) for v, _, _ in levels])
        self.value, self.mask = (np.concatenate([level[i] for level in levels]) for i in (0, 1))
        self.first = np.concatenate([s + sizes[i + 1] for i, (_, _, s) in enumerate(levels)])

    def best(self, rows: np.ndarray, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Columns with the k largest sums over `rows`, all that tie with the k-th, and the sums; none below floor."""
        none = np.zeros(0, np.int64)
        if not len(self.value) or not len(rows):
            return none, none
        nodes = np.zeros((1, len(rows)), np.int64)
        bound = np.array([self.value[0] * len(rows)])
        level, column = np.array([self.height]), np.array([0])
        found_at, found = none, none
        while len(bound):
            at = np.argpartition(-bound, BATCH)[:BATCH] if len(bound) > BATCH else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[at] = False
            here, lev, col = nodes[at], level[at] - 1, column[at]
            held = here >= 0
            mask = np.where(held, self.mask[here], 0)
            row_bit = rows >> lev[:, None] & 1
            new = []
            for half in (0, 1):
                quarter = 2 * row_bit + half
                there = (mask >> quarter & 1).astype(bool)
                child = np.where(there, self.first[here] + BITS[mask & ((1 << quarter) - 1)], -1)
                sums = np.where(there, self.value[child], 0).sum(axis=1)
                good = sums >= floor
                new.append((child[good], sums[good], lev[good], (2 * col + half)[good]))
            child, sums, lev, col = (np.concatenate(x) for x in zip(*new))
            leaf = lev == 0
            if leaf.any():
                found_at, found = np.append(found_at, col[leaf]), np.append(found, sums[leaf])
                if len(found) > k:
                    floor = max(floor, int(np.partition(found, -k)[-k]))
                    kept = found >= floor
                    found_at, found = found_at[kept], found[kept]
            nodes, bound = np.concatenate((nodes[rest], child[~leaf])), np.concatenate((bound[rest], sums[~leaf]))
            level, column = np.concatenate((level[rest], lev[~leaf])), np.concatenate((column[rest], col[~leaf]))
            open_ = bound >= floor
            nodes, bound, level, column = nodes[open_], bound[open_], level[open_], column[open_]
        return found_at, found


class Best:
    """The k best (score, doc_id) seen so far of one item."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, []

    def floor(self) -> int:
        return self.rows[-1][0] if len(self.rows) >= self.k else 1

    def add(self, score: np.ndarray, doc: list) -> None:
        rows = self.rows + list(zip(score.tolist(), doc))
        self.rows = heapq.nsmallest(self.k, rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))


def search_ranges(weights: np.ndarray, asked: list[np.ndarray], documents: int, length: int, k: int):
    """Postings of a task -> the k best documents of each item in it: item, doc_id, score."""

    def ranges(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, rows = [], 0
        for batch in stream:
            begin = 0
            while begin < len(batch):
                take = min(len(batch) - begin, RANGE_DOCS - rows)
                held.append(batch.slice(begin, take))
                begin, rows = begin + take, rows + take
                if rows == RANGE_DOCS:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, rows = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def search(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in asked]
        for table in ranges(stream):
            terms, tfs = (table[c].combine_chunks() for c in ("terms", "tfs"))
            doc = np.repeat(np.arange(len(table)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
            term, tf = terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64)
            value = impacts(tf, table["n"].to_numpy()[doc], weights[term], documents, length)
            some = value > 0
            treap = K2Treap(term[some], doc[some], value[some])
            ids = table["doc_id"]
            for item, rows in enumerate(asked):
                at, score = treap.best(rows, k, best[item].floor())
                best[item].add(score, ids.take(pa.array(at)).to_pylist())
        item = np.repeat(np.arange(len(asked)), [len(b.rows) for b in best])
        rows = [r for b in best for r in b.rows]
        yield pa.record_batch([
            pa.array(item.astype(np.int32)), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.int64()),
        ], names=["item", "doc_id", "score"])

    return search


def _block(docs: DataFrame, items: list[Row], k: int) -> DataFrame:
    spark = docs.sparkSession
    words = Words(pa.array([r.text or "" for r in items], pa.large_string()), SEPARATORS)
    terms = words.words.to_pylist()
    held = stage(postings(docs, terms), "postings")
    size = held.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
    weights = np.zeros(len(terms), np.int64)
    for row in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row per term of the block
        weights[row.term] = math.floor(1000 * math.log((2 * size.documents + 2) / (2 * row["count"] + 1)))
    asked = [np.unique(words.number[words.text == i]).astype(np.int64) for i in range(len(items))]
    search = search_ranges(weights, asked, size.documents, size.length or 1, k)
    found = top_n_per_key(
        held.filter("size(terms) > 0").mapInArrow(search, "item int, doc_id long, score long"), ["item"], _order(), k)
    named = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(items)], "item int, item_id long")
    return found.join(named, "item").selectExpr(
        "item_id", "cast(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST) AS int) AS rank",
        "doc_id", "score")


def _order() -> list:
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]


def search(docs: DataFrame, items: DataFrame, k: int = BEST, block: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of docs(doc_id, text) for each of items(item_id, text)."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator()
    blocks = [_block(docs, part, k) for part in iter(lambda: list(itertools.islice(rows, block)), [])]
    if not blocks:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return union_all(*blocks)
