"""MinHash document fingerprints and near-duplicates.

A text's shingles are its runs of five words (all its words if it has fewer), hashed to 32 bits. A signature
has one minimum for each of PERMUTATIONS universal hash permutations a*x + b modulo 2**32 (a odd), computed
in numpy over many documents at once; 16 bits of each minimum are kept. The share of equal entries
estimates the Jaccard likeness of two shingle sets, with a standard error of at most 0.032.

Near-duplicates: signatures are cut into bands, equal bands meet in Spark, and exact Jaccard
likeness of the shingle sets verifies every candidate link. Equal texts are one representative from the start.

A null text is an empty one. A text without words has no shingles: its signature is all ones (ffff), like
that of every other such text, and their likeness is 1. Repeated rows get equal signatures. Rows order by
doc_id with null first, then text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.functions.merging import union_all
from opslens.llm import hashing
from opslens.llm.common import shuffle_partitions, whole
from opslens.llm.components import smallest_reachable
from opslens.session import stage

SHINGLE = 5
PERMUTATIONS = 256
BANDS, BAND_ROWS = 64, 4  # a pair of likeness 0.8 shares no band with a probability of 2.3e-15
SIMILAR = 0.8
EMPTY = np.uint16(0xFFFF)
STEP = 4096


def permutations(count: int = PERMUTATIONS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    a = draw.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1)
    return a[:, None], draw.integers(0, 1 << 32, count, dtype=np.uint32)[:, None]


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all texts' shingles in order, and how many each text has."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    at, words = hashing.word_hashes(data)
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    first = np.searchsorted(at, begins)
    n_words = np.diff(first)
    n = np.where(n_words < SHINGLE, np.minimum(n_words, 1), n_words - SHINGLE + 1)
    owner = np.repeat(np.arange(len(texts)), n)
    start = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    stop = first[owner + 1]
    total = np.zeros(len(owner), np.uint64)
    for k in range(SHINGLE):
        here = start + k
        inside = here < stop
        total[inside] += words[here[inside]] * np.uint64((2 * k + 3) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 | 1)
    return hashing.mix(total), n


def signatures(texts: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One row of 16-bit entries per text."""
    out = np.full((len(texts), len(a)), EMPTY, np.uint16)
    for i, j in hashing.text_groups(texts):
        hashes, n = shingle_hashes(texts[i:j])
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        some = np.flatnonzero(n)
        if not len(some):
            continue
        low = np.full((len(a), len(some)), 0xFFFFFFFF, np.uint32)
        edge = np.concatenate(([0], np.cumsum(n[some])))
        work = np.empty((len(a), STEP), np.uint32)
        for s in range(0, len(x), STEP):
            e = min(len(x), s + STEP)
            v = work[:, : e - s]
            np.multiply(a, x[None, s:e], out=v)
            np.add(v, b, out=v)
            k = np.searchsorted(edge, s, "right") - 1
            m = np.searchsorted(edge, e, "left")
            cuts = np.maximum(edge[k:m], s) - s
            np.minimum(low[:, k:m], np.minimum.reduceat(v, cuts, axis=1), out=low[:, k:m])
        out[i + some] = low.T.astype(np.uint16)
    return out


def likeness(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left == right).mean(axis=1)


def as_text(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows.astype(">u2")]


def edited_with(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def block_starts(docs: DataFrame, blocks: int) -> list[int]:
    """Ascending doc_ids, at most `blocks`, that cut the rows into blocks of about equal counts."""
    cuts = [i / blocks for i in range(blocks)]
    found = docs.select(F.percentile_approx("doc_id", cuts, 10000).alias("at")).first()["at"]
    return sorted(set(found or []))


def in_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """doc_id, text, block, tail: rows of ascending blocks of doc_id; each block also holds the row after it.

    Blocks begin at doc_ids that occur, so the row after a block is the first of the next (after the last:
    the first of all), and only such rows are copied.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    starts = block_starts(docs, blocks)
    lowest = rows.agg(F.min(F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"))).alias("low")).first()["low"]
    heads = ([None] if lowest is not None and lowest["doc_id"] is None else []) + starts
    n = max(1, len(starts))
    begin = np.array(starts, np.int64)

    @F.arrow_udf("int")
    def block_of(ids: pa.Array) -> pa.Array:
        found = np.searchsorted(begin, ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False), "right") - 1
        return pa.array(np.maximum(found, 0).astype(np.int32))

    def copies(block):
        own = F.struct(block.alias("block"), F.lit(False).alias("tail"))
        before = F.struct(F.pmod(block - 1, F.lit(n)).alias("block"), F.lit(True).alias("tail"))
        head = F.col("doc_id").isNull() if heads and heads[0] is None else F.lit(False)
        at = heads[1:] if heads and heads[0] is None else heads
        if heads and heads[0] is None:
            at = at[1:]  # rows without an id open the first block
        head = head | F.col("doc_id").isin(at) if at else head
        return F.explode(F.when(F.coalesce(head, F.lit(False)), F.array(own, before)).otherwise(F.array(own)))

    marked = rows.withColumn("_block", block_of(F.col("doc_id"))).withColumn("_copy", copies(F.col("_block")))
    flat = marked.select("doc_id", "text", "_copy.block", "_copy.tail")
    return flat.repartitionById(n, F.col("block")).sortWithinPartitions("block", "tail", F.col("doc_id").asc_nulls_first(), "text")


def digest(docs: DataFrame, count: int = PERMUTATIONS) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and the likeness to that and to the next's."""
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")

    def solve(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Rows for all but the last text, which follows them."""
        a, b = permutations(count)
        edited = [edited_with(t, u).encode() for t, u in zip(texts, texts[1:])]
        own = signatures([t.encode() for t in texts], a, b)
        new = signatures(edited, a, b)
        return pa.record_batch([
            pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
            pa.array(as_text(own[:-1]), pa.string()), pa.array(as_text(new), pa.string()),
            pa.array(likeness(own[:-1], new)), pa.array(likeness(own[:-1], own[1:])),
        ], names=[f.split()[0] for f in schema.split(", ")])

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, block, closed = [], [], None, False
        for batch in stream:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                for i, t, k, tail in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "block", "tail"))):
                    if k != block:
                        ids, texts, block, closed = [], [], k, False
                    if closed:
                        continue  # another row of the next block's first doc_id
                    ids.append(i)
                    texts.append(t)
                    if tail:
                        closed = True
                        yield solve(ids, texts)
                if len(texts) > 1 and not closed:
                    yield solve(ids, texts)
                    ids, texts = ids[-1:], texts[-1:]

    blocks = in_blocks(docs, shuffle_partitions(docs.sparkSession))
    return blocks.mapInArrow(batches, schema)


def shingled(docs: DataFrame, count: int = PERMUTATIONS) -> DataFrame:
    """doc_id, sig (16-bit entries as binary), shingles (sorted distinct 64-bit hashes)."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations(count)
        for batch in stream:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [(t or "").encode() for t in part.column("text").to_pylist()]
                hashes, n = shingle_hashes(texts)
                sets = [np.unique(h).view(np.int64) for h in np.split(hashes, np.cumsum(n)[:-1])]
                yield pa.record_batch([
                    part.column("doc_id"), pa.array([r.tobytes() for r in signatures(texts, a, b)], pa.binary()),
                    pa.array(sets, pa.list_(pa.int64())),
                ], names=["doc_id", "sig", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(batches, "doc_id long, sig binary, shingles array<long>")


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id: the smallest doc_id that a document reaches by links of at least `similar`.

    Links are looked for between representatives of different shingle sets. In a band's bucket every
    member is first held against the smallest one. Only members that are not like it are then held against all
    the others, so a group of copies costs its members. Bands are the only source of candidates: a pair of likeness
    s shares none of them, and may be missed, with a probability of (1 - s**BAND_ROWS)**BANDS, which is below
    1e-14 at 0.8. Candidates are verified exactly.
    Rows with a null doc_id are left out.
    """
    every = stage(shingled(docs.filter(F.col("doc_id").isNotNull())), "shingles")
    key = F.sha2(F.concat_ws(",", F.col("shingles").cast("array<string>")), 256)
    heads = stage(every.groupBy(key.alias("key")).agg(
        F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("shingles").alias("shingles")), "shingle-sets")
    member = every.select("doc_id", key.alias("key"))
    width = 2 * BAND_ROWS
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("sig", k * width + 1, width)) for k in range(BANDS)])
    rows = heads.select("id", F.explode(bands).alias("band"))
    smallest = rows.groupBy("band").agg(F.min("id").alias("head"), F.count("*").alias("n")).filter("n > 1")
    to_head = stage(rows.join(smallest, "band").filter("id <> head").select("band", "head", "id"), "bucket-heads")

    sets = heads.select("id", "shingles")

    def checked(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("_x"))
        right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("_y"))
        both = F.size(F.array_intersect("_x", "_y"))
        return pairs.join(left, "a").join(right, "b").select(
            "a", "b", (both >= similar * (F.size("_x") + F.size("_y") - both)).alias("near"))

    first = stage(checked(to_head.select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()), "head-links")
    other = to_head.join(first.filter(~F.col("near")), (F.col("head") == F.col("a")) & (F.col("id") == F.col("b"))).select("band", "id")
    rest = other.join(to_head.select("band", F.col("id").alias("b")), "band").filter("id <> b").select(
        F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
    found = union_all(first, checked(rest)).filter("near").select("a", "b")
    root = smallest_reachable(found)
    named = heads.select("key", F.col("id").alias("_id")).join(root, F.col("_id") == F.col("node"), "left").select(
        "key", F.coalesce("root", "_id").alias("class_id"))
    return member.join(named, "key").select("doc_id", "class_id")
