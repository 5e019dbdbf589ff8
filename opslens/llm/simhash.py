"""SimHash near-duplicates through an inverted index of positional bytes.

Fingerprints of 64 bits link if at most 4 bits differ. Four differing bits touch at most four of the eight
byte positions, so linked fingerprints share at least 8 - 4 positional bytes. A posting list of one
positional byte would hold a 256th of all fingerprints; postings are therefore kept for triples of positions,
taken from a covering family: whichever four positions agree, at least one triple of TRIPLES lies
inside them (tested), so no link is lost. Inside a posting list the shared positional bytes of a pair are
tallied, pairs below the guaranteed minimum are dropped, and the rest is verified by counting bits.

Only distinct fingerprints are indexed, one representative each. A list's links are reduced to a spanning
forest in the task that finds them, so output grows with the members of a list, not with their pairs.
Lists above `block` members are cut into blocks, and each pair of blocks is a group of its own.

A text without words has fingerprint zero and links like any other; null is such a text. Repeated rows share
a fingerprint. Rows that repeat a doc_id with an unlike text are documents of their own. Rows with a null doc_id
get a fingerprint, which links like any other, and no component (null). Other columns play no part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.functions.merging import union_all
from opslens.llm.components import smallest_reachable
from opslens.session import stage

SHINGLE = 4
MAX_BITS = 4
BLOCK = 4096
BYTE_AT = 256 * np.arange(8)
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def covering_triples() -> list[tuple[int, int, int]]:
    """Triples of 8 byte positions such that any four positions contain one of them.

    Positions fall into three classes in a circle; a triple counts if it lies in one class, or has two
    positions in a class and one in the next.
    """
    kind = [p % 3 for p in range(8)]
    out = []
    for t in itertools.combinations(range(8), 3):
        n = [sum(kind[p] == k for p in t) for k in range(3)]
        if 3 in n or any(n[k] == 2 and n[(k + 1) % 3] == 1 for k in range(3)):
            out.append(t)
    return out


TRIPLES = covering_triples()


def fingerprint(text: str | None) -> int:
    """Majority bits of the XXH64 values (seed 42) of the text's word shingles; unsigned."""
    tokens = (text or "").encode().translate(LOWER).split()
    if not tokens:
        return 0
    flat = b" ".join(tokens)
    if len(tokens) <= SHINGLE:
        return xxhash.xxh64_intdigest(flat, seed=42)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    stops = (ends[SHINGLE - 1:] - 1).tolist()
    digest = xxhash.xxh64_digest
    seen = np.zeros(8 * 256, np.int64)  # how often each value stands in each byte of the hashes
    n = len(stops)
    for i in range(0, n, 65536):
        raw = b"".join([digest(flat[a:b], 42) for a, b in zip(starts[i:i + 65536], stops[i:i + 65536])])
        seen += np.bincount((np.frombuffer(raw, np.uint8).reshape(-1, 8) + BYTE_AT).ravel(), minlength=8 * 256)
    ones = seen.reshape(8, 256) @ BITS
    return int(np.packbits(2 * ones.ravel() > n).view(">u8")[0])


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), fp (the fingerprint as a signed long), computed where documents are read."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_key"), pa.array(fps)], names=["doc_id", "text_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(batches, "doc_id long, text_key long, fp long")


def _forest(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Join the trees of linked members; roots are the smallest member indices."""
    for a, b in zip(left.tolist(), right.tolist()):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            parent[max(a, b)] = min(a, b)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return up
        parent = up


def spanning_links(group: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Member indices and their roots, for members that are not roots. group is sorted."""
    parent = np.arange(len(fps))
    root = parent
    here = parent
    step = 1
    while True:
        here = here[here + step < len(fps)]
        here = here[group[here] == group[here + step]]
        if not len(here):
            break
        near = here[root[here] != root[here + step]]
        x = (fps[near] ^ fps[near + step]).view(np.uint64)  # bits of a negative number are not counted
        shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        tallied = shared >= 8 - MAX_BITS
        near, x = near[tallied], x[tallied]
        near = near[np.bitwise_count(x) <= MAX_BITS]
        if len(near):
            _forest(parent, near, near + step)
            root = _roots(parent)
        step += 1
    child = np.flatnonzero(root != np.arange(len(fps)))
    return child, root[child]


def postings(fps: DataFrame, block: int) -> DataFrame:
    """list, part, fp: every fingerprint under its triples; long lists once per pair of blocks."""
    byte = [F.shiftright("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    keys = F.array(*[
        F.lit(k << 24) + F.shiftleft(byte[a], 16) + F.shiftleft(byte[b], 8) + byte[c]
        for k, (a, b, c) in enumerate(TRIPLES)
    ])
    rows = fps.select("fp", F.explode(keys).alias("list"))
    long_lists = rows.groupBy(F.col("list").alias("_list")).count().filter(F.col("count") > block).select(
        "_list", F.ceil(F.col("count") / block).cast("int").alias("_n"))
    joined = rows.join(long_lists, F.col("list") == F.col("_list"), "left")
    own = F.pmod(F.xxhash64("fp"), F.col("_n")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda o: F.least(own, o) * F.col("_n") + F.greatest(own, o))
    return joined.select("list", "fp", F.explode(F.when(F.col("_n").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("part"))


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b: links between fingerprints that connect all that are within MAX_BITS of each other."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def solve(rows: list[np.ndarray]) -> pa.RecordBatch:
            keys, part, fp = (np.concatenate(x) for x in zip(*rows))
            turn = np.flatnonzero((keys[1:] != keys[:-1]) | (part[1:] != part[:-1])) + 1
            group = np.zeros(len(keys), np.int64)
            group[turn] = 1
            child, root = spanning_links(np.cumsum(group), fp)
            return pa.record_batch([pa.array(fp[child]), pa.array(fp[root])], names=["a", "b"])

        for batch in stream:
            keys, part, fp = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("list", "part", "fp"))
            if not len(keys):
                continue
            last = np.flatnonzero((keys != keys[-1]) | (part != part[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
            if kept and (cut or kept[-1][0][-1] != keys[-1] or kept[-1][1][-1] != part[-1]):
                yield solve([*kept, (keys[:cut], part[:cut], fp[:cut])])
                kept = []
            elif cut:
                yield solve([(keys[:cut], part[:cut], fp[:cut])])
            kept.append((keys[cut:], part[cut:], fp[cut:]))
        if kept:
            yield solve(kept)

    dealt = postings(fps, block).repartition("list", "part").sortWithinPartitions("list", "part", "fp")
    return dealt.select("list", "part", "fp").mapInArrow(batches, "a long, b long").distinct()


def components(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, text_key, fp, node, component_id: the smallest doc_id that a document reaches by links, itself included.

    Links join fingerprints, so rows that repeat a doc_id with an unlike text stay apart: such components may
    have the same component_id, but differ in `node`, their smallest fingerprint.
    """
    prints = stage(with_fingerprint(docs), "fingerprints")
    first = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-heads")
    root = smallest_reachable(links(first.select("fp"), block)).select(F.col("node").alias("_fp"), F.col("root").alias("_root"))
    linked = first.join(root, F.col("fp") == F.col("_fp")).select("fp", "_root", "first")
    named = linked.groupBy(F.col("_root").alias("_node")).agg(F.min("first").alias("_id"))
    heads = linked.join(named, F.col("_root") == F.col("_node")).select(F.col("fp").alias("_fp"), "_node", "_id")
    alone = first.join(heads, F.col("fp") == F.col("_fp"), "left_anti").select(
        F.col("fp").alias("_fp"), F.col("fp").alias("_node"), F.col("first").alias("_id"))
    return prints.join(union_all(heads, alone), F.col("fp") == F.col("_fp")).select(
        "doc_id", "text_key", "fp", F.col("_node").alias("node"),
        F.when(F.col("doc_id").isNotNull(), F.col("_id")).alias("component_id"))


def digest(docs: DataFrame) -> DataFrame:
    return components(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def apply(docs: DataFrame) -> DataFrame:
    """One row of each component: that of the smallest doc_id, and of its texts in the component the smallest.

    Rows with a null doc_id belong to no component and stay.
    """
    heads = components(docs).filter("doc_id = component_id").select(
        F.col("component_id").alias("_head"), F.col("text_key").alias("_key"), F.col("node").alias("_node")).distinct()
    same = (F.col("doc_id") == F.col("_head")) & (F.xxhash64("text") == F.col("_key"))
    order = F.struct("text", F.xxhash64(*docs.columns))
    kept = docs.join(heads, same).groupBy("_head", "_node").agg(F.min_by(F.struct(*docs.columns), order).alias("_row"))
    return union_all(kept.select("_row.*"), docs.filter(F.col("doc_id").isNull()))
