"""Window de-duplication of an event history (A-05).

A row is dropped if it is at most W seconds newer than the last *kept* row of its fingerprint. That
is a greedy chain: which rows survive depends on all kept rows before them. Three facts keep it
from being one sequential walk per fingerprint:

1. A row not newer than every earlier row of its fingerprint is never kept. (The newest earlier
   row was either kept, or lay within W of a kept one.) What remains grows in arrival order and in
   time at once.
2. A remaining row more than W after its predecessor is always kept, so the chain restarts there.
   The rows from one restart to the next form an island; islands are independent.
3. In an island cut into chunks of rows, the chain inside a chunk depends on the chunks before only
   through the last kept time. Each chunk is therefore a monotone step function: last kept time before it
   -> last kept time after it.

Keys with few rows need none of this: their rows are sorted once, in one shuffle, where a window finds the restarts and an
island is folded as one array in the JVM. Which keys have many rows comes from counts per 64-bit hash of the key; keys that
share a hash only go the longer way together.

The rows of the others are spread out however many one key has. Short islands are folded as one sorted array in the JVM, long
ones are cut into chunks of at most CHUNK_ROWS rows. The step functions of FANOUT neighbouring chunks are composed into one, those of FANOUT such groups
again, and so on up to one group per island; on the way down each group hands its children the last kept time before them.
A function only has steps for the rows of one window, so a task holds FANOUT times the rows of a window at most.
Then all chunks are walked at the same time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opslens.functions.merging import union_all
from opslens.functions.ranking import BLOCK_ROWS, never_null, running
from opslens.session import ship, stage

ship(__name__)

SHORT_ISLAND_ROWS = 2_000
CHUNK_ROWS = 1 << 16
FANOUT = 16
NEVER = -(1 << 62)  # nothing was kept before
SLICE = 256

MAP = "fp string, island bigint, node bigint, begin bigint, entry bigint, last bigint"
BEFORE = "fp string, island bigint, node bigint, before bigint"


def _islands(rows: DataFrame, window_us: int, block_rows: int) -> DataFrame:
    """(fp, seq, t) rows that may be kept, each with the start time of its island and its place among those of its key."""
    newest = running(
        rows, "fp", "seq", {"prev": ("max", F.col("t"))}, include_current=False, block_rows=block_rows
    )
    growing = newest.filter(_grows())
    start = F.when(_restarts(window_us), F.col("t"))
    specs = {"island": ("max", start), "place": ("sum", F.lit(1).cast("long"))}
    return running(growing, "fp", "seq", specs, block_rows=block_rows).drop("prev")


def _grows() -> Column:
    return F.col("prev").isNull() | (F.col("t") > F.col("prev"))


def _restarts(window_us: int) -> Column:
    return F.col("prev").isNull() | (F.col("t") - F.col("prev") > window_us)


def _fold(rows: Column, window_us: int, before: Column | None = None) -> Column:
    """Sorted array of (t, seq), and the last kept time before it, if any -> array of the kept seq.

    Goes by slices, as a growing array is copied with each row that is kept.
    """
    last = F.lit(None).cast("long") if before is None else before

    def step(state, row):
        keep = state["last"].isNull() | (row["t"] - state["last"] > window_us)
        return F.when(
            keep,
            F.struct(
                row["t"].alias("last"),
                F.concat(state["kept"], F.array(row["seq"])).alias("kept"),
            ),
        ).otherwise(state)

    def part(state, i):
        start = F.struct(state["last"].alias("last"), F.array().cast("array<bigint>").alias("kept"))
        return F.aggregate(
            F.slice(rows, i * SLICE + 1, SLICE), start, step,
            lambda one: F.struct(one["last"].alias("last"), F.concat(state["kept"], F.array(one["kept"])).alias("kept")),
        )

    start = F.struct(last.alias("last"), F.array().cast("array<array<bigint>>").alias("kept"))
    slices = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / F.lit(SLICE)).cast("int"))
    return F.aggregate(slices, start, part, lambda state: F.flatten(state["kept"]))


def _of_small_keys(rows: DataFrame, window_us: int) -> DataFrame:
    """(seq) kept rows of keys that have few rows each: one shuffle by key, a window over each."""
    order = W.partitionBy("fp").orderBy("seq")
    newest = rows.withColumn("prev", F.max("t").over(order.rowsBetween(W.unboundedPreceding, -1))).filter(_grows())
    marked = newest.withColumn("restart", _restarts(window_us))
    island = F.max(F.when(F.col("restart"), F.col("t"))).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    marked = marked.withColumn("island", island)
    # the first row of an island is kept, what follows it within the window is up to the chain
    follow = (
        marked.filter(~F.col("restart"))
        .groupBy("fp", "island")
        .agg(F.sort_array(F.collect_list(F.struct("t", "seq"))).alias("rows"))
        .select(F.explode(_fold(F.col("rows"), window_us, F.col("island"))).alias("seq"))
    )
    return union_all(marked.filter("restart").select("seq"), follow)


def _shortest(entry: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries that lead to the same last row only the latest is needed."""
    keep = np.append(last[1:] != last[:-1], True)[: len(last)]
    return entry[keep], last[keep]


def steps(t: np.ndarray, window_us: int) -> tuple[np.ndarray, np.ndarray]:
    """The step function of a chunk with the sorted times t: (entry, last).

    A chain enters at the first row after (last kept before) + W and then keeps `last` last. It enters no later than at
    the first row more than W after the chunk's first one. If even the last entry is too early, nothing is kept.
    """
    follow = np.searchsorted(t, t + window_us, side="right")
    last = t.copy()
    for i in range(len(t) - 1, -1, -1):
        if follow[i] < len(t):
            last[i] = last[follow[i]]
    entries = min(len(t), int(np.searchsorted(t, t[0] + window_us, side="right")) + 1)
    return _shortest(t[:entries], last[:entries])


def passed(entry: np.ndarray, last: np.ndarray, before: np.ndarray, window_us: int) -> np.ndarray:
    """The last kept times after a chunk, given those before it."""
    at = np.searchsorted(entry, before + window_us, side="right")
    return np.where(at < len(entry), last[np.minimum(at, len(entry) - 1)], before)


def composed(
    begin: int, first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray], window_us: int
) -> tuple[np.ndarray, np.ndarray]:
    """The step function of a chunk that begins at `begin` and of the one after it, as one."""
    entry, last = first[0], passed(*then, first[1], window_us)
    if entry[-1] <= begin + window_us:  # a chain may still be silent through all of the first one
        some = int(np.searchsorted(then[0], begin + window_us, side="right")) + 1
        entry, last = np.append(entry, then[0][:some]), np.append(last, then[1][:some])
    return _shortest(entry, last)


def _children(pdf: pd.DataFrame) -> list[tuple[int, int, tuple[np.ndarray, np.ndarray]]]:
    """node, begin and step function of the nodes in a group, in order."""
    pdf = pdf.sort_values(["node", "entry"])
    node, entry, last = (pdf[c].to_numpy(np.int64) for c in ("node", "entry", "last"))
    begin = pdf["begin"].to_numpy(np.int64)
    cut = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    return [(int(node[i]), int(begin[i]), (entry[i:j], last[i:j])) for i, j in zip(cut, np.append(cut[1:], len(node)))]


def _chunk_map(window_us: int):
    """Rows of one (fp, island, node) -> its step function."""

    def table(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["t"].to_numpy(np.int64))
        entry, last = steps(t, window_us)
        return pd.DataFrame({"fp": key[0], "island": key[1], "node": key[2], "begin": t[0], "entry": entry, "last": last})

    return table


def _join_maps(window_us: int):
    """Step functions of one group of nodes -> the group's."""

    def table(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        (_, begin, whole), *rest = _children(pdf)
        for _, _, one in rest:
            whole = composed(begin, whole, one, window_us)
        return pd.DataFrame({
            "fp": key[0], "island": key[1], "node": key[2], "begin": begin, "entry": whole[0], "last": whole[1]})

    return table


def _hand_down(window_us: int):
    """Step functions of one group of nodes, and the last kept time before the group, if any -> that before each node."""

    def sweep(key: tuple, maps: pd.DataFrame, before: pd.DataFrame | None = None) -> pd.DataFrame:
        kept = np.array([NEVER if before is None else before["before"].iloc[0]], np.int64)
        nodes, out = [], []
        for node, _, one in _children(maps):
            nodes.append(node)
            out.append(int(kept[0]))
            kept = passed(*one, kept, window_us)
        return pd.DataFrame({"fp": key[0], "island": key[1], "node": nodes, "before": out})

    return sweep


def _chunk_walk(window_us: int):
    """Rows of one chunk and the last kept time before it -> the kept rows."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t = pdf["t"].to_numpy(np.int64)
        i = int(np.searchsorted(t, pdf["before"].iloc[0] + window_us, side="right"))
        kept = []
        while i < len(t):
            kept.append(i)
            i = int(np.searchsorted(t, t[i] + window_us, side="right"))
        return pdf.iloc[kept][["seq"]]

    return walk


def _before_each(maps: DataFrame, nodes: int, window_us: int, fanout: int) -> DataFrame:
    """The last kept time before each node: up the tree by composition, down again by application."""
    group = ["fp", "island", F.expr(f"node div {fanout} AS up")]
    if nodes <= fanout:  # one group per island, nothing before it
        return maps.groupBy(*group).applyInPandas(lambda key, pdf: _hand_down(window_us)(key, pdf), BEFORE)
    maps = stage(maps, "dedup-steps")
    parents = maps.groupBy(*group).applyInPandas(_join_maps(window_us), MAP)
    above = _before_each(parents, -(-nodes // fanout), window_us, fanout).groupBy("fp", "island", "node")
    return maps.groupBy(*group).cogroup(above).applyInPandas(_hand_down(window_us), BEFORE)


def kept_rows(
    events: DataFrame,
    window_sec: float = 300,
    key: str = "fingerprint",
    *,
    short_island_rows: int = SHORT_ISLAND_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    fanout: int = FANOUT,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(seq) the numbers of the events that dedup_events keeps, under the same conditions."""
    window_us = int(window_sec * 1_000_000)
    # read by the branches below, hence written once
    rows = stage(
        events.select(
            F.col(key).alias("fp"), never_null("seq").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t")
        ),
        "dedup-rows",
    ).withColumn("hash", F.xxhash64("fp"))
    counts = rows.groupBy("hash").agg(F.count("*").alias("n"))
    # a row per large_rows rows at most
    large_rows = max(short_island_rows, chunk_rows // 4)
    large = stage(counts.filter(F.col("n") > large_rows).select("hash"), "dedup-large-keys")
    if large.isEmpty():
        return _of_small_keys(rows.drop("hash"), window_us)
    small = _of_small_keys(rows.join(large, "hash", "left_anti").drop("hash"), window_us)
    spread = rows.join(large, "hash", "left_semi").drop("hash")

    group = ["fp", "island", "chunk"]
    # rows of an island grow in seq and in time and have consecutive places, so a chunk is a stretch of all three
    islands = stage(
        _islands(spread, window_us, block_rows).withColumn("chunk", F.expr(f"(place - 1) div {chunk_rows}")).drop("place"),
        "dedup-islands",
    )
    # island sizes by way of chunk sizes: joined back per chunk, so that a long island stays spread out
    chunks = islands.groupBy(*group).agg(F.count("*").alias("n"))
    sizes = chunks.groupBy("fp", "island").agg(F.sum("n").alias("size"))
    long_chunks = chunks.join(sizes.filter(F.col("size") > short_island_rows), ["fp", "island"], "left_semi")
    # a row per chunk_rows rows of an island meets in this window
    place = F.row_number().over(W.partitionBy("fp", "island").orderBy("chunk")) - 1
    numbered = stage(long_chunks.select(*group, place.cast("long").alias("node")), "dedup-chunks")

    # rows of a short island meet in one array of at most short_island_rows entries
    short = (
        islands.join(numbered, group, "left_anti")
        .groupBy("fp", "island")
        .agg(F.sort_array(F.collect_list(F.struct("t", "seq"))).alias("rows"))
        .select(F.explode(_fold(F.col("rows"), window_us)).alias("seq"))
    )
    most = numbered.agg(F.max("node")).first()[0]
    if most is None:
        return union_all(small, short)
    long = islands.join(numbered, group).drop("chunk")
    node = ["fp", "island", "node"]
    before = _before_each(long.groupBy(*node).applyInPandas(_chunk_map(window_us), MAP), most + 1, window_us, fanout)
    walked = long.join(before, node).groupBy(*node).applyInPandas(_chunk_walk(window_us), "seq bigint")
    return union_all(small, short, walked)


def dedup_events(events: DataFrame, window_sec: float = 300, key: str = "fingerprint", **sizes: int) -> DataFrame:
    """Drop repeats of an event that follow the last kept one within window_sec seconds.

    Needs unique arrival numbers in `seq` (a null is an error), times in `ts` and the identity of a row in `key` (not null).
    Runs jobs when called: it writes key, number and time of all rows to the shared folder, and of keys with many rows those
    that may be kept and, if an island is longer than short_island_rows, the step functions of each level of the tree.
    sizes: those of kept_rows.
    """
    return events.join(kept_rows(events, window_sec, key, **sizes), "seq", "left_semi")
