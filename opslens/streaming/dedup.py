"""Window de-duplication of an endless event stream (A-06)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from opslens.functions.ranking import never_null
from opslens.session import ship

ship(__name__)

NEVER = -(1 << 62)  # nothing was kept before


def kept_positions(times: np.ndarray, last: int | None, window_us: int) -> tuple[list[int], int | None]:
    """Positions kept by the chain over times in arrival order, and the last kept time."""
    ahead = np.maximum.accumulate(times) if len(times) else times
    kept, at = [], 0
    while at < len(times):
        if last is not None:
            # the running maximum first exceeds last + W at the row the chain keeps next
            at = max(at, int(np.searchsorted(ahead, last + window_us, side="right")))
            if at >= len(times):
                break
        last = int(times[at])
        kept.append(at)
        at += 1
    return kept, last


def rising(seq: np.ndarray, times: np.ndarray, floor: int) -> np.ndarray:
    """Positions, by seq, of the times above floor and above all times before them; no other row can be kept."""
    order = np.argsort(seq, kind="stable")
    t = times[order]
    before = np.concatenate([[floor], np.maximum.accumulate(t)[:-1]]) if len(t) else t
    return order[t > np.maximum(before, floor)]


class FirstOfWindow(StatefulProcessor):
    """Keeps the rows of one fingerprint that the chain keeps; state is the last kept time."""

    def __init__(self, window_us: int, releases: bool):
        self.window_us, self.releases = window_us, releases

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last_kept", "last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        floor = NEVER if last is None else last + self.window_us
        # of each frame only the rows that may be kept are held, and of those only what later frames leave
        frames: list[pd.DataFrame] = []
        seq, times, frame, place = (np.empty(0, np.int64) for _ in range(4))
        for number, some in enumerate(rows):
            s, t = some["arrival"].to_numpy(np.int64), some["micros"].to_numpy(np.int64)
            found = rising(s, t, floor)
            frames.append(some[["event"]].iloc[found])
            seq, times = np.concatenate([seq, s[found]]), np.concatenate([times, t[found]])
            frame = np.concatenate([frame, np.full(len(found), number, np.int64)])
            place = np.concatenate([place, np.arange(len(found), dtype=np.int64)])
            left = rising(seq, times, floor)
            seq, times, frame, place = seq[left], times[left], frame[left], place[left]
        kept, now = kept_positions(times, last, self.window_us)
        if not kept:
            return
        self.last.update((now,))
        if self.releases:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((now + self.window_us) // 1000 + 1)
        for number in np.unique(frame[kept]):
            yield frames[number].iloc[[place[i] for i in kept if frame[i] == number]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def dedup_stream(
    events: DataFrame, window_sec: float = 300, key: str = "fingerprint", *, late: str | None = None
) -> DataFrame:
    """Drop repeats within window_sec seconds of the last kept event of the same fingerprint.

    Needs the RocksDB state store (session.tune sets it). State is one number per fingerprint and survives restarts
    with the checkpoint. Rows of one batch are taken in seq order; a null seq or ts is an error. A task holds only
    those rows of a fingerprint that are newer than all before them, not all that a batch brings.

    Without `late` state stays for ever, and a row of any age meets the last kept time. With it ("2 days") rows
    further behind the newest event are dropped, and the state of a fingerprint is released as soon as no row that
    is still taken can lie within window_sec of it; which rows are kept is the same for all that are not too late.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    seen = events if late is None else events.withWatermark("ts", late)
    # the event travels as one struct: as columns of a frame, whole numbers beside nulls would turn to doubles
    keyed = seen.select(
        F.col(key).alias("identity"), never_null("seq").alias("arrival"), micros.alias("micros"), "ts",
        F.struct(*events.columns).alias("event"),
    ).withColumn("micros", never_null("micros"))
    step = FirstOfWindow(int(window_sec * 1_000_000), late is not None)
    kept = keyed.groupBy("identity").transformWithStateInPandas(
        step, keyed.select("event").schema, "append", "None" if late is None else "EventTime"
    )
    return kept.select("event.*")
