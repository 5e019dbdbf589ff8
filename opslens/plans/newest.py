"""The reduced table that the analytics of all assets share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from opslens.functions.ranking import latest_per_asset
from opslens.schemas import EVENT_COLUMNS
from opslens.session import stage


def newest_events(events: DataFrame, n: int | None) -> DataFrame:
    """The newest n events of every asset, written to the shared folder once.

    Several branches of an analysis read it. The raw events are scanned once, and what comes after
    works on at most n rows per asset, so the branches need no salting (salt=1). None is the whole history,
    which is not copied.
    """
    columns = [c for c in events.columns if c in EVENT_COLUMNS]
    if n is None:
        return events.select(*columns)
    return stage(latest_per_asset(events.select(*columns), n), "newest-events")
