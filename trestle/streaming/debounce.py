"""Debounced syncs: a burst of changes asks for one sync, once nothing has changed for a while."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, keys: list[str], ts: str = "ts", delay: str = "5 seconds", late: str | None = None) -> DataFrame:
    """keys, opened, last_change, changes: a row for each burst; a gap longer than delay starts another. late: the watermark of a stream."""
    events = events if late is None else events.withWatermark(ts, late)
    by = F.session_window(ts, delay)
    return events.groupBy(*keys, by).agg(F.count("*").alias("changes"), F.min(ts).alias("opened"), F.max(ts).alias("last_change")).select(*keys, "opened", "last_change", "changes")
