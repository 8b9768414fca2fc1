"""Streaming variants of the sequential operators, for events that arrive in order of their key's time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def refractory(events: DataFrame, key: str, time: str, gap: int) -> DataFrame:
    """Events (key, time) at least `gap` after the last accepted one of their key. The state of a key is that one time.

    Within a batch events are put in order; an event older than the last accepted one is
    not accepted.
    """

    def run(found: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for t in sorted(t for pdf in batches for t in pdf[time].tolist()):
            if last is None or t - last >= gap:
                kept.append(t)
                last = t
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [found[0]] * len(kept), time: kept})

    schema = f"{key} {dict(events.dtypes)[key]}, {time} long"
    return events.select(key, F.col(time).cast("long").alias(time)).groupBy(key).applyInPandasWithState(run, schema, "last long", "append", GroupStateTimeout.NoTimeout)


def state_counts(events: DataFrame, time: str, state: str, width: str, late: str) -> DataFrame:
    """Counts by state and tumbling window; events later than `late` are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), state).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), state, "n")
