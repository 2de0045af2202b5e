"""Zone entries and exits of a stream: the last flag of each vessel is state.

Each micro-batch sorts a vessel's points in time; points older than the last one seen
are dropped, since the state that they belong to has passed. For points that come in
order, the events equal those of the batch path. Where points come late, use
:mod:`wakeflow.streaming.tracks`. A vessel's flag may be forgotten after a silence, so that
state does not grow with vessels that never come back; its next point is then its first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wakeflow.operators.geofence import BOUNDARY_SCHEMA


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, forget_minutes: float | None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    inside, seen = state.get if state.exists else (None, None)
    rows = pd.concat(list(frames)).sort_values("timestamp", kind="stable")
    if seen is not None:
        rows = rows[rows["timestamp"].astype("int64") // 1000 >= seen] if rows["timestamp"].dtype == "datetime64[ns]" else rows[rows["timestamp"].astype("int64") >= seen]
    if rows.empty:
        return
    flag = rows["inside_eez"].astype(bool)
    before = flag.shift(1)
    before.iloc[0] = inside
    moved = before.notna() & (before.astype(object) != flag.astype(object))
    last = rows["timestamp"].iloc[-1]
    state.update((bool(flag.iloc[-1]), int(last.value // 1000)))
    if forget_minutes:
        state.setTimeoutDuration(max(1, int(forget_minutes * 60_000)))
    if moved.any():
        yield pd.DataFrame({"event_type": flag[moved].map({True: "EEZ entry", False: "EEZ exit"}), "event_timestamp": rows["timestamp"][moved], "mmsi": key[0]})


def boundary_stream(classified: DataFrame, forget_minutes: float | None = None) -> DataFrame:
    """Transitions of a streaming table of MMSI, timestamp, inside_eez; a vessel without points for ``forget_minutes`` of the clock is forgotten."""
    rows = classified.select("MMSI", "timestamp", "inside_eez")
    step = lambda key, frames, state: _step(key, frames, state, forget_minutes)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget_minutes else GroupStateTimeout.NoTimeout
    return rows.groupBy("MMSI").applyInPandasWithState(step, BOUNDARY_SCHEMA, "inside boolean, seen long", "append", timeout)
