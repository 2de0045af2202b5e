"""Scans over tracks in pieces of time, so that a track of any length is shared by many tasks.

A window over a whole track is one task. Here a track is cut where the clock passes from
one piece to the next; each piece is scanned by itself, and a summary of one row a piece
carries over what its neighbours need: the state before it, or after it. The summaries of
a track, as many as it has pieces, are scanned in order and joined back to their pieces;
rows and summaries are dealt by the same keys, so the rows are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeflow.functions import exprs as X

#: a piece: 60,480 points of a vessel that reports every ten seconds
PIECE_MINUTES = 10_080


def piece(time: str, minutes: int | None = None) -> Column:
    return F.floor(X.micros(time) / F.lit((minutes or PIECE_MINUTES) * 60_000_000)).cast("long")


def previous(rows: DataFrame, key: str, time: str, columns: list[str], into: str, minutes: int | None = None) -> DataFrame:
    """``rows`` with a struct of ``columns`` of the row before in the track of ``key``, by ``time``; null for the first."""
    rows = rows.withColumn("_piece", piece(time, minutes))
    own = Window.partitionBy(key, "_piece").orderBy(time)
    rows = rows.withColumn(into, F.lag(F.struct(*columns)).over(own))
    ends = rows.groupBy(key, "_piece").agg(F.max_by(F.struct(*columns), time).alias("_last"))
    carried = ends.select(key, "_piece", F.lag("_last").over(Window.partitionBy(key).orderBy("_piece")).alias("_carried"))
    return rows.join(carried, [key, "_piece"]).withColumn(into, F.coalesce(into, "_carried")).drop("_piece", "_carried")


def runs(rows: DataFrame, key: str, time: str, flags: list[str], max_gap_minutes: float, minutes: int | None = None, since: Column | None = None) -> DataFrame:
    """``rows`` with run_<flag> for each boolean flag: the number of its run in the track of ``key``; with ``since``, also origin, the time of the track's first row where that holds.

    A run ends where the flag changes or more than ``max_gap_minutes`` pass between rows; a
    track begins as if a row without the flag stood before it.
    """
    since = F.lit(False) if since is None else since
    rows = rows.withColumn("_piece", piece(time, minutes))
    own = Window.partitionBy(key, "_piece").orderBy(time)
    late = lambda now, before: F.coalesce(X.minutes_between(now, before) > max_gap_minutes, F.lit(False))
    # in a piece: its first row is left to the summaries
    inner = {f"_new_{f}": F.coalesce(((F.col(f) != F.lag(f).over(own)) | late(time, F.lag(time).over(own))).cast("int"), F.lit(0)) for f in flags}
    rows = rows.withColumns(inner)
    rows = rows.withColumns({f"_run_{f}": F.sum(f"_new_{f}").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for f in flags})
    ends = rows.groupBy(key, "_piece").agg(
        F.min(time).alias("_first"), F.max(time).alias("_last"),
        *[F.min_by(f, time).alias(f"_first_{f}") for f in flags], *[F.max_by(f, time).alias(f"_last_{f}") for f in flags], *[F.sum(f"_new_{f}").alias(f"_in_{f}") for f in flags],
        F.min(F.when(since, F.col(time))).alias("origin"),
    )
    track = Window.partitionBy(key).orderBy("_piece")
    head = {f"_head_{f}": ((F.col(f"_first_{f}") != F.lag(f"_last_{f}", 1, False).over(track)) | late("_first", F.lag("_last").over(track))).cast("int") for f in flags}
    ends = ends.withColumns(head)
    upto = {f"_base_{f}": F.sum(F.col(f"_head_{f}") + F.col(f"_in_{f}")).over(track.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(f"_in_{f}") for f in flags}
    ends = ends.withColumns(upto).select(key, "_piece", *upto, F.min("origin").over(Window.partitionBy(key)).alias("origin"))
    out = rows.join(ends, [key, "_piece"]).withColumns({f"run_{f}": F.col(f"_base_{f}") + F.col(f"_run_{f}") for f in flags})
    return out.drop("_piece", *[f"{p}_{f}" for f in flags for p in ("_new", "_run", "_base")])
