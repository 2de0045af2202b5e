"""Standard columns, coercion, filters, de-duplication and their statistics."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeflow.config import COLUMN_ALIASES, STANDARD_COLUMNS, CleaningConfig

TIMESTAMP_FORMATS = ("dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss")


def normalized(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


def require(df: DataFrame, columns: Iterable[str], what: str = "input") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {', '.join(missing)}")


def find_column(df: DataFrame, candidates: Iterable[str]) -> str:
    """The first candidate that a column's normalised name equals; ValueError if none."""
    names = {normalized(c): c for c in df.columns}  # of equal names the last wins
    for candidate in candidates:
        if normalized(candidate) in names:
            return names[normalized(candidate)]
    raise ValueError(f"none of {list(candidates)} is a column")


def number(c: Column | str) -> Column:
    """Coerced to double: what is no number, and NaN, become null."""
    x = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(x), x)


def integer(c: Column | str) -> Column:
    """Coerced to long through double, so that '12.7' is 12."""
    return number(c).try_cast("long")


def moment(c: Column | str) -> Column:
    """A timestamp: day first if it is text, then other forms; what is none becomes null."""
    x = F.col(c) if isinstance(c, str) else c
    text = x.cast("string")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIMESTAMP_FORMATS], F.try_to_timestamp(text))


def standardize(df: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """The six standard columns, found by name or alias, and ``_order`` if there is one; others are dropped."""
    aliases = aliases or COLUMN_ALIASES
    return df.select(*[F.col(f"`{find_column(df, [c, *aliases.get(c, [])])}`").alias(c) for c in STANDARD_COLUMNS], *_place(df))


def _place(df: DataFrame) -> list[str]:
    return ["_order"] if "_order" in df.columns else []


def coerce(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    ts = F.col("timestamp") if kinds["timestamp"] == "timestamp" else moment("timestamp")
    return df.select(integer("MMSI").alias("MMSI"), ts.alias("timestamp"), *[number(c).alias(c) for c in STANDARD_COLUMNS[2:]], *_place(df))


def _marked(raw: DataFrame, config: CleaningConfig) -> DataFrame:
    """Coerced rows with keys, marked ok (in range) and first (of those in range with their keys)."""
    rows = coerce(raw).dropna(subset=["MMSI", "timestamp", "latitude", "longitude"])
    ok = F.col("latitude").between(*config.latitude_range) & F.col("longitude").between(*config.longitude_range)
    rows = rows.withColumn("_ok", ok)
    order = Window.partitionBy(*config.duplicate_subset, "_ok").orderBy("_order")
    rows = rows if _place(raw) else rows.withColumn("_order", F.monotonically_increasing_id())
    return rows.withColumn("_first", F.row_number().over(order) == 1)


def clean(raw: DataFrame, config: CleaningConfig | None = None) -> DataFrame:
    """Standard rows: keys present, in range, first of duplicates in file order, no base stations, with trajectory_date.

    One shuffle by the keys; the write sorts if it must.
    """
    config = config or CleaningConfig()
    rows = _marked(raw, config).filter("_ok and _first").filter(~F.col("MMSI").between(*config.base_station_range))
    return rows.select(*STANDARD_COLUMNS, F.date_format("timestamp", "yyyy-MM-dd").alias("trajectory_date"))


def cleaning_stats(raw: DataFrame, config: CleaningConfig | None = None) -> DataFrame:
    """One row: raw_rows, cleaned_rows, invalid_coordinate_rows, duplicate_timestamp_rows, vessel_count."""
    config = config or CleaningConfig()
    kept = F.col("_ok") & F.col("_first") & ~F.col("MMSI").between(*config.base_station_range)
    counted = _marked(raw, config).agg(
        F.count_if(kept).alias("cleaned_rows"),
        F.count_if(~F.col("_ok")).alias("invalid_coordinate_rows"),
        F.count_if(F.col("_ok") & ~F.col("_first")).alias("duplicate_timestamp_rows"),
        F.count_distinct(F.when(kept, F.col("MMSI"))).alias("vessel_count"),
    )
    return raw.agg(F.count("*").alias("raw_rows")).crossJoin(counted)  # one row each


def by_vessel(points: DataFrame) -> DataFrame:
    """Points dealt by vessel and sorted in time inside: the distributed form of one frame per vessel."""
    return points.repartition("MMSI").sortWithinPartitions("MMSI", "timestamp")
