"""Position files as a stream, and a file sink whose restarts neither lose nor double a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from wakeflow.config import STANDARD_COLUMNS, CleaningConfig
from wakeflow.operators.clean import coerce

#: cleaned points
POINTS = "MMSI long, timestamp timestamp, latitude double, longitude double, speed double, heading double, trajectory_date string"


def read_points_stream(spark: SparkSession, path: str, files_per_trigger: int = 100, config: CleaningConfig | None = None) -> DataFrame:
    """Points of the files that arrive in a folder, at most so many files a batch.

    Parquet files hold cleaned points; CSV files hold the six standard columns as text, in
    that order under a header, and are coerced and filtered as the batch path does. Rows
    that repeat a vessel and time are left to :mod:`wakeflow.streaming.tracks`, which sees them in order.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True)
    if path.rstrip("/").endswith(".parquet") or not path.endswith(".csv"):
        return reader.schema(POINTS).parquet(path)
    config = config or CleaningConfig()
    text = StructType([StructField(c, StringType()) for c in STANDARD_COLUMNS])
    rows = coerce(reader.schema(text).option("header", True).csv(path)).dropna(subset=["MMSI", "timestamp", "latitude", "longitude"])
    rows = rows.filter(F.col("latitude").between(*config.latitude_range) & F.col("longitude").between(*config.longitude_range) & ~F.col("MMSI").between(*config.base_station_range))
    return rows.withColumn("trajectory_date", F.date_format("timestamp", "yyyy-MM-dd"))


def write_stream(rows: DataFrame, path: str, checkpoint: str, name: str | None = None, **trigger: object) -> StreamingQuery:
    """Each batch in a folder of its own, batch_id=N, written whole or not at all.

    A batch that is run again after a failure has the same rows and replaces its folder, so
    what is read from ``path`` (:func:`read_written`) has each row once. ``trigger``: as of
    ``DataStreamWriter.trigger``; all that is there and no more by default.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put)
    writer = writer.queryName(name) if name else writer
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What :func:`write_stream` has written, without the numbers of batches."""
    return spark.read.schema(schema).parquet(f"{path}/batch_id=*")
