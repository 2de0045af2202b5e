"""Session settings that the engine relies on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "wakeflow", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution, and further settings as given (pass names with dots by ``**``)."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_checkpoints(spark: SparkSession) -> str:
    """The folder of checkpoints: spark.checkpoint.dir. A session of one machine, as in tests, may do without; on a cluster it must be set, since nodes do not share their own folders."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="wakeflow-"))
    return sc.getCheckpointDir()


def once(df: DataFrame) -> DataFrame:
    """The same rows, computed now and read from a reliable checkpoint wherever they are used."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint()
