"""Small things that the training-data operators share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeflow.session import shared_checkpoints

#: Fixed pattern: words are runs without \x20 and \x09-\x0D.
SPACES = "[ \\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same rows from a table written beside the checkpoints. Unlike a checkpoint it forgets the plan's constraints, which loops would pile up."""
    spark = df.sparkSession
    shared_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of tables that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    spark.range(1).count()  # Spark's listeners hold the plan of the last query until there is another
    for _ in range(2):  # what the first round frees may have held more
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def word_count(text: Column) -> Column:
    """Number of words, by native functions; null text has none."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACES), "")), F.lit(0)).cast("long")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def free(df: DataFrame, *names: str) -> list[str]:
    """The names as columns that ``df`` does not have yet, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
