"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.session import work_dir

#: ASCII upper case to lower case only: the contracts fold A-Z and nothing else.
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


#: Rows that Spark hands to Python at a time: whole texts, so a tenth of Spark's own number.
BATCH_SETTING, BATCH_ROWS, SPARK_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000, "10000"


def short_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for the session, unless it has a number of its own:
    ten thousand texts at once, on both sides and in each concurrent task, take a
    good part of an executor's memory."""
    if spark.conf.get(BATCH_SETTING, SPARK_ROWS) == SPARK_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder of
    ``spark.checkpoint.dir`` and read it back: cuts the lineage, survives the
    loss of executors, and later uses don't compute it again."""
    path = work_dir(df.sparkSession, purpose) + "/t"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """Broadcast hint only when the counted ``rows`` are within ``max_rows``;
    otherwise Spark plans a shuffled join."""
    return F.broadcast(df) if rows <= max_rows else df


def utf8(col: str):
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(f"`{col}`"), F.lit("")).cast("binary")
