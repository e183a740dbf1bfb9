"""Helpers the training-data operators share."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir

#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def on_exit_deleted(spark: SparkSession, path: str) -> None:
    """Files at path go when the driver ends in order."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: lineage ends there, so a lost executor costs no rerun."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    on_exit_deleted(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """At most so many rows in an Arrow batch from now on: texts may be very long. A lower setting of the session stays.
    Spark reads it when a query is planned, after the operator has returned, so it can't be set back here."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def parts(rows: int, per_part: int) -> int:
    return max(1, math.ceil(rows / per_part))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
