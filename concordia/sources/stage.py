"""Tables written between the steps of a run, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without it, as in tests, gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="concordia-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def staged(df: DataFrame, what: str) -> DataFrame:
    """The rows, written as Parquet and read again: what follows can use them often, and a lost executor costs no more than
    its own tasks."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(df: DataFrame, rows: int) -> int:
    """How many tasks have about that many of the rows each; they are counted for it."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-df.count() // rows))


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The rows dealt by the key to so many tasks that each has about that many; they are counted for it."""
    return df.repartition(tasks(df, rows), key)
