"""Readers' cells that arrive as files, reconciled as they come.  An extension: each new file is taken once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from concordia.operators.reconcile import reconcile

CELLS = "record_id string, label string, value string, confidence string, evidence string, reader string"


def reconcile_arrivals(spark: SparkSession, inbox: str, out: str, checkpoint: str, files_at_once: int = 1000) -> StreamingQuery:
    """Takes what lies in inbox (Parquet of CELLS, a record's cells in one file) and appends silver cells to out."""
    arriving = spark.readStream.schema(CELLS).option("maxFilesPerTrigger", files_at_once).parquet(inbox)

    def take(batch: DataFrame, number: int) -> None:
        silver = reconcile(batch.where("reader = 'vision'"), batch.where("reader = 'text'"))
        silver.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that is run again replaces itself

    return arriving.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
