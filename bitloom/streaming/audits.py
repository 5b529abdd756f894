"""Audits that follow a folder: new files update totals without reading the old ones again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import audit


def follow(spark: SparkSession, folder: str, schema: str, format: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """A streaming table of the rows in a folder's files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(format).load(folder)


def running_totals(rows: DataFrame, raw: str, size: str, paired: str, by: list[str]) -> DataFrame:
    """audit.summarize of all rows so far, kept as state per group; for output mode complete or update."""
    return audit.summarize(rows, raw, size, paired, by)


def to_table(totals: DataFrame, name: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Totals as an in-memory table; with ``once`` the query ends when the folder has been read."""
    writer = totals.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
