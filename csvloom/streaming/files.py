"""An extension: CSV documents that arrive as files, parsed by the column function in a structured stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from csvloom.dialect import Dialect
from csvloom.functions.columns import explode_records


def stream_records(spark: SparkSession, path: str, d: Dialect, columns: int | None = None, **options: str) -> DataFrame:
    """Records of every new file below ``path``: ``file``, ``modified``, ``pos`` and the fields.

    Each file is one document read whole, so files must fit in a task; use the batch scan for large ones.
    """
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    found = reader.options(**options).load(path)
    rows = found.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), "content")
    return explode_records(rows, "content", d, columns)


def windowed_counts(records: DataFrame, late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Records by window of the files' times, with late files dropped after the watermark."""
    return records.withWatermark("modified", late).groupBy(F.window("modified", width)).agg(F.count("*").alias("n"))
