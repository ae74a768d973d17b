"""Incremental bronze by a file stream: an extension beside the import manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.medallion import bronze


def bronze_stream(spark: SparkSession, path: str, schema: StructType, supplier: str, files_per_trigger: int | None = None) -> DataFrame:
    """Bronze rows of Parquet files as they arrive under a path; the stream's checkpoint remembers files."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return bronze(reader.parquet(path), supplier)


def load_new_files(spark: SparkSession, path: str, schema: StructType, supplier: str, out: str, checkpoint: str) -> None:
    """Append what is new under a path to bronze, once, and stop; a second call adds nothing."""
    q = bronze_stream(spark, path, schema, supplier).writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").option("path", out).outputMode("append").start()
    q.awaitTermination()
