"""Folders of documents as streams: stateless, one row for each file as it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.xml import OPTIONS


def xml_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000, **options: str) -> DataFrame:
    """(file, value): each new file is one document of ``schema``."""
    text = spark.readStream.option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.from_xml(F.col("value"), schema, OPTIONS | options).alias("value"))


def write_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
