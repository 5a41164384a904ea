"""Streams of records: the flows keep no state, so each micro-batch takes the same plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from redactum.functions.profiles import DEFAULT
from redactum.plans.pipeline import deidentify_texts


def read_record_stream(spark: SparkSession, path: str, schema: str, source: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(source).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def deidentify_stream(records: DataFrame, profile: str = DEFAULT, secret: bytes | None = None, text: str = "text") -> DataFrame:
    """The records with their outputs; append mode, no watermark needed."""
    return deidentify_texts(records, profile, secret, text, audit=False)


def write_stream(df: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Appends to Parquet, or hands each batch to ``each``; runs what is there and ends."""
    w = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return w.foreachBatch(each).start() if each else w.format("parquet").option("path", path).start()
