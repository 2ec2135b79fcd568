"""Fitted transforms are column expressions or static joins, so they apply to a
``readStream`` frame unchanged (stream–static join for group statistics)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_stream_like(spark: SparkSession, path: str, schema, max_files_per_trigger: int = 1) -> DataFrame:
    """Parquet folder as a stream with the schema of the batch table."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path))


def stream_transform(stream: DataFrame, model) -> DataFrame:
    """Apply any fitted model of this package (``transform``) to a stream."""
    return model.transform(stream)


def stream_predict(stream: DataFrame, pipeline_model) -> DataFrame:
    """V18 on a stream: a fitted Spark ML pipeline scores each micro-batch."""
    return pipeline_model.transform(stream)


def run_to_memory(df: DataFrame, name: str, checkpoint: str):
    """Drive a stream to completion into a memory table (tests / smoke runs)."""
    q = (df.writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
