"""Run a stream over what its source holds now and read the result as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylens.storage import fresh_path


def stream_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The files ``name`` of a folder as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def replay(stream: DataFrame, path: str | None = None) -> DataFrame:
    """The rows that a stream gives for the input at hand, written to the shared folder by every task.

    With the ``path`` of an earlier call the stream goes on where that one ended.
    """
    spark = stream.sparkSession
    path = path or fresh_path(spark, "rows")
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", path + "-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
