"""Driving a bounded stream to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from earthframe.lineage import shared_folder


def drain(stream: DataFrame) -> DataFrame:
    """Process everything available, write it to the shared folder, and read it back."""
    spark: SparkSession = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
        .start(f"{base}/rows"))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
