"""Stage timings read from run-log lines, in batch and per minute on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earthframe.operators.pixels import value_percentiles

KEY = ["workflow", "stage", "outcome"]


def parse_log(log: DataFrame) -> DataFrame:
    """Lines with a stage or workflow, an outcome and milliseconds; other lines drop out."""
    def field(name: str) -> object:
        return F.regexp_extract("line", rf"(?:^|\s){name}=(\S+)", 1)

    parsed = log.select(
        *[c for c in log.columns if c != "line"], field("workflow").alias("workflow"),
        field("stage").alias("stage"), field("outcome").alias("outcome"),
        field("ms").try_cast("double").alias("ms"))
    return parsed.where(F.col("ms").isNotNull() & (
        (F.col("stage") != "") | (F.col("workflow") != "")))


def stage_summary(log: DataFrame) -> DataFrame:
    """count, total, mean and exact 95th percentile of milliseconds per stage and outcome."""
    parsed = parse_log(log)
    sums = parsed.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.sum("ms").alias("total_ms"), F.avg("ms").alias("mean_ms"))
    return sums.join(value_percentiles(parsed, KEY, "ms", (0.95,)), KEY).withColumnRenamed(
        "p95", "p95_ms")


def stage_stream(log: DataFrame, watermark: str = "1 minute", width: str = "1 minute") -> DataFrame:
    """Per-minute counts and timings; lines later than the watermark are dropped."""
    parsed = parse_log(log).withWatermark("ts", watermark)
    return parsed.groupBy(F.window("ts", width), "stage", "outcome").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ms").alias("total_ms"), F.max("ms").alias("max_ms")
    ).select(F.col("window.start").alias("minute"), "stage", "outcome", "n", "total_ms", "max_ms")
