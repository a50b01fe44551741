"""Loading labelled text with its constraints, and the sink of an evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from earthframe.functions.rules import first_failure
from earthframe.operators.intents import INTENT_LABELS
from earthframe.sources.catalog_items import kind, path


def load_labelled(lines: DataFrame, labels: Sequence[str] = INTENT_LABELS, raw: str = "value"
                  ) -> tuple[DataFrame, DataFrame]:
    """(rows, violations) of JSON lines with exactly the keys id, text and intent.

    Ids are unique, labels closed, texts not blank. Repeated ids are found by one count.
    """
    item = F.try_parse_json(raw)
    keys = F.array_sort(F.map_keys(F.try_variant_get("_item", "$", "map<string,variant>")))
    parsed = lines.withColumn("_item", item).select(
        F.col(raw).alias("raw"), keys.alias("_keys"),
        *[F.when(kind(F.col("_item"), k) == "STRING",
                 F.try_variant_get("_item", path(k), "string")).alias(k)
          for k in ("id", "text", "intent")])
    repeated = parsed.where(F.col("id").isNotNull()).groupBy("id").agg(
        (F.count(F.lit(1)) > 1).alias("_twice"))
    expected = F.array(F.lit("id"), F.lit("intent"), F.lit("text"))
    checked = parsed.join(repeated, "id", "left").withColumn("violation", first_failure([
        (~F.coalesce(F.col("_keys") == expected, F.lit(False)), "keys"),
        (F.col("id").isNull(), "id_missing"),
        (F.coalesce(F.col("_twice"), F.lit(False)), "id_repeated"),
        (~F.coalesce(F.col("intent").isin(*labels), F.lit(False)), "label_unknown"),
        (F.trim(F.coalesce("text", F.lit(""))) == "", "text_blank"),
    ]))
    rows = checked.where(F.col("violation").isNull()).select("id", "text", "intent")
    return rows, checked.where(F.col("violation").isNotNull()).select("id", "raw", "violation")


def write_evaluation(reports: dict[str, DataFrame], folder: str, evaluated: str) -> None:
    """Write the parts of a report (metrics, confusion, thresholds, misclassified...) of the set ``evaluated``.

    Each part is a Parquet table partitioned by set. Writing a set again replaces its partition and no other, so a run that
    is repeated, or fails half-way and starts anew, leaves one copy.
    """
    for name, df in reports.items():
        rows = df.drop("set").withColumn("set", F.lit(evaluated))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("set").parquet(f"{folder}/{name}")


def read_evaluation(spark: SparkSession, schemas: dict[str, StructType], folder: str, evaluated: str) -> dict[str, DataFrame]:
    """The parts of the set ``evaluated`` as they were written; only its partitions are read."""
    return {name: spark.read.parquet(f"{folder}/{name}").where(F.col("set") == evaluated).select(*[c for c in schema.names if c != "set"])
            for name, schema in schemas.items()}
