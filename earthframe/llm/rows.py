"""Row keys, Arrow tasks and components shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from earthframe.lineage import saved

#: Stands for a null doc_id inside an operator, so such rows come last.
NO_ID = 2**63 - 1


def row_key(docs: DataFrame) -> tuple[Column, Column]:
    """Columns that name a text: the doc_id, NO_ID where null, and a tag.

    The tag is 0 where doc_ids are unique; where an id is null or stands in several rows it is a hash of the text. Rows
    that agree in both are repeated rows.
    """
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    unclear = ids.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count()
    tag = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) if unclear else F.lit(0).cast("bigint")
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)), tag


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` as (_doc, _tag, doc_id, text), null texts as empty ones."""
    doc, tag = row_key(docs)
    return docs.select(doc.alias("_doc"), tag.alias("_tag"), F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def keep_rows(docs: DataFrame, keys: DataFrame, once: bool = False) -> DataFrame:
    """Rows of ``docs`` whose key stands in ``keys`` (_doc, _tag), with their own columns; repeated rows once if ``once``."""
    doc, tag = row_key(docs)
    wanted = keys.select(F.col("_doc").alias("key of row"), F.col("_tag").alias("tag of row")).distinct()
    out = docs.withColumn("key of row", doc).withColumn("tag of row", tag).join(wanted, ["key of row", "tag of row"], "left_semi")
    if once and out.select("key of row", "tag of row").groupBy("key of row", "tag of row").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates(["key of row", "tag of row"])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """Apply ``fn`` to every Arrow batch of every partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected ``edges`` (a, b); the component is its smallest node.

    Alternates the large-star and small-star steps: a node's neighbours are re-linked to the smallest of
    them until only stars remain. Every step is one aggregate and one join, and no group is collected.
    """
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = state(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        edges = saved(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                      .where("a <> b").distinct())
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        edges = saved(edges.join(least, "a").select(F.col("b").alias("x"), F.col("m"), "a")
                      .select(F.explode(F.array(F.struct("x", "m"), F.struct(F.col("a").alias("x"), "m"))).alias("e"))
                      .select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct())
        now = state(edges)
        if now == seen:
            break
        seen = now
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.union(ends.select(F.col("component").alias("node"), "component").distinct())
