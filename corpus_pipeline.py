"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from earthframe.lineage import saved
from earthframe.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from earthframe.llm.rows import keep_rows

#: Share of all tokens that the mix keeps.
MIXED_PART = 0.95


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't score as toxic."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return keep_rows(docs, exact_dedup.decide(docs).where("kept"), once=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; texts without words stay."""
    return keep_rows(docs, near_dedup.decide(docs).where("chosen"), once=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen to target weights, none twice; those without words are not chosen."""
    return keep_rows(docs, mixing.keep_mixed(docs, MIXED_PART))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in token sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the toxicity scores, the signatures or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = saved(docs)
    return docs


def registered() -> tuple[dict, dict]:
    """The pipeline as a query, and its SQL where there is one."""
    return {"pipeline": run}, {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
