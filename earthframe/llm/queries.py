"""The operators applied to their whole tables, with the columns of their digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from earthframe.llm import (exact_dedup, html_text, lexical_search, licenses, mixing, nearest_vectors, secret_tags, suffix_tree_lm, toxicity,
                            whitening)
from earthframe.llm.near_dedup import near_duplicates
from earthframe.llm.packing import pack
from earthframe.llm.repeats import remove_repeats

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op7_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(_read(spark, sf_dir, "documents"))


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors.search(_read(spark, sf_dir, "embeddings"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_tags.scan(_read(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def registered() -> tuple[dict[str, Query], dict[str, str]]:
    """The queries and their SQL."""
    queries = (op1_exact_dedup, op2_toxicity, op3_html_extraction, op4_mixing,
               op5_minhash_near_dedup, op6_license_scan, op7_suffix_tree_lm, op8_nearest_vectors,
               op9_suffix_array_dedup, op10_packing, op11_lexical_search, op12_secret_scan, op13_whitening)
    return {q.__name__: q for q in queries}, {
        "op1_exact_dedup": exact_dedup.OP1_SQL, "op4_mixing": mixing.OP4_SQL, "op8_nearest_vectors": nearest_vectors.OP8_SQL,
        "op11_lexical_search": lexical_search.OP11_SQL}
