"""Exact duplicates by deterministic block naming.

A text without white space is cut into blocks of 4,096 characters. The distinct blocks are sorted and each is
named by its number in that order; then neighbouring names are paired, the distinct pairs are sorted and named in
the same way, and so on until one name is left of each document. Equal names of documents with
equally many blocks mean equal texts and nothing else does: names are numbers given to distinct keys, so they cannot collide.

Blocks are sorted by a 128-bit hash of theirs and then by content, so that only the numbers travel with
the documents. The text of the blocks is shuffled once, for the step that finds the distinct ones. Should different blocks share a hash,
they get different numbers, and documents with such a block find theirs by content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earthframe.lineage import saved
from earthframe.llm.rows import NO_ID, keyed

BLOCK = 4096
WHITE = r"[\x20\x09-\x0D]+"


def _hash(block: Column, bits: int) -> tuple[Column, Column]:
    one, two = F.xxhash64(block), F.xxhash64(F.lit(1), block)
    if bits < 64:
        one, two = F.pmod(one, F.lit(1 << bits)), F.lit(0).cast("bigint")
    return one.alias("h1"), two.alias("h2")


def _numbered(keys: DataFrame, *order: str) -> DataFrame:
    """``keys`` with their number in sorted order as ``name``; written, so that the numbers stay."""
    return saved(keys.orderBy(*order).withColumn("name", F.monotonically_increasing_id()))


def _block_names(blocks: DataFrame, bits: int) -> DataFrame:
    """(_doc, _tag, at, name) of ``blocks`` (_doc, _tag, at, block)."""
    hashed = blocks.select("_doc", "_tag", "at", "block", *_hash(F.col("block"), bits))
    contents = (hashed.groupBy("h1", "h2").agg(F.sort_array(F.collect_set("block")).alias("contents"))
                .select("h1", "h2", F.posexplode("contents").alias("n", "block"), F.size("contents").alias("of")))
    # The text stays only where a hash has several contents.
    keys = contents.select("h1", "h2", "n", "of", F.when(F.col("of") > 1, F.col("block")).alias("block"))
    named = _numbered(keys, "h1", "h2", "n")
    places = hashed.select("_doc", "_tag", "at", "h1", "h2")
    clear = places.join(named.where("of = 1").select("h1", "h2", "name"), ["h1", "h2"]).select("_doc", "_tag", "at", "name")
    unclear = named.where("of > 1")
    if unclear.limit(1).count():
        clear = clear.union(hashed.join(unclear.select("h1", "h2", "block", "name"), ["h1", "h2", "block"])
                            .select("_doc", "_tag", "at", "name"))
    return saved(clear)


def document_names(rows: DataFrame, bits: int = 64) -> DataFrame:
    """(_doc, _tag, blocks, name) of keyed rows, whose text is already normalised; ``bits`` of the hash are used."""
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    blocks = (rows.select("_doc", "_tag", F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(cut).alias("cut"))
              .select("_doc", "_tag", F.posexplode("cut").alias("at", "block")))
    names = _block_names(blocks, bits)
    sizes = saved(names.groupBy("_doc", "_tag").agg(F.count("*").alias("blocks")))
    done = None
    while True:
        open_ = names.groupBy("_doc", "_tag").agg(F.count("*").alias("left"), F.first("name").alias("name"))
        ended = saved(open_.where("left = 1").select("_doc", "_tag", "name"))
        done = ended if done is None else done.union(ended)
        rest = names.join(open_.where("left > 1").select("_doc", "_tag"), ["_doc", "_tag"])
        pairs = saved(rest.groupBy("_doc", "_tag", F.expr("at div 2").alias("at")).agg(
            F.min(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1).cast("bigint")).alias("right")))
        if not pairs.limit(1).count():
            break
        named = _numbered(pairs.select("left", "right").distinct(), "left", "right")
        names = saved(pairs.join(named, ["left", "right"]).select("_doc", "_tag", "at", "name"))
    return sizes.join(done, ["_doc", "_tag"])


def decide(docs: DataFrame, bits: int = 64) -> DataFrame:
    """``exact_duplicates`` with the keys of the rows.

    Texts are equal that agree without white space; null counts as empty. Of equal texts the row with the most code
    points stays, then that with the smallest doc_id, where a null doc_id is larger than any. Of fully repeated rows one
    counts as first. ``keep_id`` is null where the row that stays has no doc_id. An empty table gives an empty
    result.
    """
    rows = keyed(docs)
    plain = F.regexp_replace("text", WHITE, "")
    base = saved(rows.select("_doc", "_tag", "doc_id", F.length("text").alias("points"),
                             F.sha2(F.encode(plain, "UTF-8"), 256).alias("text_sha256"))
                 .withColumn("row", F.monotonically_increasing_id()))
    texts = rows.select("_doc", "_tag", plain.alias("text"))
    if base.groupBy("_doc", "_tag").count().where("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["_doc", "_tag"])
    names = document_names(texts, bits)
    named = saved(base.join(names, ["_doc", "_tag"]))
    best = F.min(F.struct((-F.col("points")).alias("points"), "_doc", "row")).alias("best")
    groups = saved(named.groupBy("blocks", "name").agg(best, F.count("*").alias("group_size")))
    out = named.join(groups, ["blocks", "name"])
    return out.select("_doc", "_tag", "doc_id", F.when(F.col("best._doc") != NO_ID, F.col("best._doc")).alias("keep_id"),
                      "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")



def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256; see ``decide``."""
    return decide(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = r"""
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents),
ranked AS (
  SELECT doc_id, plain, count(*) OVER (PARTITION BY plain) AS group_size,
         first_value(doc_id) OVER (PARTITION BY plain ORDER BY points DESC, doc_id) AS keep_id FROM plain)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM ranked
"""
