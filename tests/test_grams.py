"""Grams counted inside tasks against the operators that spread them."""

from __future__ import annotations

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from earthframe.operators import grams
from earthframe.operators import intents as M

TEXTS = [(1, "Ab cd  ab\tcd ab"), (2, ""), (3, None), (4, "x"), (5, "öl öl ünd 한글 a_b 12 12,5"), (6, "ab cd ab cd"), (7, " ! "), (8, "😀 smile smile"), (9, "smile")]


def _spread(spark):
    texts = spark.createDataFrame(TEXTS, "id long, text string")
    spread = M.cut(M.explode_grams(texts))
    return texts, spread, M.fit_idf(spread, F.lit(len(TEXTS)))


def test_document_frequencies_are_those_of_spread_grams(spark):
    texts, _, idf = _spread(spark)
    got = {(r.block, r.gram): (r.df, round(r.idf, 9)) for r in M.text_idf(texts, len(TEXTS)).collect()}
    assert got == {(r.block, r.gram): (r.df, round(r.idf, 9)) for r in idf.collect()}


@pytest.mark.parametrize("piece", [1, 1 << 23])
def test_summed_weights_are_those_of_spread_grams(spark, monkeypatch, piece):
    monkeypatch.setattr(grams, "PIECE", piece)
    texts, spread, idf = _spread(spark)
    expected = M.tfidf_weights(spread, idf).groupBy("id", "block", F.substring("gram", 1, 1).alias("initial")).agg(
        F.count("*").alias("grams"), F.sum("weight").alias("total"), F.max("weight").alias("most"), F.min("gram").alias("first_gram"))
    mine = M.weight_summary(texts, len(TEXTS))
    key = lambda r: (r.id, r.block, r.initial, r.grams, r.first_gram)
    mine, expected = {key(r): r for r in mine.collect()}, {key(r): r for r in expected.collect()}
    assert mine.keys() == expected.keys()
    assert all(math.isclose(mine[k].total, expected[k].total) and math.isclose(mine[k].most, expected[k].most) for k in mine)


def test_no_row_for_each_gram_of_a_text_is_shuffled(spark):
    """A gram of many texts leaves a task once."""
    texts = spark.createDataFrame([(i, "the same words again") for i in range(400)], "id long, text string").coalesce(1)
    counted = M.text_idf(texts, 400)
    assert {r.df for r in counted.collect()} == {400}
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_a_piece_is_read_in_parts_of_bounded_size(monkeypatch):
    monkeypatch.setattr(grams, "PART", 60)
    chunks = [["ab" * (i % 9)] * (i % 5) for i in range(50)] + [["x" * 500], None, [], ["y"]]
    table = pa.table({"id": range(len(chunks)), "chunks": pa.array(chunks, pa.list_(pa.string()))})
    parts = list(grams.parts_of(table))
    assert [i for p in parts for i in p.column("id").to_pylist()] == list(range(len(chunks)))
    size = lambda p: sum(len(c) + 1 for row in p.column("chunks").to_pylist() for c in row or [])
    assert len(parts) > 5 and all(p.num_rows == 1 or size(p) <= 60 for p in parts)
    assert not list(grams.parts_of(table.slice(0, 0)))


def test_parts_of_a_piece_weigh_as_one(spark, monkeypatch):
    """A text of more than PART bytes' company: frequencies are those of the whole piece and of all pieces."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = spark.createDataFrame([(i, " ".join(rng.choices(words, k=1200))) for i in range(400)], "id long, text string")
    found = []
    for piece in (1 << 23, 1 << 17):
        monkeypatch.setattr(grams, "PIECE", piece)
        found.append({(r.id, r.block, r.initial): (r.grams, round(r.total, 9), round(r.most, 9), r.first_gram) for r in M.weight_summary(texts, 400).collect()})
    assert found[0] == found[1] and len(found[0]) > 400
