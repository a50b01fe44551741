"""Predictions of all parts with grams left in tasks, against those from one row for each gram."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from earthframe.operators import intents as M
from tests.test_training import LABELS, _texts

GRID = (3.0, 10.0)


@pytest.mark.parametrize("parts", [0, 3])
@pytest.mark.parametrize("slices", [512, 7])
def test_predictions_equal_those_of_single_grams(spark, monkeypatch, parts, slices):
    monkeypatch.setattr(M, "TEXTS", slices)
    monkeypatch.setattr(M, "PIECE", 300)  # many pieces a fold
    texts = spark.createDataFrame(_texts(), "id long, label string, text string, family long")
    fold = F.when(F.col("id") % 4 < 3, (F.col("id") % 4 if parts else F.lit(0)).cast("int"))
    roles = texts.select("id", "label", fold.alias("fold"))
    entries = M.part_entries(M.cut(M.explode_grams(texts)), roles, parts)
    models = M.fit_parts(entries, roles, LABELS, GRID)
    asked = roles.where("fold IS NULL" if not parts else "true").select("id", F.coalesce("fold", F.lit(parts)).alias("part"))
    want = {(r.part, r.id, r.c): r.probabilities for r in M.score_parts(entries, asked, models, LABELS, GRID).collect()}
    mine = M.part_predictions(texts, roles, LABELS, GRID, parts).collect()
    assert len(mine) == len(want) == asked.count() * len(GRID)
    for r in mine:
        assert np.allclose(r.probabilities, want[r.part, r.id, r.c], atol=1e-4)
        assert r.predicted == LABELS[int(np.argmax(r.probabilities))] and r.confidence == max(r.probabilities)


def test_kernel_of_common_and_rare_columns():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 400)) * (rng.random((150, 400)) < rng.random(400) ** 3)
    row, column = np.nonzero(x)
    assert np.allclose(M.sparse_kernel(row, column, x[row, column], 150), x @ x.T)


def test_nothing_to_score_or_learn(spark):
    texts = spark.createDataFrame([(1, "a b", "water")], "id long, text string, label string")
    for fold in (None, 0):
        roles = texts.select("id", "label", F.lit(fold).cast("int").alias("fold"))
        assert M.part_predictions(texts, roles, LABELS, GRID, 0).count() == 0


@pytest.mark.parametrize("parts", [0, 3])
def test_more_texts_than_a_task_fits_train_all_the_same(spark, monkeypatch, parts):
    """The models of all tasks together are those of one task, whatever the bound of the latter."""
    from earthframe.operators import shared_fit as K

    texts = spark.createDataFrame(_texts(), "id long, label string, text string, family long")
    fold = F.when(F.col("id") % 4 < 3, (F.col("id") % 4 if parts else F.lit(0)).cast("int"))
    roles = texts.select("id", "label", fold.alias("fold"))
    want = {(r.part, r.id, r.c): r for r in M.part_predictions(texts, roles, LABELS, GRID, parts).collect()}
    for name, value in {"SPREAD": 300, "SHARD": 300, "ROWS": 7, "CELLS": 64, "ROOM": 1 << 12}.items():
        monkeypatch.setattr(K, name, value)
    monkeypatch.setattr(M, "FIT_TEXTS", 5)
    mine = M.part_predictions(texts, roles, LABELS, GRID, parts).collect()
    assert len(mine) == len(want) > 0
    for r in mine:
        assert np.allclose(r.probabilities, want[r.part, r.id, r.c].probabilities, atol=1e-5)
        assert r.predicted == want[r.part, r.id, r.c].predicted


def test_models_learn_from_every_training_text(spark, monkeypatch):
    """A word that one text in a hundred has decides its label, though a bounded fit would leave most such texts out."""
    monkeypatch.setattr(M, "FIT_TEXTS", 16)
    rows = [(i, "water" if i % 2 else "other", f"plain{i % 7} common words") for i in range(200)]
    rows += [(1000 + i, "water" if i % 2 else "other", f"rare{i} " * 3 + "word") for i in range(40)]
    rows += [(2000 + i, "water" if i % 2 else "other", f"rare{i} " * 3) for i in range(40)]
    texts = spark.createDataFrame(rows, "id long, label string, text string")
    roles = texts.select("id", "label", F.when(F.col("id") < 2000, 0).alias("fold"))
    found = M.part_predictions(texts, roles, ("other", "water"), (100.0,)).collect()
    assert len(found) == 40 and all(r.predicted == ("water" if r.id % 2 else "other") for r in found)
