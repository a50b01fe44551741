"""The training chain: features, models of all parts, cross-validation, calibration and the sink, against plain computation."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from earthframe.operators import intents as M
from earthframe.sources.labelled import read_evaluation, write_evaluation

LABELS = ("water", "plants", "radar")
WORDS = {"water": "lake river wet flood shore", "plants": "green crop leaf forest grow", "radar": "echo signal radar beam return"}


def _texts():
    rng = random.Random(1)
    common = "show the of in around please image month".split()
    rows = []
    for i in range(60):
        label = LABELS[i % 3] if i % 7 else LABELS[(i // 7) % 3]
        rows.append((i, label, " ".join(rng.choices(WORDS[label].split(), k=2) + rng.choices(common, k=4)), i // 2))
    return rows + [(100, "water", "", 50), (101, "water", "zz", 51)]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(_texts(), "id long, label string, text string, family long")


def _grams(text):
    words = re.findall(r"\w\w+", text.lower())
    out = Counter(("word", w) for w in words) + Counter(("word", f"{a} {b}") for a, b in zip(words, words[1:], strict=False))
    for w in text.lower().split():
        p = f" {w} "
        out += Counter(("char", p[i:i + n]) for n in range(2, min(5, len(p)) + 1) for i in range(len(p) - n + 1))
    return out


def _weights(training, text):
    df = Counter(g for t in training for g in _grams(t))
    idf = {g: math.log((1 + len(training)) / (1 + d)) + 1 for g, d in df.items() if d >= (1 if g[0] == "word" else 2)}
    own = {g: (1 + math.log(n)) * idf[g] for g, n in _grams(text).items() if g in idf}
    norm = {b: math.sqrt(sum(w * w for (k, _), w in own.items() if k == b)) for b in ("word", "char")}
    return {g: w / norm[g[0]] for g, w in own.items()}


def test_entries_of_each_part_weigh_by_its_training_texts(spark, texts):
    roles = texts.withColumn("fold", F.when(F.col("id") % 4 < 3, (F.col("id") % 4).cast("int"))).select("id", "label", "fold")
    grams = M.cut(M.explode_grams(texts))
    entries = M.part_entries(grams, roles, 3).collect()
    fold = {i: i % 4 if i % 4 < 3 else None for i, *_ in _texts()}
    text = {i: t for i, _, t, _ in _texts()}
    got = defaultdict(list)
    for r in entries:
        got[r.part, r.id].append((r.word, r.idx, r.x))
        assert r.trains == (fold[r.id] is not None and (r.part == 3 or r.part != fold[r.id]))
    for part in range(4):
        training = [text[i] for i, f in fold.items() if f is not None and f != part]
        for i, f in fold.items():
            if part < 3 and f is None:
                assert (part, i) not in got
                continue
            want, mine = _weights(training, text[i]), got.get((part, i), [])
            norm = {b: math.sqrt(sum(x * x for w, _, x in mine if w == b)) for b in (True, False)}
            assert np.allclose(sorted(x / norm[w] for w, _, x in mine), sorted(want.values()))
            assert len({idx for _, idx, _ in mine}) == len(mine)


def test_vectors_hold_the_same_weights(spark, texts):
    train, rest = M.intent_features(texts.where("id % 4 < 3"), texts.where("id % 4 = 3"))
    text = {i: t for i, _, t, _ in _texts()}
    training = [t for i, t in text.items() if i % 4 < 3]
    rows = train.collect() + rest.collect()
    assert sorted(r.id for r in rows) == sorted(text)
    for r in rows:
        assert np.allclose(sorted(r.features.values), sorted(_weights(training, text[r.id]).values()))


@pytest.mark.parametrize("c", [1.0, 30.0])
def test_fit_meets_its_optimality_conditions(c):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 30)) * (rng.random((80, 30)) < 0.3)
    truth = np.eye(3)[rng.choice(3, 80, p=[0.6, 0.3, 0.1])]
    fitted = M.fit_kernel(x @ x.T, truth, c)
    share = M.softmax(x @ x.T @ fitted[:-1] + fitted[-1])
    # free intercepts: probabilities of each class add up to its count; the penalty ties W to what is left unexplained
    assert np.allclose(share.sum(axis=0), truth.sum(axis=0), atol=1e-3)
    assert np.allclose(x.T @ fitted[:-1], c * x.T @ (truth - share), atol=1e-3)
    again = M.fit_kernel(x @ x.T, truth, c, M.fit_kernel(x @ x.T, truth, c / 3))
    assert np.allclose(M.softmax(x @ x.T @ again[:-1] + again[-1]), share, atol=1e-4)


def test_scores_equal_those_of_the_library_model(spark, texts):
    train, rest = texts.where("id % 4 < 3"), texts.where("id % 4 = 3")
    fit_on, score_on = M.intent_features(train, rest)
    model = M.fit_intent(fit_on.join(train.select("id", "label"), "id"), LABELS, 10.0, tol=1e-9)
    library = {r.id: r for r in M.score_intent(score_on, model, LABELS, 0.9).collect()}
    roles = texts.select("id", "label", F.when(F.col("id") % 4 < 3, 0).alias("fold"))
    entries = M.part_entries(M.cut(M.explode_grams(texts)), roles)
    models = M.fit_parts(entries, roles, LABELS, (3.0, 10.0))
    mine = M.score_parts(entries, roles.where("fold IS NULL").select("id", F.lit(0).alias("part")), models, LABELS, (3.0, 10.0))
    rows = [r for r in mine.collect() if r.c == 10.0]
    assert len(rows) == len(library)
    for r in rows:
        assert np.allclose(r.probabilities, library[r.id].probabilities, atol=1e-2)  # as far as the library fit settles
        assert abs(sum(r.probabilities) - 1) < 1e-12 and r.confidence == max(r.probabilities)
        assert r.predicted == LABELS[int(np.argmax(r.probabilities))]


def test_chain_keeps_families_and_test_texts_apart(spark, texts):
    run = M.train_intents(texts.drop("family"), texts.select("id", "family"), LABELS, "s", (1.0, 10.0), 3)
    split = {r.id: r.split for r in run.splits.collect()}
    family = defaultdict(set)
    for i, _, _, f in _texts():
        family[f].add(split[i])
    assert all(len(s) == 1 for s in family.values())
    folded = run.folded.collect()
    trained = {i for i, s in split.items() if s == "train"}
    assert Counter((r.c, r.id) for r in folded) == Counter((c, i) for c in (1.0, 10.0) for i in trained)
    scored = {r.id: r for r in run.scored.collect()}
    assert set(scored) == set(split) - trained and all(scored[i].split == split[i] for i in scored)
    by_c = {c: [(r.label, r.predicted) for r in folded if r.c == c] for c in (1.0, 10.0)}

    def macro(pairs):
        f1 = []
        for k in LABELS:
            hit, n = sum(a == b == k for a, b in pairs), sum((a == k) + (b == k) for a, b in pairs)
            f1.append(2 * hit / n if n else 0.0)
        return sum(f1) / len(f1)

    score = {c: macro(p) for c, p in by_c.items()}
    assert {r.c: pytest.approx(r.score) for r in run.scores.collect()} == score
    assert run.best_c == max(score, key=lambda c: (round(score[c], 6), -c))
    judged = [(r.label == r.predicted, r.confidence) for r in folded if r.c == run.best_c]
    judged += [(r.label == r.predicted, r.confidence) for r in scored.values() if r.split == "validation"]
    precise = [t for t in M.THRESHOLD_GRID if (lambda a: not a or sum(a) / len(a) >= 0.99)([ok for ok, p in judged if p >= t])]
    assert run.threshold == max(0.9, min(precise, default=0.95))
    assert all(r.acted_on == (r.confidence >= run.threshold) for r in scored.values())


def test_a_report_is_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "name string, n long")
    other = spark.createDataFrame([("c", 3)], "name string, n long")
    for _ in range(2):
        write_evaluation({"part": rows}, str(tmp_path), "one")
    write_evaluation({"part": other}, str(tmp_path), "two")
    back = lambda s: sorted(map(tuple, read_evaluation(spark, {"part": rows.schema}, str(tmp_path), s)["part"].collect()))
    assert back("one") == [("a", 1), ("b", 2)] and back("two") == [("c", 3)]


def test_before_and_after(spark):
    rows = [("s", m, "water", p) for m, p in (("old", "water"), ("old", "plants"), ("new", "water"), ("new", "water"))]
    table = spark.createDataFrame(rows, "set string, model string, label string, predicted string")
    out = {r.metric: r for r in M.before_after(M.evaluate_sets(table, LABELS), "old", "new").collect()}
    assert out["accuracy"].before == 0.5 and out["accuracy"].after == 1.0 and out["accuracy"].change == 0.5
    assert out["macro_f1"].before == pytest.approx((2 / 3) / 3) and out["count"].change == 0
