"""Vectors, mixing, registered queries and the pipeline."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from earthframe.lineage import saved
from earthframe.llm import mixing, near_dedup, nearest_vectors, queries, toxicity
from tests.compare import difference

from . import odd


def test_nearest_vectors(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(600, 24))
    rows = [(i, [float(x) for x in v], i, "x") for i, v in enumerate(vectors)]
    rows += [(700, None, 0, "x"), (750, [0.0] * 24, 0, "x"), (800, [float("nan")] * 24, 0, "x"), (850, [None, *[1.0] * 23], 0, "x"),
             (900, [float("inf")] * 24, 0, "x"), (None, rows[0][1], 0, "x"), (950, [], 0, "x"), (601, rows[0][1], 0, "x"),
             (602, rows[0][1], 0, "x"), (100, rows[100][1], 0, "x"), (1000, [1.0, 2.0], 0, "x"), (1001, [2.0, 1.0], 0, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, dim string").repartition(3)
    out = nearest_vectors.search(table).collect()
    plain = {i: np.array(v, np.float32).astype(float) for i, v, _, _ in rows
             if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    hits = total = 0
    for q in (i for i in plain if i % 50 == 0):
        same = {i: v for i, v in plain.items() if i != q and len(v) == len(plain[q])}
        exact = {i: float(v @ plain[q] / (np.linalg.norm(v) * np.linalg.norm(plain[q]))) for i, v in same.items()}
        best = sorted(exact, key=lambda i: (-round(exact[i], 12), i))[:5]
        assert len(got[q]) == len(best) and all(abs(exact[i] - s) < 1e-12 for i, s in got[q])
        hits += len(set(best) & {i for i, _ in got[q]})
        total += len(best)
    assert set(got) == {i for i in plain if i % 50 == 0} and hits >= 0.95 * total
    assert [i for i, _ in got[0]][:2] == [601, 602]
    assert nearest_vectors.search(table.limit(0)).count() == 0


def test_repeated_ids_take_one_place(spark):
    rng = np.random.default_rng(14)
    rows = [(0, [1.0, 0.0, 0.0])] + [(7, [1.0, 0.001 * i, 0.0]) for i in range(1, 9)] + [(i, rng.normal(size=3).tolist()) for i in range(10, 30)]
    out = nearest_vectors.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).where("query_id = 0").orderBy("rank").collect()
    plain = defaultdict(list)
    for i, v in rows[1:]:
        v = np.array(v, np.float32).astype(float)
        plain[i].append(v[0] / np.linalg.norm(v))
    best = sorted(((-max(s), i) for i, s in plain.items()))[:5]
    assert [r.vec_id for r in out] == [i for _, i in best] and np.allclose([r.score for r in out], [-s for s, _ in best])


@pytest.mark.parametrize("centres", [3, 40])
def test_recall_on_clustered_vectors(spark, centres):
    rng = np.random.default_rng(15)
    middles = rng.normal(size=(centres, 32))
    vectors = (middles[rng.integers(centres, size=900)] + 0.2 * rng.normal(size=(900, 32))).astype(np.float32)
    out = nearest_vectors.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")).collect()
    units = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    got = defaultdict(set)
    for r in out:
        got[r.query_id].add(r.vec_id)
    for q in range(0, 900, 50):
        near = units @ units[q]
        near[q] = -2
        assert len(got[q] & set(np.argsort(-near)[:5].tolist())) >= 4
    assert sum(len(got[q] & set(np.argsort(-np.where(np.arange(900) == q, -2, units @ units[q]))[:5].tolist())) for q in range(0, 900, 50)) >= 0.9 * 90


def test_estimates_keep_their_bounds():
    rng = np.random.default_rng(9)
    units = rng.normal(size=(2000, 64))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    turn = nearest_vectors.rotation(64)
    codes, correction = nearest_vectors.encode(units, turn)
    guess, error = nearest_vectors.estimates(codes, correction, turn @ units[0])
    assert (np.abs(guess - units @ units[0]) > error)[1:].mean() < 0.01


def _fill(budget, children):
    """Water-filling by steps: children are (name, weight, limit)."""
    given = {n: 0.0 for n, _, _ in children}
    open_ = list(children)
    while open_ and budget > 1e-9:
        weight = sum(w for _, w, _ in open_)
        full = [c for c in open_ if given[c[0]] + budget * c[1] / weight >= c[2] - 1e-9]
        if not full:
            for n, w, _ in open_:
                given[n] += budget * w / weight
            break
        n, _, limit = min(full, key=lambda c: (c[2] - given[c[0]]) / c[1])
        step = (limit - given[n]) / next(w for m, w, _ in open_ if m == n) * weight
        for m, w, _ in open_:
            given[m] += step * w / weight
        budget -= step
        open_ = [c for c in open_ if c[0] != n]
    return given


@pytest.mark.parametrize("part", [0.2, 0.8, 1.9, 5.0])
def test_budgets_fill_siblings_before_ancestors(spark, part):
    leaves = [("web", "en", "src0", 1000), ("web", "en", "src4", 50), ("web", "de", "src0", 400), ("news", "en", "src1", 30),
              ("forum", "fr", "src2", 5000), ("other", "unknown", "x", 7)]
    table = spark.createDataFrame([(*x, 1) for x in leaves], "domain string, lang string, source string, tokens long, docs long")
    total = int(part * sum(x[3] for x in leaves))
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(table, total, 2).collect()}
    limit = lambda *p: sum(2 * x[3] for x in leaves if x[:len(p)] == p)
    top = _fill(total, [(d, mixing.DOMAIN_WEIGHTS.get(d, 1), limit(d)) for d in {x[0] for x in leaves}])
    for d in top:
        middle = _fill(top[d], [(g, mixing.LANGUAGE_WEIGHTS.get(g, 1), limit(d, g)) for g in {x[1] for x in leaves if x[0] == d}])
        for g in middle:
            low = _fill(middle[g], [(x[2], 1, limit(*x[:3])) for x in leaves if x[:2] == (d, g)])
            for s in low:
                assert abs(got[d, g, s] - low[s]) <= 3


def test_mix_takes_prefixes(spark):
    docs = odd.documents(spark)
    out = mixing.mix(docs).collect()
    streams = defaultdict(list)
    for r in out:
        streams[r.domain, r.lang, r.source].append((r.start, r.n_tokens, r.taken))
    for rows in streams.values():
        at = 0
        for start, n, taken in sorted(rows):
            assert start == at and 0 < taken <= n
            at += n
    assert mixing.mix(odd.documents(spark, [])).count() == 0
    rows = Counter(i for i, _ in odd.texts())
    assert all(n <= rows[i] for (i, _), n in Counter((r.doc_id, r.epoch) for r in out).items())


@pytest.mark.parametrize("name", sorted(queries.registered()[1]))
def test_query_matches_sql(spark, con, sf_dir, name):
    built, sql = queries.registered()
    assert difference(spark, con, built[name], sql[name], sf_dir) is None


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns, pieces = docs.columns, None
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES, 1):
        before, docs = docs, saved(stage(spark, docs, sf_dir))
        rows = {r.doc_id: r for r in before.collect()}
        if number < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
            kept = {r.doc_id for r in docs.collect()}
            assert kept <= set(rows) and docs.count() == len(kept)
        if name == "toxicity":
            assert kept == {r.doc_id for r in toxicity.score(before, labels).where("predicted = 0").collect()}
        elif name == "exact_dedup":
            groups = defaultdict(list)
            for i, r in rows.items():
                groups["".join((r.text or "").split())].append((-len(r.text or ""), i))
            assert kept == {min(g)[1] for g in groups.values()}
        elif name == "minhash_near_dedup":
            assert kept == {r.doc_id for r in near_dedup.near_duplicates(before).where("kept").collect()}
        elif name == "mixing":
            tokens = {i: len((r.text or "").split()) for i, r in rows.items()}
            assert 0.9 * sum(tokens.values()) <= sum(tokens[i] for i in kept) <= sum(tokens.values())
            assert all(tokens[i] for i in kept)
        else:
            pieces = docs.groupBy("doc_id").sum("length").collect()
            assert {r.doc_id for r in pieces} == set(rows)
    assert pieces


def test_pipeline_stages_take_odd_rows(spark, sf_dir):
    for rows in (None, []):
        for name, stage in corpus_pipeline.STAGES:
            docs = odd.documents(spark, rows)
            out = stage(spark, docs, sf_dir)
            assert name == "packing" or out.columns == docs.columns
            assert out.count() >= (rows is None)
