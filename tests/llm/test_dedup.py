"""Exact, near-duplicate and repeated-passage operators against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from earthframe.llm import exact_dedup, near_dedup, repeats
from earthframe.llm.rows import components, keep_rows

from . import odd

NO_ID = 2**63 - 1


def _plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("bits", [64, 1])
def test_exact_groups(spark, bits, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK", 50)
    out = exact_dedup.decide(odd.documents(spark), bits).collect()
    rows = odd.texts()
    assert len(out) == len(rows)
    groups = defaultdict(list)
    for doc, text in rows:
        groups[_plain(text)].append((-len(text or ""), NO_ID if doc is None else doc))
    expected = Counter()
    for doc, text in rows:
        best = min(groups[_plain(text)])[1]
        expected[(doc, None if best == NO_ID else best, len(groups[_plain(text)]), hashlib.sha256(_plain(text).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == expected
    assert sum(r.kept for r in out) == len(groups)


def test_exact_stage_keeps_one_row_of_each_text_with_its_columns(spark):
    docs = odd.documents(spark)
    kept = keep_rows(docs, exact_dedup.decide(docs).where("kept"), once=True)
    assert kept.columns == docs.columns
    texts = [_plain(r.text) for r in kept.collect()]
    assert Counter(texts) == Counter({_plain(t): 1 for _, t in odd.texts()})


def _sets(rows):
    out = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        out.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def _expected_components(rows):
    sets, parent = _sets(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: NO_ID)
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], NO_ID if doc is None else doc)
    return Counter((doc, len(sets[i]), None if least[find(i)] == NO_ID else least[find(i)],
                    (NO_ID if doc is None else doc) == least[find(i)]) for i, (doc, _) in enumerate(rows))


def test_near_duplicates(spark):
    out = near_dedup.near_duplicates(odd.documents(spark)).collect()
    assert Counter(map(tuple, out)) == _expected_components(odd.texts())


def test_near_duplicates_of_one_large_group_with_stragglers(spark):
    rng = np.random.default_rng(5)
    base = odd.words(90, 8)
    rows = []
    for i in range(250):
        text = list(base)
        for at in rng.choice(90, rng.integers(0, 6), replace=False):
            text[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(text)))
    out = near_dedup.near_duplicates(odd.documents(spark, rows)).collect()
    expected = _expected_components(rows)
    assert len({k[2] for k in expected}) > 3
    assert Counter(map(tuple, out)) == expected


def test_rare_pairs_lose_no_link(spark):
    rng = np.random.default_rng(6)
    rows, base = [], odd.words(60, 9)
    for i in range(60):
        text = list(base)
        for at in rng.choice(60, rng.integers(0, 4), replace=False):
            text[at] = f"e{i}x{at}"
        rows.append((i, " ".join(text[:60 - int(rng.integers(0, 8))])))
    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    sets, _, _ = near_dedup.shingle_sets(data, np.cumsum([0] + [len(t) for _, t in rows]))
    table = spark.createDataFrame([(i, len(s), i, bytearray(s.tobytes())) for i, s in enumerate(sets)],
                                  "cls long, n long, component long, shingles binary")
    found = {tuple(r) for r in near_dedup._rare_pairs(table).collect()}
    sets = [set(s.tolist()) for s in sets]
    linked = {(i, j) for j in range(60) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert linked and linked <= found


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 80)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(80)}}


def _expected_repeats(rows):
    """Rows in the operator's order; equal keys count as repeated rows."""
    seen, out = set(), []
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            if data[p:p + 100] in seen:
                gone[p:p + 100] = True
            else:
                seen.add(data[p:p + 100])
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("large", "memory"), [(4096, 50_000), (1, 50_000), (4096, 2)])
def test_repeats(spark, monkeypatch, large, memory):
    monkeypatch.setattr(repeats, "LARGE", large)
    monkeypatch.setattr(repeats, "IN_MEMORY", memory)
    rows = odd.texts()
    passage = " ".join(odd.words(60, 33))
    rows += [(100 + i, f"{odd.words(3, i)} {passage[i % 7:len(passage) - i % 5]} {odd.words(4, 900 + i)}") for i in range(30)]
    rows += [(200, passage * 3), (201, "z" * 350)]
    key = spark.createDataFrame([(t or "",) for _, t in rows], "text string").selectExpr("text", "xxhash64(text) AS h").collect()
    tag = {r.text: r.h for r in key}
    ordered = sorted(rows, key=lambda r: (NO_ID if r[0] is None else r[0], tag[r[1] or ""]))
    out = repeats.remove_repeats(odd.documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == _expected_repeats(ordered)


def test_one_of_repeated_rows_keeps_its_text(spark):
    long, other = " ".join(odd.words(90, 71)), " ".join(odd.words(90, 72))
    rows = [(1, long), (1, long), (1, long), (2, "before " + other), (None, other), (None, other), (3, " ".join(odd.words(90, 73)))]
    out = repeats.remove_repeats(odd.documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == _expected_repeats(rows)
    assert sorted(r.n_removed for r in out if r.doc_id == 1) == [0, len(long), len(long)]


def test_empty_tables(spark):
    none = odd.documents(spark, [])
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert repeats.remove_repeats(none).count() == 0


def test_merge_does_not_depend_on_batches():
    rng = np.random.default_rng(12)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        rows = sorted((int(rng.integers(0, 6)), int(rng.integers(0, 3)), int(rng.integers(0, 5)), 0, int(rng.integers(0, 50)))
                      for _ in range(n))
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        whole = pa.RecordBatch.from_arrays(
            [*columns, pa.array([0] * n, pa.int16()), pa.array([0] * n, pa.int16()), pa.array([True] * n)], schema=repeats._TUPLE)
        cuts = sorted({0, n, *rng.integers(0, n + 1, int(rng.integers(0, 8))).tolist()})
        out = [tuple(r[c] for c in ("sample", "stretch", "_doc", "place", "first"))
               for b in repeats._merged(iter([whole.slice(a, z - a) for a, z in zip(cuts, cuts[1:], strict=False)]))
               for r in b.to_pylist()]
        stretches = defaultdict(set)
        for sample, stretch, *_ in rows:
            stretches[sample].add(stretch)
        expected, seen = [], set()
        for sample, stretch, doc, _, place in rows:
            first = (sample, stretch) not in seen
            seen.add((sample, stretch))
            if not first or len(stretches[sample]) > 1:
                expected.append((sample, stretch, doc, place, first))
        assert Counter(out) == Counter(expected)
