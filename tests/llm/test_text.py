"""Toxicity, extraction, licenses, language model and packing."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from earthframe.llm import html_text, licenses, packing, suffix_tree_lm, toxicity

from . import odd


def _labelled(spark, n=400):
    rows, labels = [], []
    for i in range(n):
        text = odd.words(30, i)
        toxic = i % 8 == 0
        if toxic:
            text[5], text[17] = "Vile!", "viler,"
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (7, None), (10**6, 1)]
    return odd.documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_is_learned_from_the_permitted_labels(spark):
    docs, labels = _labelled(spark)
    out = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    assert {r.predicted for i, r in out.items() if i % 8 == 0} == {1} and {r.predicted for i, r in out.items() if i % 8} == {0}
    assert all(0 <= r.score <= 1 and (r.score >= 0.3) == r.predicted for r in out.values())
    assert all(zlib.crc32(str(e.doc_id).encode()) % 4 != 2 and e.toxic == (e.doc_id % 8 == 0) for r in out.values() for e in r.evidence)
    assert all(e.toxic for i, r in out.items() if i % 8 == 0 for e in r.evidence)
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in out.values())


def test_toxicity_of_odd_rows_and_without_labels(spark):
    _, labels = _labelled(spark)
    docs = odd.documents(spark)
    assert toxicity.score(docs, labels).count() == len(odd.texts())
    assert {r.predicted for r in toxicity.score(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.score(odd.documents(spark, []), labels).count() == 0


@pytest.mark.parametrize("frequent", [0, 3, 1000])
def test_nearest_examples_are_exact(monkeypatch, frequent):
    monkeypatch.setattr(toxicity, "FREQUENT", frequent)
    rng = np.random.default_rng(3)
    held = [(e, f"f{f}", int(rng.integers(1, 4))) for e in range(300) for f in rng.choice(12, 4, replace=False)]
    weight = {f"f{i}": 1 + i / 7 for i in range(12)}
    index = toxicity.build_index({e: e % 2 for e in range(300)}, weight, np.array([h[0] for h in held]), [h[1] for h in held],
                                 np.array([h[2] for h in held]))
    dense = np.zeros((300, 12))
    for e, f, n in held:
        dense[e, index.weight[f][0]] = (1 + math.log(n)) * weight[f]
    dense /= np.linalg.norm(dense, axis=1)[:, None]
    for turn in range(40):
        terms, own = rng.choice(12, 3, replace=False), rng.random(3) + 0.1
        own /= np.linalg.norm(own)
        exact = np.round(dense[:, terms] @ own, 12)
        rows = index.rows[terms]
        often = own[rows >= 0] @ toxicity.matrix(index)[rows[rows >= 0]]
        if turn % 2:
            exact[turn] = 0
        found = toxicity.nearest(index, terms, own, often, without=turn if turn % 2 else None)
        assert np.allclose([s for s, _ in found], np.sort(exact)[::-1][:15], atol=1e-12)
        assert all(np.isclose(exact[index.ids[e]], s) for s, e in found)


def _dense_scores(texts, toxic):
    """Score of each text by plain sums over all examples, none folded."""
    bags = {e: toxicity.features(texts[e]) for e in toxic}
    n, t = len(bags), sum(toxic.values())
    df, a = Counter(), Counter()
    for e, bag in bags.items():
        df.update(bag.keys())
        a.update({f: toxic[e] for f in bag})
    weight = {}
    for f in df:
        if df[f] >= 2:
            cells = [(a[f], df[f] * t / n), (df[f] - a[f], df[f] * (n - t) / n), (t - a[f], (n - df[f]) * t / n),
                     (n - t - df[f] + a[f], (n - df[f]) * (n - t) / n)]
            g = max(0.0, 2 * sum(o * math.log(o / x) for o, x in cells if o > 0))
            weight[f] = (math.log((1 + n) / (1 + df[f])) + 1) * (toxicity.FLOOR + g / (g + toxicity.STRENGTH))

    def unit(bag):
        v = {f: (1 + math.log(k)) * weight[f] for f, k in bag.items() if f in weight}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {f: x / length for f, x in v.items()}

    vectors = {e: unit(bag) for e, bag in bags.items()}
    prior = (t + 0.1) / (n + 1)

    def vote(text, without=None):
        q = unit(toxicity.features(text))
        near = sorted(((-sum(x * v.get(f, 0.0) for f, x in q.items()), e) for e, v in vectors.items() if e != without))[:toxicity.NEIGHBOURS]
        near = [(-s, e) for s, e in near if s < 0]
        return ((sum(s * toxic[e] for s, e in near) + toxicity.PRIOR_WEIGHT * prior)
                / (sum(s for s, _ in near) + toxicity.PRIOR_WEIGHT))

    ids = sorted(toxic)
    slope, shift = toxicity.calibrate(np.array([vote(texts[e], e) for e in ids]), np.array([toxic[e] for e in ids]))
    out = {}
    for i, text in texts.items():
        v = vote(text)
        out[i] = 1 / (1 + math.exp(-(slope * math.log(v / (1 - v)) + shift)))
    return out


def test_whole_scores_against_all_examples(spark):
    docs, labels = _labelled(spark)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    toxic = {r.doc_id: r.toxic for r in labels.collect()
             if r.toxic is not None and r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    exact = _dense_scores(texts, toxic)
    found = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    assert found.keys() == exact.keys() and all(abs(found[i] - exact[i]) < 1e-6 for i in exact)


def test_toxic_words_of_two_examples_each(spark):
    """A long tail: each toxic word stands in two examples, and the other toxic texts hold several of them."""
    learned = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 4 != 2]
    vile = [f"zq{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}x" for k in range(60)]
    common = odd.words(300, 5)
    rng = np.random.default_rng(8)
    rows = {i: [common[k] for k in rng.integers(0, 300, 25)] for i in range(2000)}
    toxic = learned[:40]
    for k, word in enumerate(vile):
        rows[toxic[(3 * k) % 40]].append(word)
        rows[toxic[(3 * k + 7) % 40]].append(word)
    others = [i for i in range(2000) if i not in set(learned)]
    for n, i in enumerate(others[:30]):
        rows[i] += [vile[(5 * n + 11 * m) % 60] for m in range(5)]
    docs = odd.documents(spark, [(i, " ".join(w)) for i, w in rows.items()])
    labels = spark.createDataFrame([(i, int(i in set(toxic))) for i in learned], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert {out[i].predicted for i in others[:30]} == {1}
    assert sum(out[i].predicted for i in others[30:]) <= 4
    assert len({out[i].score for i in others[30:]}) > 1


def test_near_copies_of_an_example_teach_once(spark):
    docs, labels = _labelled(spark)
    copy = [(i, " ".join(odd.words(40, 7)[:39] + [f"end{i}"])) for i in range(1000, 1040)]
    more = docs.unionByName(odd.documents(spark, copy))
    model = toxicity.fit(more, labels.union(spark.createDataFrame([(i, 0) for i, _ in copy], "doc_id long, toxic int")))
    assert sum(i >= 1000 for i in model.shared.value.ids.tolist()) == 1


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<div class="cookie-notice">We use cookies to follow you around the whole wide web.</div>
<nav><ul><li><a href="/">Home</a><li><a href="/a">About us and other things</a></ul></nav>
<article><h1>Title &amp; more</h1><p>First   paragraph of the article,<br>with a <a href="x">link</a> &eacute; &#x41; inside.
<p>Second one.<form>Write to us<input></form><div class="comments"><p>Reader comment that is long enough to count.</p></div></article>
<aside>Sidebar text that is long enough to be taken for content.</aside><footer>&copy; someone with a long name</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more First paragraph of the article, with a link é A inside. Second one."
    plain = re.sub("</?article>", "", PAGE)
    assert "First paragraph of the article" in html_text.main_text(plain)
    for word in ("cookies", "Home", "Sidebar", "someone", "comment"):
        assert word not in html_text.main_text(plain)


LINKS = "".join(f'<div><a href="/{i}">Link to another page {i}</a></div>' for i in range(5))
TEXT = "Plain sentences of the article that are long enough to surge. "


@pytest.mark.parametrize(("html", "held", "left_out"), [
    (f"<p>{TEXT * 40}</p>{LINKS}<p>Last part of it, less than a fifth as long as the first.</p>", ["Plain", "Last part"], ["Link"]),
    ("<p>Short page.</p>" + LINKS, ["Short page."], ["Link"]),
    (f"<article><p>{TEXT}</p>{LINKS}<p>The end.</p>{LINKS}</article>", ["Plain", "The end."], []),
    (f'<div class="layout with-sidebar has-ads share-enabled"><p>{TEXT}</p></div>', ["Plain"], []),
    (f'<div class="widget"><article><p>{TEXT}</p><p class="share">Noise</p></article></div>', ["Plain"], ["Noise"]),
    (f'<form><main><p>{TEXT}</p></main></form>', ["Plain"], []),
    (f'<article><p>{TEXT}</p></article><div class="related-items"><article>{TEXT.upper()}</article></div>', ["Plain"], ["PLAIN"]),
    (f'<p>{TEXT}</p><div class="main-sidebar layout">{TEXT.upper()}</div><p id="siteFooter">{TEXT.upper()}', ["Plain"], ["PLAIN"]),
    ("<article><figure><img><figcaption>What it shows</figcaption></figure><p>As <math><mi>x</mi><mo>=</mo><mn>2</mn></math> says",
     ["What it shows As x=2 says"], []),
])
def test_no_part_of_the_text_is_lost(html, held, left_out):
    found = html_text.main_text(f"<html><body>{html}</body></html>")
    assert all(x in found for x in held) and not any(x in found for x in left_out)


@pytest.mark.parametrize("html", ["", "<", "<p", "<!--", "<script>x", "plain words", "<div" * 5000, "<p>" * 20000, "</p>" * 20000,
                                  "<a title=\"" * 2000, "&" * 5000, "<div class=ad>" * 3000 + "x"])
def test_broken_pages_end(html):
    assert isinstance(html_text.main_text(html), str)


def test_extract_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", ""), (3, "w", "<p>" + "long text " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = html_text.extract(pages.withColumnRenamed("url", "url")).collect()
    assert Counter((r.page_id, r.url) for r in out) == Counter((r[0], r[1]) for r in rows)
    assert all(r.n_chars == len(r.text) for r in out)
    assert {r.n_chars for r in out if r.page_id in (None, 2)} == {0} and max(r.n_chars for r in out) == 499_999
    assert html_text.extract(pages.limit(0)).count() == 0


def test_licenses(spark):
    notice = licenses.TEMPLATES[3][1]
    cut = notice.split()
    rows = [(1, "words before. " + notice + " and after " * 30), (2, " ".join(odd.words(70, 1) + cut[:-4] + odd.words(9, 2))),
            (3, " ".join(cut[:8])), (4, "Released under the MIT License"), (5, "it was released under the mit license."),
            (6, " ".join(odd.words(4000, 5) + ["Licensed", "under", "CC", "BY-NC", "4.0"] + odd.words(4000, 6)))]
    found = {(r.doc_id, r.template) for r in licenses.scan(odd.documents(spark, rows + [(7, None), (None, "")])).collect()}
    assert found == {(1, 3), (2, 3), (4, 0), (5, 0), (6, 4)}
    assert licenses.scan(odd.documents(spark, [])).count() == 0
    assert licenses.scan(odd.documents(spark)).where("doc_id = 61").count() == 1


def test_licenses_of_all_kinds(spark):
    rows = [(1, "words before. All rights reserved. And after"), (2, "all rights"), (3, "// SPDX-License-Identifier: MPL-2.0\nint x;"),
            (4, "reserved all rights"), (5, "All Rights\nReserved"), (6, "All rights, here reserved")]
    named = ["BSD-2-Clause", "ISC", "MPL-2.0", "LGPL-2.1", "AGPL-3.0", "GPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "Unlicense"]
    notices = [(n, t) for n, t in licenses.TEMPLATES if n in named]
    rows += [(10 + i, " ".join([*odd.words(9, i), t, *odd.words(9, 50 + i)])) for i, (_, t) in enumerate(notices)]
    changed = next(t for n, t in licenses.TEMPLATES if n == "GPL-2.0" and len(t) > 10_000)
    rows.append((9, " ".join(w for i, w in enumerate(changed.split()) if i % 100)))
    found = defaultdict(set)
    for r in licenses.scan(odd.documents(spark, rows)).collect():
        found[r.doc_id].add(r.license)
    assert {n for n, _ in notices} == set(named)
    assert all(n in found[10 + i] for i, (n, _) in enumerate(notices))
    assert found[1] == found[5] == {"all-rights-reserved"} and found[3] == {"MPL-2.0"} and "GPL-2.0" in found[9]
    assert not (found[2] or found[4] or found[6])


def test_kindred_licenses_are_told_apart(spark):
    whole = {n: t for n, t in licenses.TEMPLATES if len(t) > 1000}
    header = next(t for n, t in licenses.TEMPLATES if n == "GPL-3.0" and t.startswith("This program"))
    rows = [(1, "This work is licensed under the GNU General Public License, version 2"), (2, header), (3, header.replace("version 3", "version 2")),
            (4, whole["BSD-3-Clause"]), (5, whole["GFDL-1.2"]), (6, whole["LGPL-2.1"])]
    found = defaultdict(set)
    for r in licenses.scan(odd.documents(spark, rows)).collect():
        found[r.doc_id].add(r.license)
    assert found[1] == found[3] == {"GPL-2.0"} and found[2] == {"GPL-3.0"}
    assert "BSD-2-Clause" not in found[4] and "GFDL-1.3" not in found[5] and "LGPL-2.0" not in found[6]


def _tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) + [None]


def test_language_model(spark):
    rng = np.random.default_rng(1)
    rows = list(odd.texts())
    for i in range(400):
        order = [f"w{k}" for k in rng.integers(0, 40, 30)]
        rows.append((1000 + i, " ".join(x for w in order for x in (w, w + "next"))))
    out = suffix_tree_lm.score(odd.documents(spark, rows)).collect()
    assert len(out) == len(rows)
    held = [doc is not None and zlib.crc32(str(doc).encode()) % 10 == 0 for doc, _ in rows]
    c = Counter(t for (_, text), h in zip(rows, held, strict=True) if not h for t in _tokens(text))
    total = sum(c.values())
    expected = defaultdict(list)
    for (doc, text), h in zip(rows, held, strict=True):
        t = _tokens(text)
        expected[(doc, h, len(t), sum(c[x] > 0 for x in t), total)].append(
            round(sum(math.log10((c[x] + 0.1) / (total + 0.1 * (len(c) + 1))) for x in t), 5))
    got = defaultdict(list)
    for r in out:
        got[(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens)].append(round(r.base_score, 5))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    fresh = [r for r in out if r.held_out and r.doc_id >= 1000]
    assert fresh and all(r.score > r.base_score + 10 for r in fresh)
    assert suffix_tree_lm.score(odd.documents(spark, [])).count() == 0


def test_every_state_is_a_distribution(spark):
    rows = odd.documents(spark, [(i, " ".join(odd.words(6, i % 5) + odd.words(5, i % 3))) for i in range(60)]).selectExpr("text", "false AS held_out")
    counts = Counter(t for r in rows.collect() for t in _tokens(r.text))
    table = _hashed(counts)
    alphabet = suffix_tree_lm.fit_alphabet(spark.createDataFrame(table, "token long, ending long, c long"), sum(counts.values()), len(counts))
    tree = suffix_tree_lm.fit_tree(rows, alphabet)
    assert len(tree.keys) > 5
    for state in range(len(tree.keys) + 1):
        p = 10.0 ** suffix_tree_lm.log_probability(tree, np.full(alphabet.start, state), np.arange(alphabet.start))
        assert abs(p.sum() - 1) < 1e-6


def _hashed(counts):
    out = []
    for token, c in counts.items():
        if token is None:
            out.append((int(suffix_tree_lm.END.astype(np.int64)), -1, c))
        else:
            data = np.frombuffer(token.encode(), np.uint8)
            hashes, endings, _ = suffix_tree_lm._sequences(data, np.array([0, len(data)]))
            out.append((int(hashes[:1].view(np.int64)[0]), int(endings[0]), c))
    return out


def test_packing(spark):
    own = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows = odd.texts() + [(1000 + i, ". ".join(odd.words(40, i)) + ".\n") for i in range(300)]
    out = packing.pack(odd.documents(spark, rows).coalesce(2)).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append((r.doc_tokens, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc in {d for d, _ in rows}:
        texts = [own.encode(t or "", add_special_tokens=False).ids + [0] for d, t in rows if d == doc]
        assert sum(p[2] for p in pieces[doc]) == sum(map(len, texts))
        crcs = {(len(ids), s, n): zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes()) for ids in texts for _, s, n, _ in pieces[doc]}
        if len(texts) == 1:
            assert all(crcs[total, s, n] == crc for total, s, n, crc in pieces[doc])
            at = 0
            for total, s, n, _ in sorted(pieces[doc]):
                assert total == len(texts[0]) and s == at and n > 0
                at += n
            assert at == len(texts[0])
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= 1024
        total += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 0.02 * total
    assert packing.pack(odd.documents(spark, [])).count() == 0


def test_best_cuts_are_best(monkeypatch):
    monkeypatch.setattr(packing, "POWERS", (8, 16, 128))
    rng = np.random.default_rng(2)
    for _ in range(40):
        places = np.unique(np.concatenate([[0], np.cumsum(rng.integers(1, 9, 40))]))
        costs = rng.integers(0, 6, len(places))
        limit = 32

        def price(a, b):
            size = b - a
            return 0 if size in (8, 16) else limit - size

        best = [0] + [10**9] * (len(places) - 1)
        for k in range(1, len(places)):
            for i in range(k):
                if places[k] - places[i] <= limit:
                    best[k] = min(best[k], best[i] + price(places[i], places[k]) + costs[k] + packing.SEQUENCE)
        chosen = packing.best_cuts(places, costs, limit)
        cost = dict(zip(places.tolist(), costs.tolist(), strict=True))
        got = sum(price(a, b) + cost[b] + packing.SEQUENCE for a, b in zip(chosen, chosen[1:], strict=False))
        assert chosen[0] == 0 and chosen[-1] == places[-1] and got == best[-1]
