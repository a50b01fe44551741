"""Toxicity by the nearest labelled examples under TF-IDF cosine.

Fitting takes a bounded sample of the labelled rows and folds confirmed near copies. Each example is its TF-IDF vector over all words, and
word beginnings of four characters, that two examples hold; the idf of a feature is multiplied by how surely it goes with either label, so
rare and common words without bearing on the label count little but are never left out. The examples form an inverted index whose
posting lists are cut into blocks of 64 examples with the largest weight of each block. A text finds its nearest
examples exactly: the block maxima bound what any example of a block can reach, the blocks of the highest bounds are
read first, and then those whose bound reaches the worst of the neighbours found. Neighbours vote with their cosine as weight against the share of
toxic examples, and votes become probabilities by a logistic curve fitted on the examples, each scored without itself.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earthframe.lineage import saved
from earthframe.llm.bytesets import slices, texts
from earthframe.llm.near_dedup import _confirm, shingle_sets, signatures
from earthframe.llm.rows import arrow_map

#: Labelled rows that are fitted on, and neighbours asked.
EXAMPLES, NEIGHBOURS = 4_096, 15
BLOCK, BEGINNING = 64, 4
#: Examples that must hold a feature; the strength of association (a G statistic) at which a feature has half its full weight; the
#: part of its weight that it has without any.
SUPPORT, STRENGTH, FLOOR = 2, 18.0, 0.01
#: Weight of the prior in a vote, as a sum of cosines.
PRIOR_WEIGHT = 0.25
#: Pull of the calibration towards the votes themselves, in squared units of its two numbers.
PULL = 1.0
THRESHOLD = 0.3
#: MinHash symbols by which near copies among the examples meet; at a similarity of 0.75 one pair in 65,000 meets in none.
MARKS = 8
#: Blocks of the highest bounds, read first; then all that still may hold one of the nearest.
FIRST_BLOCKS = 16
#: Features are frequent if one example in so many holds them; texts whose frequent features are summed at once.
FREQUENT, TOGETHER = 32, 64
#: Words whose features a task remembers.
REMEMBERED = 500_000

_EDGE = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum())


def terms(word: str) -> tuple[str, ...]:
    """Features of a lower-case word: itself without marks at its edges, and its beginning if it is longer (marked by a hyphen)."""
    word = word.strip(_EDGE)
    return (word, word[:BEGINNING] + "-") if len(word) > BEGINNING else (word,) if word else ()


def features(text: str) -> Counter:
    found: Counter = Counter()
    for word, n in Counter(text.lower().split()).items():
        for term in terms(word):
            found[term] += n
    return found


def _features(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Features of each example."""
    for text, example, label in zip(texts(batch.column("text")), batch.column("example"), batch.column("toxic"), strict=True):
        found = features(text.as_py())
        yield pa.RecordBatch.from_arrays(
            [pa.array([example.as_py()] * len(found), pa.int64()), pa.array([label.as_py()] * len(found), pa.int32()),
             pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["example", "toxic", "feature", "n"])


def _prints(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """MinHash symbols and shingles of each example that has words."""
    for rows, data, offsets in slices(batch):
        sets, _, _ = shingle_sets(data, offsets)
        full = np.flatnonzero([len(s) for s in sets])
        sets = [sets[i] for i in full]
        rows = rows.take(pa.array(full))
        yield pa.RecordBatch.from_arrays(
            [rows.column("example"), rows.column("toxic"), pa.array(signatures(sets)[:, :MARKS].astype(np.int32).tolist(), pa.list_(pa.int32())),
             pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "toxic", "marks", "shingles"])


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learned from: crc32 of the doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Index(NamedTuple):
    """Block-max inverted index over the examples.

    A feature's entries, one for each block that its list touches, stand from ``starts[f]`` to ``starts[f + 1]``; an
    entry's postings from ``at[e]`` to ``at[e + 1]``. Features that one example in FREQUENT hold have no entries: ``rows`` gives them a row each (-1 for the others) of the matrix that ``often`` lists (row, example,
    weight), and are summed for many texts by one product.
    """

    weight: dict[str, tuple[int, float]]  # number and weight of each feature
    starts: np.ndarray
    blocks: np.ndarray  # of entries
    maxima: np.ndarray
    at: np.ndarray
    examples: np.ndarray  # postings: example numbers and weights
    weights: np.ndarray
    rows: np.ndarray
    often: tuple[np.ndarray, np.ndarray, np.ndarray]
    labels: np.ndarray  # of example numbers
    ids: np.ndarray
    prior: float


class Model(NamedTuple):
    """The index, sent to the executors once, and the calibration of its votes."""

    shared: Broadcast
    slope: float
    shift: float


def build_index(examples: dict[int, int], weight: dict[str, float], ids: np.ndarray, names: list[str], times: np.ndarray) -> Index:
    """``examples`` are labels by id, ``weight`` by feature; ``ids``, ``names`` and ``times`` say how often an example holds a feature."""
    number = {f: i for i, f in enumerate(sorted(weight))}
    known = np.array(sorted(examples), np.int64)
    row = np.searchsorted(known, np.asarray(ids, np.int64))
    column = np.fromiter((number[f] for f in names), np.int64, len(names))
    full = np.array([weight[f] for f in sorted(weight)])
    held = (1 + np.log(np.asarray(times, np.float64))) * full[column] if len(row) else np.zeros(0)
    held = held / np.sqrt(np.bincount(row, held * held, len(known)))[row]
    # Alike in label and size, the examples of a block have maxima near what each of them reaches.
    labels = np.array([examples[e] for e in known.tolist()], np.int64)
    order = np.lexsort((known, np.bincount(row, minlength=len(known)), labels))
    place = np.empty(len(known), np.int64)
    place[order] = np.arange(len(known))
    row = place[row]
    frequent = np.flatnonzero(np.bincount(column, minlength=len(number)) * FREQUENT >= len(known))
    rows = np.full(len(number), -1)
    rows[frequent] = np.arange(len(frequent))
    often = rows[column] >= 0
    common = rows[column[often]].astype(np.int32), row[often].astype(np.int32), held[often]
    row, column, held = row[~often], column[~often], held[~often]
    by = np.lexsort((row, column))
    row, column, held = row[by], column[by], held[by]
    key = column * (len(known) // BLOCK + 1) + row // BLOCK
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return Index({f: (i, weight[f]) for f, i in number.items()}, np.searchsorted(column[first], np.arange(len(number) + 1)),
                 (row[first] // BLOCK).astype(np.int32), np.maximum.reduceat(held, first) if len(first) else held,
                 np.append(first, len(row)).astype(np.int64), row.astype(np.int32), held, rows, common, labels[order], known[order],
                 (labels.sum() + 0.1) / (len(labels) + 1))


def matrix(index: Index) -> np.ndarray:
    """Weights of the frequent features (rows) in all examples."""
    row, example, weight = index.often
    full = np.zeros((int((index.rows >= 0).sum()), len(index.ids)))
    full[row, example] = weight
    return full


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges ``lo[i] .. hi[i] - 1``, one after another."""
    sizes = hi - lo
    return np.arange(int(sizes.sum())) + np.repeat(lo - np.cumsum(sizes) + sizes, sizes)


def nearest(index: Index, terms: np.ndarray, own: np.ndarray, frequent: np.ndarray, k: int = NEIGHBOURS,
            without: int | None = None) -> list[tuple[float, int]]:
    """(cosine, example number) of the ``k`` examples of the largest cosine above 0, nearest first, ties to the smaller id.

    ``terms`` and ``own`` are the text's unit vector and ``frequent`` what its frequent features give each example, which is in the
    bounds as it is. ``without`` is the id of an example that takes no part.
    """
    lo, hi = index.starts[terms], index.starts[terms + 1]
    entries, own = _ranges(lo, hi), np.repeat(own, hi - lo)
    blocks = index.blocks[entries]
    bound = np.bincount(blocks, own * index.maxima[entries], (len(index.ids) - 1) // BLOCK + 1)
    bound = bound + np.maximum.reduceat(frequent, np.arange(0, len(frequent), BLOCK))
    # What is summed so far never exceeds a cosine, so its k-th largest is reached by the k nearest.
    scores, unread, least = frequent.copy(), np.ones(len(bound), bool), 0.0
    if without is not None:
        scores[index.ids == without] = -2.0  # below what other features can make up for
    first = np.argpartition(-bound, FIRST_BLOCKS)[:FIRST_BLOCKS] if len(bound) > FIRST_BLOCKS else np.arange(len(bound))
    for take in (first, None):
        if take is None:
            take = np.flatnonzero(unread & (bound >= least - 1e-12))
        wanted = np.zeros(len(bound), bool)
        wanted[take], unread[take] = True, False
        now = np.flatnonzero(wanted[blocks])
        held = entries[now]
        start, end = index.at[held], index.at[held + 1]
        postings = _ranges(start, end)
        scores = scores + np.bincount(index.examples[postings], np.repeat(own[now], end - start) * index.weights[postings], len(scores))
        least = max(0.0, np.partition(scores, -k)[-k]) if len(scores) >= k else 0.0
    found = np.flatnonzero((scores >= least - 1e-12) & (scores > 0))
    found = found[np.lexsort((index.ids[found], -scores[found]))][:k]
    return [(float(scores[e]), int(e)) for e in found]


def calibrate(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve over the log odds of votes, by Newton's steps; pulled towards 1 and 0."""
    if not len(votes):
        return 1.0, 0.0
    x = np.stack([np.log(votes / (1 - votes)), np.ones(len(votes))], 1)
    start = np.array([1.0, 0.0])
    at = start.copy()

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((np.logaddexp(0, z) - labels * z).sum() + PULL / 2 * ((b - start) ** 2).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        slope = x.T @ (p - labels) + PULL * (at - start)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + PULL * np.eye(2), slope)
        size = 1.0
        while loss(at - size * step) > loss(at) and size > 1e-6:
            size /= 2
        at = at - size * step
        if np.abs(step).max() < 1e-10:
            break
    return max(float(at[0]), 0.0), float(at[1])


def _examples(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """At most EXAMPLES rows (example, toxic, text).

    An example goes if it is a confirmed near copy of one of the same label with a smaller id, so the smallest of each group of
    copies stays. Those with one MinHash symbol of eight in common are held against the smallest of them.
    """
    known = (labels.select(F.col("doc_id").cast("bigint").alias("example"), F.col("toxic").cast("int").alias("toxic"))
             .where("example IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("example")))
             .groupBy("example").agg(F.max("toxic").alias("toxic")))
    chosen = known.orderBy(F.xxhash64("example"), "example").limit(EXAMPLES)  # the bound that makes it broadcastable
    rows = docs.select(F.col("doc_id").cast("bigint").alias("example"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    longest = F.max(F.struct(F.length("text").alias("size"), "text"))["text"]
    told = saved(rows.join(F.broadcast(chosen), "example").groupBy("example", "toxic").agg(longest.alias("text")))
    prints = saved(arrow_map(told, _prints, "cls bigint, toxic int, marks array<int>, shingles binary"))
    marks = prints.select("cls", "toxic", F.posexplode("marks").alias("place", "mark"))
    heads = marks.groupBy("toxic", "place", "mark").agg(F.min("cls").alias("a"))
    pairs = marks.join(heads, ["toxic", "place", "mark"]).where("a < cls").select("a", F.col("cls").alias("b")).distinct()
    copies = _confirm(pairs, prints.select("cls", "shingles")).select(F.col("b").alias("example"))
    return saved(told.join(copies, "example", "left_anti"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The index with its calibration over at most EXAMPLES labelled rows, chosen in the order of a hash of their ids.

    A doc_id with several labels counts as toxic if one of them says so, and of a repeated id the longest text teaches; labels other than 0
    and 1, or not of an existing row, teach nothing.
    """
    examples = _examples(docs, labels)
    told = saved(arrow_map(examples, _features, "example bigint, toxic int, feature string, n bigint"))
    known = {r.example: r.toxic for r in examples.select("example", "toxic").collect()}
    total, toxic = float(len(known)), float(sum(known.values()))
    a, df = F.col("a"), F.col("df")

    def part(observed: Column, share: float) -> Column:
        return F.when(observed > 0, observed * F.log(observed / share)).otherwise(0.0)

    strength = 2 * (part(a, toxic / total) + part(df - a, 1 - toxic / total) - part(df, 1.0)
                    + part(F.lit(toxic) - a, toxic / total) + part(F.lit(total - toxic) - df + a, 1 - toxic / total)
                    - part(F.lit(total) - df, 1.0)) if 0 < toxic < total else F.lit(0.0)
    strength = F.greatest(strength, F.lit(0.0))
    seen = (told.groupBy("feature").agg(F.count("*").cast("double").alias("df"), F.sum("toxic").cast("double").alias("a"))
            .where(df >= SUPPORT).select("feature", ((F.log((1 + total) / (1 + df)) + 1)
                                                     * (FLOOR + strength / (strength + STRENGTH))).alias("weight")))
    seen = saved(seen)
    kept = seen.toArrow()
    held = told.join(seen.select("feature"), "feature").select("example", "feature", "n").toArrow()
    index = build_index(known, dict(zip(kept.column("feature").to_pylist(), kept.column("weight").to_pylist(), strict=True)),
                        held.column("example").to_numpy(), held.column("feature").to_pylist(), held.column("n").to_numpy())
    shared = examples.sparkSession.sparkContext.broadcast(index)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words = Lookup(shared.value)
        cast = [v for v, _ in votes(words, texts(batch.column("text")).to_pylist(), batch.column("example").to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(cast, pa.float64()), batch.column("toxic")], ["vote", "toxic"])

    # The table has fewer rows than a task of texts usually has: it is dealt by hash to be scored side by side.
    dealt = examples.repartition(examples.sparkSession.sparkContext.defaultParallelism, "example")
    cast = arrow_map(dealt, run, "vote double, toxic int").toArrow()
    slope, shift = calibrate(cast.column("vote").to_numpy(), cast.column("toxic").to_numpy())
    return Model(shared, slope, shift)


class Lookup(dict):
    """Feature numbers of a word as it stands in a text, and ``full``, the weight of each feature; remembers the words it has seen."""

    def __init__(self, index: Index):
        super().__init__()
        self.index = index
        self.often = matrix(index)
        self.full = np.zeros(len(index.weight))
        for number, weight in index.weight.values():
            self.full[number] = weight

    def __missing__(self, word: str) -> tuple:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = tuple(self.index.weight[f][0] for f in terms(word) if f in self.index.weight)
        return found


def vector(words: Lookup, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and weights of a text, of length 1; empty if it shares no feature with two examples."""
    counted = Counter(text.lower().split())
    found = [words[word] for word in counted]
    sizes = [len(f) for f in found]
    terms, place = np.unique(np.array(list(chain.from_iterable(found)), np.int64), return_inverse=True)
    times = np.bincount(place, np.repeat(np.fromiter(counted.values(), np.float64, len(counted)), sizes), len(terms))
    own = (1 + np.log(times)) * words.full[terms]
    return terms, own / (math.sqrt(own @ own) or 1.0)


def votes(words: Lookup, whole: list[str], without: list[int] | None = None) -> Iterator[tuple[float, list[tuple[float, int]]]]:
    """Vote on each text and the neighbours that cast it."""
    index = words.index
    for at in range(0, len(whole), TOGETHER):
        vectors = [vector(words, text) for text in whole[at:at + TOGETHER]]
        often = np.zeros((len(vectors), len(words.often)))
        for i, (terms, own) in enumerate(vectors):
            rows = index.rows[terms]
            often[i, rows[rows >= 0]] = own[rows >= 0]
        often = often @ words.often
        for i, (terms, own) in enumerate(vectors):
            found = nearest(index, terms, own, often[i], without=without[at + i] if without else None) if len(terms) else []
            weight = sum(s for s, _ in found)
            toxic = sum(s * int(index.labels[e]) for s, e in found)
            yield float((toxic + PRIOR_WEIGHT * index.prior) / (weight + PRIOR_WEIGHT)), found


def probability(slope: float, shift: float, value: float) -> float:
    """A vote as the probability of label 1."""
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, slope * math.log(value / (1 - value)) + shift))))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, evidence (nearest examples: doc_id, cosine, toxic).

    Null and empty texts, and texts that share no feature with any example, get the score of the prior. With labels of one kind only every
    neighbour votes alike; without any every text gets the prior, 0.1. Repeated rows get equal scores. Only the text is
    scored; an empty table gives an empty result.
    """
    shared, slope, shift = fit(docs, labels)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words, index = Lookup(shared.value), shared.value
        scores, evidence = [], []
        for value, found in votes(words, texts(batch.column("text")).to_pylist()):
            scores.append(probability(slope, shift, value))
            evidence.append([{"doc_id": int(index.ids[e]), "cosine": s, "toxic": int(index.labels[e])} for s, e in found[:3]])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()),
             pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()),
             pa.array(evidence, pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())])))],
            ["doc_id", "held_out", "score", "predicted", "evidence"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id bigint, held_out boolean, score double, predicted int, "
                                "evidence array<struct<doc_id: bigint, cosine: double, toxic: int>>")


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their own columns, that score below the threshold."""
    shared, slope, shift = fit(docs, labels)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words = Lookup(shared.value)
        clean = [probability(slope, shift, v) < THRESHOLD for v, _ in votes(words, texts(batch.column("text")).to_pylist())]
        yield batch.filter(pa.array(clean, pa.bool_()))

    return arrow_map(docs, run, docs.schema)
