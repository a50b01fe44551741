"""Near-duplicate documents: a multi-index Hamming join of b-bit MinHash signatures.

A text is the set of its distinct runs of five words. Its signature holds 80 MinHash values cut to 16 bits,
read as 16 chunks of 5 symbols. Two signatures that differ in at most 31 of the 80 symbols agree in one chunk
up to one symbol (pigeonhole: 32 errors are needed to put two into every chunk), and each chunk is indexed
under its five "one symbol left out" forms, so every such pair meets in an index entry. Two texts of
similarity 0.75 differ in 20 symbols on average; one that differs in more is still met unless all 16 chunks
hold two errors, which has a chance of 1e-7. Links are confirmed on the full sets.

Texts with the same word sequence are one class, so copies are never paired. In an index entry only links to
its most central class (the one that meets most others anywhere) are tried first. Classes of one entry that are then
still in different components are compared if their sizes and their rarest shingles allow a link at all: shingles are ordered
by how many of these classes hold them, and two sets that are similar enough share one among the first few of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earthframe.lineage import saved
from earthframe.llm import bytesets as bs
from earthframe.llm.rows import NO_ID, arrow_map, components, keyed

WORDS = 5
CHUNKS, SYMBOLS = 16, 5
SIMILARITY = 75

_rng = np.random.Generator(np.random.PCG64(7_001))
_XOR = _rng.integers(0, 2**64, CHUNKS * SYMBOLS, dtype=np.uint64)
_TIMES = _rng.integers(0, 2**64, CHUNKS * SYMBOLS, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(0, 2**64, WORDS, dtype=np.uint64) | np.uint64(1)
_KEY = _rng.integers(0, 2**64, (CHUNKS, SYMBOLS), dtype=np.uint64) | np.uint64(1)
_SLOT = _rng.integers(0, 2**64, (CHUNKS, SYMBOLS), dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and two independent hashes of its word sequence."""
    hashed, count = bs.word_hashes(data, offsets)
    ends = np.cumsum(count)
    starts = ends - count
    whole = [bs.span_hash(np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * bs._power("up", len(h)))]), starts, ends)
             for h in (hashed, bs.mix(hashed ^ _XOR[0]))]
    n = max(0, len(hashed) - WORDS + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(WORDS):
        runs += hashed[k:k + n] * _PLACE[k]
    runs = bs.mix(runs)
    sets = [np.unique(runs[s:e - WORDS + 1]) if e - s >= WORDS else whole[0][i:i + 1] if e > s else runs[:0]
            for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True))]
    return sets, whole[0], whole[1]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 16-bit symbols for each set; sets must not be empty."""
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]]) if sets else np.zeros(0, int)
    out = np.zeros((len(sets), CHUNKS * SYMBOLS), np.uint16)
    for k in range(CHUNKS * SYMBOLS if sets else 0):
        least = np.minimum.reduceat((every ^ _XOR[k]) * _TIMES[k], starts)
        out[:, k] = (bs.mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def index_keys(signature: np.ndarray) -> np.ndarray:
    """The 80 index entries of each signature: every chunk with each of its symbols left out."""
    part = signature.reshape(len(signature), CHUNKS, SYMBOLS).astype(np.uint64) + np.uint64(1)
    part = part * _KEY
    return bs.mix(part.sum(axis=2, keepdims=True) - part + _SLOT).reshape(len(signature), -1)


def _prints(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in bs.slices(batch):
        sets, one, two = shingle_sets(data, offsets)
        full = np.flatnonzero([len(s) for s in sets])
        marks: list = [None] * len(sets)
        for i, mark in zip(full.tolist(), signatures([sets[i] for i in full]), strict=True):
            marks[i] = mark.tobytes()
        yield pa.RecordBatch.from_arrays(
            [rows.column("_doc"), rows.column("_tag"), rows.column("doc_id"),
             pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
             pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary())],
            ["_doc", "_tag", "doc_id", "one", "two", "n_shingles", "signature"])


def _keys(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    marks = batch.column("signature").to_pylist()
    for at in range(0, len(marks), 1000):
        part = marks[at:at + 1000]
        keys = index_keys(np.frombuffer(b"".join(part), np.uint16).reshape(len(part), -1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.ravel().view(np.int64)),
             pa.array(np.repeat(batch.column("cls").to_numpy()[at:at + 1000], keys.shape[1])),
             pa.array(np.repeat(batch.column("n_shingles").to_numpy()[at:at + 1000], keys.shape[1]))],
            ["key", "cls", "n"])


def _sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in bs.slices(batch):
        sets, _, _ = shingle_sets(data, offsets)
        yield pa.RecordBatch.from_arrays(
            [rows.column("cls"), pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "shingles"])


def _linked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    good = []
    for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
        x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
        both = len(np.intersect1d(x, y, assume_unique=True))
        good.append(100 * both >= SIMILARITY * (len(x) + len(y) - both))
    yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets are similar enough."""
    x = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
    return saved(arrow_map(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y"), _linked, "a bigint, b bigint"))


def _fits(one: str, two: str) -> F.Column:
    """Sizes that allow the similarity at all."""
    return 100 * F.least(one, two) >= SIMILARITY * F.greatest(one, two)


def _shingles(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i in range(batch.num_rows):
        own = np.frombuffer(batch.column("shingles")[i].as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(own), batch.column(c)[i].as_py())) for c in ("cls", "n", "component")] + [pa.array(own)],
            ["cls", "n", "component", "shingle"])


def _rare_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``classes`` in different components that may be similar enough.

    Of two sets with sizes x and y that are, at least 3 (x + y) / 7 shingles are common, so the rarest common one
    is among the first ``size - that + 1`` of both in any one order of the shingles.
    """
    held = saved(arrow_map(classes.select("cls", "n", "component", "shingles"), _shingles,
                           "cls bigint, n bigint, component bigint, shingle bigint"))
    often = held.groupBy("shingle").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("cls").orderBy("often", "shingle"))
    first = saved(held.join(often, "shingle").withColumn("rank", rank)
                  .where((F.col("often") > 1) & (100 * (F.col("rank") - 1) <= (100 - SIMILARITY) * F.col("n"))))
    x = first.select("shingle", F.col("cls").alias("a"), "n", "rank", "component")
    y = first.select("shingle", F.col("cls").alias("b"), F.col("n").alias("m"), F.col("rank").alias("place"),
                     F.col("component").alias("other"))
    common = F.ceil((F.col("n") + F.col("m")) * SIMILARITY / (100.0 + SIMILARITY) - 1e-9)
    near = (F.col("rank") <= F.col("n") - common + 1) & (F.col("place") <= F.col("m") - common + 1)
    return (x.join(y, "shingle").where("a < b AND component <> other").where(_fits("n", "m")).where(near)
            .select("a", "b").distinct())


def decide(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with the keys of the rows, and ``chosen``: the row, or repeated rows, that stand for a component.

    Texts without words are linked with nothing, texts of fewer than five words by their whole word sequence.
    Rows that repeat a doc_id are texts of their own with that id. ``component_id`` is the smallest doc_id of
    the component; rows with a null doc_id count as larger than any id, so it is null only where all of them
    are null, and then all of them are kept. An empty table gives an empty result.
    """
    rows = keyed(docs)
    prints = saved(arrow_map(rows, _prints, "_doc bigint, _tag bigint, doc_id bigint, one bigint, two bigint, "
                                            "n_shingles bigint, signature binary"))
    classes = saved(prints.where("n_shingles > 0").groupBy("one", "two")
                    .agg(F.min(F.struct("_doc", "_tag")).alias("first"), F.first("n_shingles").alias("n_shingles"),
                         F.first("signature").alias("signature"))
                    .select(F.monotonically_increasing_id().alias("cls"), "one", "two", "first", "n_shingles", "signature"))
    keys = arrow_map(classes.select("cls", "n_shingles", "signature"), _keys, "key bigint, cls bigint, n bigint")
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = saved(keys.join(shared, "key"))
    central = saved(members.groupBy("cls").agg(F.sum("size").alias("meets")))
    hubs = saved(members.join(central, "cls").groupBy("key")
                 .agg(F.max(F.struct("meets", (-F.col("cls")).alias("cls"), "n")).alias("hub"))
                 .select("key", (-F.col("hub.cls")).alias("hub"), F.col("hub.n").alias("m")))
    stars = saved(members.join(hubs, "key").where("cls <> hub").where(_fits("n", "m"))
                  .groupBy(F.col("hub").alias("a"), F.col("cls").alias("b")).agg(F.count("*").alias("entries")))
    sets = saved(arrow_map(
        central.select("cls").join(classes, "cls").select("cls", "first._doc", "first._tag")
        .join(rows, ["_doc", "_tag"]).groupBy("cls").agg(F.first("text").alias("text")), _sets, "cls bigint, shingles binary"))

    # Each class is first held against the entry head that it shares most with, then against the other heads
    # of other components, then against what else of its entries is still apart.
    tried = stars.groupBy("b").agg(F.max_by("a", F.struct("entries", -F.col("a"))).alias("a")).select("a", "b")
    links = _confirm(tried, sets)
    label = saved(components(links))

    def labelled(df: DataFrame, node: str, name: str) -> DataFrame:
        joined = df.join(label.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left")
        return joined.withColumn(name, F.coalesce(name, node))

    apart = labelled(labelled(stars.select("a", "b"), "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")
    links = links.union(_confirm(apart, sets))
    label = saved(components(links))

    mixed = saved(labelled(members.select("key", "cls", "n"), "cls", "component"))
    several = mixed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    open_ = mixed.join(several.select("key"), "key").select("cls", "n", "component").distinct()
    links = links.union(_confirm(_rare_pairs(open_.join(sets, "cls")), sets))
    label = saved(components(links))

    groups = saved(labelled(classes.select("cls", "one", "two", "first"), "cls", "component"))
    least = groups.groupBy("component").agg(F.min("first").alias("least"))
    ids = saved(groups.join(least, "component").select("one", "two", "least"))
    out = prints.join(ids, ["one", "two"], "left")
    own = F.struct("_doc", "_tag")
    least = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(own)
    component = least["_doc"]
    return out.select("_doc", "_tag", "doc_id", "n_shingles", F.when(component != NO_ID, component).alias("component_id"),
                      (F.col("_doc") == component).alias("kept"), (own == least).alias("chosen"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept; see ``decide``."""
    return decide(docs).select("doc_id", "n_shingles", "component_id", "kept")
