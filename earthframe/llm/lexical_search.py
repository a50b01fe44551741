"""Ranked lexical search over bit-sliced Bloom signatures.

Each document has a Bloom signature of its (term, frequency class) pairs; signatures are as wide as the number of terms asks for and
are stored by slices: one bitmap over the documents of a block for each signature bit. For a term of a query the slices of
its bits are combined by AND into a bitmap of the documents that may hold the term in that class, never missing one that does. The term's weight
times the class's largest possible frequency part, summed over the bitmaps, is an upper bound of each document's score.

Blocks of documents meet blocks of queries. A first pass takes each query's documents of the highest bounds, which are scored
exactly from their texts; the last of the best of them is a score that the answer reaches at least. A second pass lists all documents
whose bound reaches it, and those too are scored exactly: what is left out is provably behind. Exact scoring compares whole terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earthframe.lineage import saved
from earthframe.llm import bytesets as bs
from earthframe.llm.rows import keyed, row_key

#: Documents of a block and queries of a block at most.
BLOCK, QUERIES = 4096, 128
#: Bits of a signature for each pair that it holds, rounded up to a power of two, and bits that a pair sets.
BITS_A_PAIR, PROBES = 16, 6
#: Largest frequency of each class; the last one is open.
CLASSES = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256])
TOP = 50
#: Weights of terms of queries that are broadcast at once, on average.
WEIGHTS = 1 << 17
#: Documents of the highest bounds that a query's first pass scores, in multiples of those asked for.
FIRST = 3
#: Fixed values of the ranking formula.
BASE_PART, LENGTH_PART, ONE, HALF = 50, 50, 1_000_000_000, 20

_TERM = np.zeros(256, dtype=bool)
_TERM[128:] = True
for _low, _high in ("09", "AZ", "az"):
    _TERM[ord(_low):ord(_high) + 1] = True
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT, _FOLD = re.compile(_SEPARATORS), str.maketrans(_UPPER, _LOWER)


def terms_of(text: Column) -> Column:
    """The terms of a text in order, with repeats; a null text has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _SEPARATORS), lambda t: t != "")


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of a slice and the terms per text."""
    kept = _TERM[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    first, last = kept.copy(), kept.copy()
    if len(data):
        first[1:] &= ~kept[:-1] | edge[1:-1]
        last[:-1] &= ~kept[1:] | edge[1:-1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return bs.span_hash(bs.prefix_hash(data, lower=True), start, stop), np.diff(np.searchsorted(start, offsets))


def _probes(pairs: np.ndarray, bits: int) -> list[np.ndarray]:
    """Signature bits of hashed pairs: steps from the lower half of the hash, as wide as its upper half."""
    first, step = pairs & np.uint64(2**32 - 1), (pairs >> np.uint64(32)) | np.uint64(1)
    return [((first + step * np.uint64(p)) % np.uint64(bits)).astype(np.int64) for p in range(PROBES)]


def _pair(hashes: np.ndarray, cls: np.ndarray | int) -> np.ndarray:
    return bs.mix(hashes + np.asarray(cls, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


def part_of(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The frequency part of a score."""
    return (ONE * tf) // (1000 * tf + HALF * m)


def _counted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, frequency) of the distinct terms of each text, and the terms of each text with repeats."""
    hashes, count = term_hashes(data, offsets)
    text = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(fresh)
    return text[at], hashes[at], np.diff(np.append(at, len(hashes))), count


_SIGNED = "kind int, bits int, docs binary, tags binary, lengths binary, classes binary, largest binary, slices binary, hashes array<bigint>, dfs array<bigint>"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of signatures (kind 0), one width each, and the document frequencies of a task's terms (kind 1)."""
    open_: dict[int, list[tuple]] = {}
    seen: list[np.ndarray] = []
    totals: list[np.ndarray] = []

    def row(kind: int, bits: int | None = None, packed: tuple = (None,) * 6, hashes=None, dfs=None) -> pa.RecordBatch:
        values = [pa.array([kind], pa.int32()), pa.array([bits], pa.int32()), *(pa.array([x], pa.binary()) for x in packed),
                  *(pa.array([x], pa.list_(pa.int64())) for x in (hashes, dfs))]
        return pa.RecordBatch.from_arrays(values, [c.split()[0] for c in _SIGNED.split(", ")])

    def block(bits: int) -> pa.RecordBatch:
        docs = open_.pop(bits)
        wide = -(-len(docs) // 8)
        flags = np.zeros((bits, wide * 8), dtype=bool)
        for i, (*_, pairs) in enumerate(docs):
            for place in _probes(pairs, bits):
                flags[place, i] = True
        held = [np.array([d[i] for d in docs], np.int64).tobytes() for i in range(3)]
        return row(0, bits, (*held, np.array([d[3] for d in docs], np.int32).tobytes(), np.array([d[4] for d in docs], np.int64).tobytes(),
                             np.packbits(flags, axis=1).tobytes()))

    def fold() -> None:
        """Merge the counts seen so far; each list then holds one array."""
        hashes, counts = np.concatenate(seen), np.concatenate(totals)
        distinct, at = np.unique(hashes, return_inverse=True)
        seen[:], totals[:] = [distinct], [np.bincount(at, counts, len(distinct)).astype(np.int64)]

    def frequencies() -> Iterator[pa.RecordBatch]:
        if seen:
            fold()
            for i in range(0, len(seen[0]), 1 << 16):
                yield row(1, hashes=seen[0][i:i + (1 << 16)].view(np.int64), dfs=totals[0][i:i + (1 << 16)])
            seen.clear(), totals.clear()

    for batch in batches:
        for part, data, offsets in bs.slices(batch):
            text, hashes, tf, count = _counted(data, offsets)
            if len(hashes):
                distinct, df = np.unique(hashes, return_counts=True)
                seen.append(distinct)
                totals.append(df)
            if sum(map(len, seen)) > 1 << 21:
                fold()
                if len(seen[0]) > 1 << 20:
                    yield from frequencies()
            cls = np.searchsorted(CLASSES, tf)
            pairs = _pair(hashes, cls)
            bounds = np.searchsorted(text, np.arange(len(count) + 1))
            docs, tags = part.column("_doc").to_numpy(), part.column("_tag").to_numpy()
            for i in np.flatnonzero(count).tolist():
                a, b = bounds[i], bounds[i + 1]
                bits = max(64, 1 << int(BITS_A_PAIR * (b - a) - 1).bit_length())
                held = int(np.bitwise_or.reduce(np.int64(1) << cls[a:b].astype(np.int64)))
                mine = open_.setdefault(bits, [])
                mine.append((docs[i], tags[i], count[i], held, tf[a:b].max(), pairs[a:b]))
                if len(mine) == BLOCK or len(mine) * bits > 1 << 24:
                    yield block(bits)
    for bits in sorted(open_):
        yield block(bits)
    yield from frequencies()


def _bounds(block: dict, queries: dict, mean: tuple[int, int]) -> Iterator[tuple[int, np.ndarray]]:
    """Upper bounds of the scores of a block's documents, for each query of a block of queries."""
    docs, n = len(block["docs"]), block["lengths"]
    m = 100 - BASE_PART + (LENGTH_PART * n * mean[0]) // mean[1]
    slices = np.frombuffer(block["slices"], np.uint8).reshape(block["bits"], -1)
    terms, at = np.unique(queries["hashes"], return_inverse=True)
    bound = np.zeros((len(queries["stops"]), docs))
    starts = np.concatenate([[0], queries["stops"][:-1]])
    for cls in range(len(CLASSES) + 1):
        holds = (block["classes"] >> cls & 1).astype(bool)
        if not holds.any():
            continue
        places = _probes(_pair(terms, cls), block["bits"])
        found = slices[places[0]]
        for place in places[1:]:
            found = found & slices[place]
        some = found.any(axis=1)
        most = part_of(np.minimum(CLASSES[cls], block["largest"]) if cls < len(CLASSES) else block["largest"], m) * holds
        dense = np.unpackbits(found[some], axis=1, count=docs)
        row = np.where(some, np.cumsum(some) - 1, -1)[at]
        for q, (a, b) in enumerate(zip(starts.tolist(), queries["stops"].tolist(), strict=True)):
            mine = row[a:b]
            if (mine >= 0).any():
                bound[q] += (queries["weights"][a:b][mine >= 0].astype(np.float64) @ dense[mine[mine >= 0]]) * most
    yield from enumerate(bound)


def _meet(signatures: DataFrame, queries: DataFrame, mean: tuple[int, int], k: int) -> DataFrame:
    """(query, _doc, _tag, bound): per block the documents whose bound reaches the query's floor, or the ``k`` best where it has none."""
    numbers = queries.select("q").agg(F.collect_list("q").alias("qs"))  # one number for each block of queries
    work = (signatures.where("kind = 0").drop("kind", "hashes", "dfs").join(F.broadcast(numbers)).withColumn("q", F.explode("qs")).drop("qs")
            .join(queries, "q"))
    kinds = {"docs": np.int64, "tags": np.int64, "lengths": np.int64, "largest": np.int64, "classes": np.int32, "keys": np.int64, "hashes": np.uint64,
             "weights": np.int64, "stops": np.int64, "floors": np.int64}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                got = {n: np.frombuffer(batch.column(n)[i].as_buffer(), t) for n, t in kinds.items()}
                got["slices"], got["bits"] = batch.column("slices")[i].as_buffer(), batch.column("bits")[i].as_py()
                for q, bound in _bounds(got, got, mean):
                    floor = int(got["floors"][q])
                    if floor:
                        chosen = np.flatnonzero(bound >= floor)
                    else:
                        chosen = np.flatnonzero(bound > 0)
                        if len(chosen) > k:
                            chosen = chosen[np.argpartition(-bound[chosen], k - 1)[:k]]
                    if len(chosen):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(chosen), got["keys"][q])), pa.array(got["docs"][chosen]), pa.array(got["tags"][chosen]),
                             pa.array(bound[chosen])], ["query", "_doc", "_tag", "bound"])

    return work.mapInArrow(run, "query bigint, _doc bigint, _tag bigint, bound double")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct terms of each text with their frequencies, beside the queries that asked for it."""
    for batch in batches:
        for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            found = [Counter(_SPLIT.split(t.as_py().translate(_FOLD))) for t in part.column("text")]
            for terms in found:
                terms.pop("", None)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(n) for n in _ASKED), pa.array([sum(t.values()) for t in found], pa.int64()),
                 pa.array([[{"term": k, "tf": n} for k, n in t.items()] for t in found], pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())])))],
                [*_ASKED, "n", "terms"])


_ASKED = ("_doc", "_tag", "copies", "queries")


def _exact(texts: DataFrame, pairs: DataFrame, weights: DataFrame, mean: tuple[int, int], many: bool = False) -> DataFrame:
    """(query, _doc, _tag, copies, score): exact scores above 0 of pairs (query, _doc, _tag), from whole texts and terms.

    A text meets its queries as one row: it is shuffled once where there are ``many`` pairs, and not at all where they are few. What
    is counted in it is spread where it stands, and added up again before any shuffle. Queries are taken in parts of about WEIGHTS
    terms, whose weights are broadcast.
    """
    parts = max(1, -(-weights.count() // WEIGHTS))
    if parts > 1:
        def part(df: DataFrame, p: int) -> DataFrame:
            return df.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == p)

        return reduce(DataFrame.union, [_exact_part(texts, part(pairs, p), part(weights, p), mean, many) for p in range(parts)])
    return _exact_part(texts, pairs, weights, mean, many)


def _exact_part(texts: DataFrame, pairs: DataFrame, weights: DataFrame, mean: tuple[int, int], many: bool) -> DataFrame:
    own = pairs.groupBy("_doc", "_tag").agg(F.collect_set("query").alias("queries"))
    copies = texts.groupBy("_doc", "_tag").agg(F.count("*").alias("copies"))  # without the texts
    own = own.join(copies, ["_doc", "_tag"])
    rows = texts.join(own.hint("merge") if many else own, ["_doc", "_tag"]).select(*_ASKED, "text")
    counted = rows.mapInArrow(_counts, "_doc bigint, _tag bigint, copies bigint, queries array<bigint>, n bigint, "
                                       "terms array<struct<term: string, tf: bigint>>")
    m = F.lit(100 - BASE_PART) + F.expr(f"({LENGTH_PART}L * n * {mean[0]}L) div {mean[1]}L")
    met = (counted.withColumn("m", m).select("_doc", "_tag", "copies", "m", "terms", F.explode("queries").alias("query"))
           .select("query", "_doc", "_tag", "copies", "m", F.inline("terms")).join(F.broadcast(weights), ["query", "term"]))
    part = F.expr(f"weight * (({ONE}L * tf) div (1000L * tf + {HALF}L * m))")
    # repeated rows have one key and one text, so each of them has its share of the sum
    return (met.groupBy("query", "_doc", "_tag", "copies").agg(F.sum(part).alias("total"))
            .select("query", "_doc", "_tag", "copies", F.expr("total div copies").alias("score")).where("score > 0"))


def _packed(weights: DataFrame, floors: DataFrame) -> DataFrame:
    """Queries in blocks: keys, term hashes, weights, ends and floors as bytes; a query keeps its own block."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("query", "ascending"), ("hash", "ascending")])
        keys = table.column("query").to_numpy()
        stops = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)).astype(np.int64)
        last = stops - 1
        held = {"keys": keys[last], "hashes": table.column("hash").to_numpy(), "weights": table.column("weight").to_numpy(), "stops": stops,
                "floors": table.column("floor").to_numpy()[last]}
        return pa.table({"q": table.column("q")[:1], **{n: pa.array([np.ascontiguousarray(v).tobytes()]) for n, v in held.items()}})

    count = max(1, weights.select("query").distinct().count())
    rows = (weights.where("weight > 0").join(floors, "query", "left").na.fill(0, ["floor"])
            .withColumn("q", F.pmod(F.xxhash64("query"), F.lit(-(-count // QUERIES)))).select("q", "query", "hash", "weight", "floor"))
    return rows.groupBy("q").applyInArrow(pack, "q bigint, keys binary, hashes binary, weights binary, stops binary, floors binary")


def _hash_terms(terms: DataFrame) -> DataFrame:
    """``terms`` (term) with the hash that signatures use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = bs.texts(batch.column("term"))
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2], np.uint8)
            hashes = bs.span_hash(bs.prefix_hash(data, lower=True), offsets[:-1], offsets[1:])
            yield pa.RecordBatch.from_arrays([batch.column("term"), pa.array(hashes.view(np.int64))], ["term", "hash"])

    return terms.mapInArrow(run, "term string, hash bigint")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score.

    Documents and items with null or empty texts have no terms and no rows; so have items whose terms stand nowhere. Items that repeat an id with
    another text are ranked apart under that id, fully repeated items once. Every row of ``docs`` is a document, repeated rows
    and null ids too (null ids come last among equal scores). Document frequencies are counted by 64-bit hashes of terms.
    """
    texts = keyed(docs).select("_doc", "_tag", "text")
    signatures = saved(texts.mapInArrow(_signed, _SIGNED))
    frequencies = signatures.where("kind = 1").select(F.explode(F.arrays_zip("hashes", "dfs")).alias("x")).select(
        F.col("x.hashes").alias("hash"), F.col("x.dfs").alias("df"))
    n, length = _totals(signatures)
    asked = (items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
             .select("item_id", F.xxhash64("item_id", "text").alias("query"), F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")))
    asked = saved(asked)
    hashed = saved(_hash_terms(asked.select("term").distinct()))
    df = frequencies.join(hashed.select("hash").distinct(), "hash", "left_semi").groupBy("hash").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.ln((2 * F.lit(n).cast("double") + 2) / (2 * F.col("df") + 1))).cast("bigint")
    weights = saved(asked.join(hashed, "term").join(df, "hash").select("query", "item_id", "term", "hash", weight.alias("weight")))
    spread = weights.select("query", "term", "weight")
    mean = (n, length)
    none = weights.select("query", F.lit(0).cast("bigint").alias("floor")).limit(0)
    near = Window.partitionBy("query").orderBy(F.desc("bound"), "_doc", "_tag")
    first = _meet(signatures, _packed(weights, none), mean, FIRST * k)
    first = saved(first.withColumn("place", F.row_number().over(near)).where(F.col("place") <= FIRST * k))
    known = saved(_exact(texts, first, spread, mean))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "_doc", "_tag").rowsBetween(Window.unboundedPreceding, 0)
    floors = (known.withColumn("reached", F.sum("copies").over(best)).where(F.col("reached") >= k).groupBy("query").agg(F.max("score").alias("floor")))
    rest = saved(_meet(signatures, _packed(weights, floors), mean, 2**31 - 1).select("query", "_doc", "_tag"))
    found = _exact(texts, rest, spread, mean, many=True)
    final = Window.partitionBy("query").orderBy(F.desc("score"), "_doc", "_tag", "copy")
    ranked = (found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("copies", F.lit(k).cast("bigint")))))
              .withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k))
    ids = weights.select("query", "item_id").distinct()
    return ranked.join(ids, "query").select("item_id", "rank", F.when(F.col("_doc") != 2**63 - 1, F.col("_doc")).alias("doc_id"), "score")


def _totals(signatures: DataFrame) -> tuple[int, int]:
    """Documents with a term, and their terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = [np.frombuffer(x, np.int64) for x in batch.column("lengths").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, lengths))], pa.int64()), pa.array([int(sum(x.sum() for x in lengths))], pa.int64())],
                                             ["n", "total"])

    (row,) = (signatures.where("kind = 0").select("lengths").mapInArrow(run, "n bigint, total bigint")
              .agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).collect())
    return row[0], max(1, row[1])


OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY ALL),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM counts, totals GROUP BY term, docs),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id), totals GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
