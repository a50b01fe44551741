"""Removing repeated passages: suffixes of all texts sorted by induction from a sample, outside memory.

A text is its UTF-8 bytes. Of every 100-byte string that occurs again, all but the first place go (first in
the order of doc_id and place). Suffix order is found as in external induced sorting: a sample of suffixes is
sorted first, and the order and the common prefixes of the suffixes before them follow from it.

Sample. The sampled place of a 100-byte string is the start of the 32-byte string in it with the smallest
hash (the leftmost of equals), so equal strings sample the same place in themselves. A sampled place
*a* answers for a run of string starts ``a - far .. a - near`` and carries a tuple: the hash of its 32 bytes,
that of the stretch of bytes its strings cover, its document and place.

Merge. The tuples go through Spark's shuffle and external sort (its disk-backed queue): each task reads them in
order and holds one tuple at a time, whatever the size of its shard. Equal stretches are answered here: all
but the first are repeated. What is left are first stretches whose sampled 32 bytes also stand in another
stretch; they alone can hold strings that are equal only in part.

Induction. The bytes of those stretches are fetched, sorted as suffixes from the sampled place with the common
prefixes of neighbours, and for each step to the left the order is induced by a stable pass over the preceding byte;
a common prefix is the steps taken plus the smallest common prefix between the two in the sorted sample. Neighbours with
100 bytes in common are one string. Sampled strings with very many different stretches are settled
string by string with a grouped minimum instead, which no group makes slower.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earthframe.lineage import saved
from earthframe.llm import bytesets as bs
from earthframe.llm.rows import arrow_map, keyed

LENGTH, SAMPLE = 100, 32
#: Stretches that a task sorts at once, and those of one sampled string from which they are settled by grouping.
IN_MEMORY, LARGE = 50_000, 50_000
#: Tuples folded in a task before they are shuffled.
FOLD = 1 << 20

_TUPLE = pa.schema([("sample", pa.int64()), ("stretch", pa.int64()), ("_doc", pa.int64()), ("_tag", pa.int64()),
                    ("place", pa.int64()), ("far", pa.int16()), ("near", pa.int16()), ("first", pa.bool_())])
_TUPLE_SQL = ("sample bigint, stretch bigint, _doc bigint, _tag bigint, place bigint, far smallint, near smallint, "
              "first boolean")


def sampled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each sampled place: text number, place in the slice, far, near, hash of the sample and of the stretch."""
    prefix = bs.prefix_hash(data)
    at = np.arange(max(0, len(data) - SAMPLE + 1))
    hashes = bs.span_hash(prefix, at, at + SAMPLE)
    chosen = bs.sliding_argmin(hashes, LENGTH - SAMPLE + 1)
    whole = np.diff(offsets) >= LENGTH
    change = np.zeros(len(data) + 1, np.int8)
    change[offsets[:-1][whole]] += 1
    change[offsets[1:][whole] - LENGTH + 1] -= 1
    start = np.flatnonzero(np.cumsum(change[:len(chosen)], dtype=np.int8))
    place = chosen[start]
    new = np.flatnonzero(np.concatenate([np.ones(1, bool), place[1:] != place[:-1]])) if len(place) else start
    first, last = start[new], start[np.concatenate([new[1:], [len(start)]]) - 1] if len(new) else start
    place = place[new]
    far, near = place - first, place - last
    stretch = bs.span_hash(prefix, first, last + LENGTH) ^ bs.mix((far * 128 + near).astype(np.uint64))
    text = np.searchsorted(offsets, place, side="right") - 1
    return text, place, far, near, hashes[place], stretch


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sampled tuples of a partition; within FOLD tuples only the first of equal stretches is left as first."""
    held: list[list[np.ndarray]] = []

    def fold() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        doc, tag, place, far, near, sample, stretch = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((place, tag, doc, stretch, sample))
        same = np.concatenate([np.zeros(1, bool), (sample[order][1:] == sample[order][:-1])
                               & (stretch[order][1:] == stretch[order][:-1])])
        first = np.ones(len(doc), bool)
        first[order[same]] = False
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (
            sample.view(np.int64), stretch.view(np.int64), doc, tag, place, far, near, first)], schema=_TUPLE)
        held.clear()

    for batch in batches:
        for rows, data, offsets in bs.slices(batch):
            text, place, far, near, sample, stretch = sampled(data, offsets)
            held.append([rows.column("_doc").to_numpy()[text], rows.column("_tag").to_numpy()[text],
                         place - offsets[text], far.astype(np.int16), near.astype(np.int16), sample, stretch])
            if sum(len(c[0]) for c in held) >= FOLD:
                yield from fold()
    yield from fold()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read tuples sorted by sample, stretch and order of places; mark each as repeated or as first.

    Tuples come out as they came in but for ``first``; a first one whose sample has only its own stretch
    is dropped, as its strings occur nowhere else.
    """
    carry: pa.RecordBatch | None = None
    before = (None, None)  # sample and stretch of the last tuple that went out

    def judge(batch: pa.RecordBatch, follows: tuple) -> pa.RecordBatch:
        sample, stretch = (batch.column(c).to_numpy() for c in ("sample", "stretch"))
        prior = np.concatenate([[0 if follows[0] is None else follows[0]], sample[:-1]])
        same_sample = prior == sample
        same = same_sample & (np.concatenate([[0 if follows[1] is None else follows[1]], stretch[:-1]]) == stretch)
        if follows[0] is None:
            same_sample[0] = same[0] = False
        run = np.cumsum(~same_sample)
        several = np.bincount(run, weights=~same, minlength=run[-1] + 1) > 1
        several[0] |= bool((~same[run == 0]).any()) if not run[0] else False
        first = ~same
        keep = ~first | several[run]
        out = batch.set_column(7, "first", pa.array(first))
        return out.filter(pa.array(keep))

    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch if carry is None else pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
        sample = batch.column("sample").to_numpy()
        stretch = batch.column("stretch").to_numpy()
        # The last sample may go on: hold its tuples back, or, once its second stretch was seen, let them pass.
        start = int(np.flatnonzero(np.concatenate([[True], sample[1:] != sample[:-1]]))[-1])
        if len(np.unique(stretch[start:])) > 1 or (start == 0 and before[0] == sample[0]):
            start = batch.num_rows
        elif batch.num_rows - start > 1:
            # One stretch so far: all but its first tuple are repeated in any case.
            tail = batch.slice(start + 1)
            yield tail.set_column(7, "first", pa.array(np.zeros(tail.num_rows, bool)))
        if start:
            yield judge(batch.slice(0, start), before)
            before = (sample[start - 1], stretch[start - 1])
        carry = batch.slice(start, 1) if start < batch.num_rows else None
    if carry is not None:
        out = judge(carry, before)
        if out.num_rows:
            yield out


def _stretches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut the bytes of each open stretch out of its text."""
    names = ("sample", "place", "far", "near")
    for i in range(batch.num_rows):
        text = batch.column("text")[i].as_buffer().to_pybytes()
        cuts = batch.column("cuts")[i].as_py()
        yield pa.RecordBatch.from_arrays(
            [pa.array([c[n] for c in cuts], pa.int64()) for n in names]
            + [pa.array([batch.column(c)[i].as_py()] * len(cuts), pa.int64()) for c in ("_doc", "_tag")]
            + [pa.array([text[c["place"] - c["far"]:c["place"] - c["near"] + LENGTH] for c in cuts], pa.binary())],
            [*names, "_doc", "_tag", "bytes"])


def common_prefixes(sorted_rows: np.ndarray) -> np.ndarray:
    """Bytes that each row has in common with the row before it (0 for the first)."""
    differ = sorted_rows[1:] != sorted_rows[:-1]
    length = np.where(differ.any(axis=1), differ.argmax(axis=1), sorted_rows.shape[1])
    return np.concatenate([np.zeros(1, np.int64), length])


def _range_minima(values: np.ndarray) -> list[np.ndarray]:
    table = [values.astype(np.uint8)]
    while 2 ** len(table) <= len(values):
        last, half = table[-1], 2 ** (len(table) - 1)
        table.append(np.minimum(last[:-half], last[half:]))
    return table


def _smallest(table: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Smallest value in each ``lo + 1 .. hi`` (lo < hi)."""
    level = np.frexp(hi - lo)[1] - 1
    out = np.zeros(len(lo), np.int64)
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(table[k][lo[at] + 1], table[k][hi[at] - 2 ** int(k) + 1])
    return out


def induce(left: np.ndarray, right: np.ndarray, far: np.ndarray, near: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, steps) of each repeated string.

    ``right`` holds the 100 bytes from each sampled place on, ``left`` those before it from right to left (both as
    numbers above 0, with 0 past the end). ``rank`` orders the rows by document and place. A string that starts ``steps``
    before its place is repeated if an equal one has a smaller rank.
    """
    words = np.zeros((len(right), -(-LENGTH // 6) * 6), np.uint64)
    words[:, :LENGTH] = right
    packed = np.zeros((len(right), words.shape[1] // 6), np.uint64)
    for k in range(6):
        packed = (packed << np.uint64(9)) | words[:, k::6]
    order = np.lexsort(packed.T[::-1])
    minima = _range_minima(common_prefixes(right[order]))
    position = np.empty(len(order), np.int64)
    position[order] = np.arange(len(order))
    name = np.zeros(len(order), np.int64)  # equal for rows whose last ``steps`` bytes on the left are equal
    rows, steps = [], []
    for step in range(int(far.max(initial=-1)) + 1):
        if step:
            order = order[np.argsort(left[order, step - 1], kind="stable")]
            new = np.concatenate([np.ones(1, bool), (left[order[1:], step - 1] != left[order[:-1], step - 1])
                                  | (name[order[1:]] != name[order[:-1]])])
            name[order] = np.cumsum(new)
        live = order[(far[order] >= step) & (near[order] <= step)]
        if len(live) < 2:
            continue
        common = np.zeros(len(live), np.int64)
        pair = np.flatnonzero(name[live[1:]] == name[live[:-1]]) + 1
        common[pair] = step + _smallest(minima, position[live[pair - 1]], position[live[pair]])
        start = np.flatnonzero(common < LENGTH)
        least = np.repeat(np.minimum.reduceat(rank[live], start), np.diff(np.concatenate([start, [len(live)]])))
        again = live[rank[live] != least]
        rows.append(again)
        steps.append(np.full(len(again), step))
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(steps)) if rows else (none, none)


def _spans(doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Runs of neighbouring repeated string starts as spans of bytes."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start = doc[order], tag[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > start[:-1] + LENGTH)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1 if len(first) else first
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (
        doc[first], tag[first], start[first], start[last] + LENGTH)], ["_doc", "_tag", "start", "stop"])


def _induced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the repeated strings of open stretches; equal samples stand together in the partition."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        far, near, place, doc, tag = (table.column(c).to_numpy() for c in ("far", "near", "place", "_doc", "_tag"))
        left = np.zeros((len(far), LENGTH), np.uint16)
        right = np.zeros((len(far), LENGTH), np.uint16)
        for i, text in enumerate(table.column("bytes").to_pylist()):
            text = np.frombuffer(text, np.uint8).astype(np.uint16) + 1
            after = text[far[i]:far[i] + LENGTH]
            right[i, :len(after)] = after
            left[i, :far[i]] = text[:far[i]][::-1]
        rank = np.empty(len(far), np.int64)
        rank[np.lexsort((place, tag, doc))] = np.arange(len(far))
        row, steps = induce(left, right, far, near, rank)
        return _spans(doc[row], tag[row], place[row] - steps)

    held, rows = [], 0
    for batch in batches:
        sample = batch.column("sample").to_numpy()
        start = np.flatnonzero(np.concatenate([[True], sample[1:] != sample[:-1]])) if len(sample) else []
        cut = 0
        for at in start:
            # A group starts here: what is held may be solved.
            if rows + at - cut >= IN_MEMORY and (at > 0 or (held and held[-1].column("sample")[-1].as_py() != sample[0])):
                yield solve(pa.Table.from_batches([*held, batch.slice(cut, at - cut)]))
                held, rows, cut = [], 0, at
        held.append(batch.slice(cut))
        rows += batch.num_rows - cut
    if rows:
        yield solve(pa.Table.from_batches(held))


def _strings(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Hash and place of every string of a stretch."""
    for i in range(batch.num_rows):
        data = np.frombuffer(batch.column("bytes")[i].as_buffer(), np.uint8)
        at = np.arange(len(data) - LENGTH + 1)
        prefix = bs.prefix_hash(data)
        start = batch.column("place")[i].as_py() - batch.column("far")[i].as_py() + at
        yield pa.RecordBatch.from_arrays(
            [pa.array(bs.span_hash(prefix, at, at + LENGTH).view(np.int64)),
             pa.array(np.full(len(at), batch.column("_doc")[i].as_py())),
             pa.array(np.full(len(at), batch.column("_tag")[i].as_py())), pa.array(start)],
            ["string", "_doc", "_tag", "start"])


def union_spans(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the spans cover; spans that touch are one run."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def _removed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i in range(batch.num_rows):
        text = batch.column("text")[i].as_buffer().to_pybytes()
        runs = union_spans(batch.column("spans")[i].as_py())
        kept, at = hashlib.sha256(), 0
        for start, stop in runs:
            kept.update(text[at:start])
            at = stop
        kept.update(text[at:])
        yield pa.RecordBatch.from_arrays(
            [batch.column("_doc").slice(i, 1), batch.column("_tag").slice(i, 1),
             pa.array([sum(b - a for a, b in runs)], pa.int64()), pa.array([[{"start": a, "stop": b} for a, b in runs]],
             pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array([kept.hexdigest()])],
            ["_doc", "_tag", "n_removed", "runs", "kept_sha256"])


_RUNS = "array<struct<start: bigint, stop: bigint>>"


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(_doc, _tag, start, stop): bytes of strings that also start earlier, for keyed rows."""
    tuples = rows.select("_doc", "_tag", "text").mapInArrow(_tuples, _TUPLE_SQL)
    known = tuples.where("NOT first")
    merged = (tuples.where("first").repartition("sample").sortWithinPartitions("sample", "stretch", "_doc", "_tag", "place")
              .mapInArrow(_merged, _TUPLE_SQL))
    judged = saved(merged.union(known))
    spans = judged.where("NOT first").select("_doc", "_tag", (F.col("place") - F.col("far")).alias("start"),
                                             (F.col("place") - F.col("near") + LENGTH).alias("stop"))
    open_ = judged.where("first")
    cuts = open_.groupBy("_doc", "_tag").agg(F.collect_list(F.struct("sample", "place", "far", "near")).alias("cuts"))
    distinct = rows.select("_doc", "_tag", F.encode("text", "UTF-8").alias("text"))
    open_ = saved(arrow_map(
        cuts.join(distinct, ["_doc", "_tag"]).select("_doc", "_tag", "text", "cuts"), _stretches,
        "sample bigint, place bigint, far bigint, near bigint, _doc bigint, _tag bigint, bytes binary"))
    large = saved(open_.groupBy("sample").count().where(F.col("count") > LARGE).select("sample"))
    small = open_.join(large, "sample", "left_anti").repartition("sample").sortWithinPartitions("sample")
    span = "_doc bigint, _tag bigint, start bigint, stop bigint"
    induced = small.mapInArrow(_induced, span)
    strings = arrow_map(open_.join(large, "sample", "left_semi"), _strings,
                        "string bigint, _doc bigint, _tag bigint, start bigint")
    first = saved(strings.groupBy("string").agg(F.min(F.struct("_doc", "_tag", "start")).alias("first"), F.count("*").alias("n"))
                  .where("n > 1").select("string", "first"))
    later = (strings.join(first, "string").where(F.struct("_doc", "_tag", "start") != F.col("first"))
             .select("_doc", "_tag", "start", (F.col("start") + LENGTH).alias("stop")))
    return spans.union(induced).union(later)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, runs (the removed spans).

    Null and empty texts, and texts under 100 bytes, keep all. A null doc_id counts as larger than any id. Rows that share
    a doc_id are ordered by a hash of their text; of fully repeated rows one keeps its text as judged, the
    others are copies of it and lose all from 100 bytes on. An empty table gives an empty result.
    """
    rows = keyed(docs)
    base = saved(rows.select("_doc", "_tag", "doc_id", F.length(F.encode("text", "UTF-8")).cast("bigint").alias("n_bytes"),
                             F.sha2(F.encode("text", "UTF-8"), 256).alias("whole")))
    if base.groupBy("_doc", "_tag").count().where("count > 1").limit(1).count():
        # Equal keys share their spans, so a copy judged beside its row would take the row's text along.
        rows = saved(rows.dropDuplicates(["_doc", "_tag"]))
    spans = repeated_spans(rows)
    per_doc = spans.groupBy("_doc", "_tag").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    removed = arrow_map(
        per_doc.join(rows.select("_doc", "_tag", F.encode("text", "UTF-8").alias("text")), ["_doc", "_tag"])
        .select("_doc", "_tag", "text", "spans"), _removed,
        f"_doc bigint, _tag bigint, n_removed bigint, runs {_RUNS}, kept_sha256 string")
    removed = saved(removed).dropDuplicates(["_doc", "_tag"])
    copies = F.row_number().over(Window.partitionBy("_doc", "_tag").orderBy("whole"))
    out = base.withColumn("copy", copies).join(removed, ["_doc", "_tag"], "left")
    gone = (F.col("copy") > 1) & (F.col("n_bytes") >= LENGTH)
    everything = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("stop")))
    runs = F.when(gone, everything).otherwise(F.coalesce("runs", F.array().cast(_RUNS)))
    return out.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("bigint"))).alias("n_removed"),
        F.size(runs).cast("bigint").alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        runs.alias("runs"))

