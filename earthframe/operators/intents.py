"""Intent classification: features, splits, training and evaluation as DataFrame jobs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from earthframe.functions.ngrams import char_wb_ngrams, word_ngrams
from earthframe.functions.rules import let
from earthframe.lineage import cut, saved
from earthframe.operators.grams import PIECE, TEXTS, document_frequency, gram_blocks, looked_up, read_words, with_frequencies
from earthframe.operators.shared_fit import Kernel, fit_steps, softmax

# The closed label set, training grid and calibration rules.
INTENT_LABELS = ("NDVI", "NDWI", "NDBI", "SAR_BACKSCATTER", "TEMPORAL_NDWI", "TRUE_COLOR",
                 "CLARIFICATION", "UNSUPPORTED")
SPLIT = (0.70, 0.15, 0.15)
C_GRID = (1.0, 3.0, 10.0, 30.0, 100.0)
THRESHOLD_GRID = tuple(round(0.30 + 0.05 * i, 2) for i in range(14))
TARGET_PRECISION, THRESHOLD_FLOOR = 0.99, 0.90
MIN_DF = {"word": 1, "char": 2}

#: Training texts, and characters of them, up to which one task fits the models of a part; more are fitted by all tasks together.
FIT_TEXTS, FIT_SIZE = 4096, 1 << 23
#: Texts of a scoring task.
SCORE_TEXTS = 1024


def explode_grams(texts: DataFrame, text: str = "text") -> DataFrame:
    """(id, block, gram, tf): word 1-2-grams and char_wb 2-5-grams with their counts."""
    spread = texts.select("id", F.col(text).alias("text")).repartition("id")
    blocks = F.array(
        F.struct(F.lit("word").alias("block"), word_ngrams(F.col("text")).alias("grams")),
        F.struct(F.lit("char").alias("block"), char_wb_ngrams(F.col("text")).alias("grams")))
    rows = spread.select("id", F.explode(blocks).alias("b")).select(
        "id", "b.block", F.explode("b.grams").alias("gram"))
    return rows.groupBy("id", "block", "gram").agg(F.count(F.lit(1)).alias("tf"))


def fit_idf(grams: DataFrame, documents: int | Column) -> DataFrame:
    """(block, gram, df, idf) of grams that reach their block's minimum frequency.

    Smoothed ``ln((1+n)/(1+df)) + 1``. One row per (id, gram) comes in, so the document
    frequency is a plain count.
    """
    return _idf(grams.groupBy("block", "gram").agg(F.count(F.lit(1)).alias("df")), documents)


def _idf(counts: DataFrame, documents: int | Column) -> DataFrame:
    least = F.when(F.col("block") == "word", MIN_DF["word"]).otherwise(MIN_DF["char"])
    return counts.where(F.col("df") >= least).withColumn(
        "idf", F.log((F.lit(1.0) + documents) / (F.lit(1.0) + F.col("df"))) + 1.0)


def tfidf_weights(grams: DataFrame, idf: DataFrame) -> DataFrame:
    """(id, block, gram, weight): ``(1+ln tf) idf`` with unit norm per text and block."""
    raw = grams.join(idf, ["block", "gram"]).withColumn(
        "_w", (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf"))
    norm = raw.groupBy("id", "block").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return raw.join(norm, ["id", "block"]).select(
        "id", "block", "gram", (F.col("_w") / F.col("_norm")).alias("weight"))


def text_idf(texts: DataFrame, documents: int | Column) -> DataFrame:
    """(block, gram, df, idf) as :func:`fit_idf`, from texts (id, text) counted inside tasks."""
    return _idf(document_frequency(texts), documents)


def weight_summary(texts: DataFrame, documents: int) -> DataFrame:
    """(id, block, initial, grams, total, most, first_gram): weights as of :func:`tfidf_weights`, summed up by first character of the gram.

    Texts are weighed where they stand; their single grams are not shuffled.
    """

    def solve(rows: pa.Table, known: dict[str, pa.Table]) -> pa.Table:
        found = []
        for block, text, gram, tf, names in gram_blocks(rows):
            df = looked_up(names, known[block])
            kept = df[gram] >= MIN_DF[block]
            text, gram, tf = text[kept], gram[kept], tf[kept]
            if not len(text):
                continue
            weight = (1.0 + np.log(tf)) * (np.log((1.0 + documents) / (1.0 + df[gram])) + 1.0)
            weight /= np.sqrt(np.bincount(text, weight * weight))[text]
            initials = pc.utf8_slice_codeunits(names, 0, 1).dictionary_encode()
            initial = initials.indices.to_numpy()[gram]
            # grams of a text and initial side by side, the least name first; names compare as their bytes do
            place = np.empty(len(names), np.int64)
            place[np.argsort(np.array([n.encode() for n in names.to_pylist()], object), kind="stable")] = np.arange(len(names))
            order = np.lexsort((place[gram], initial, text))
            text, gram, initial, weight = text[order], gram[order], initial[order], weight[order]
            first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (initial[1:] != initial[:-1])]))
            found.append(pa.table({
                "id": rows.column("id").take(pa.array(text[first])), "block": pa.array([block] * len(first), pa.string()),
                "initial": initials.dictionary.take(pa.array(initial[first])), "grams": np.diff(np.append(first, len(text))),
                "total": np.add.reduceat(weight, first), "most": np.maximum.reduceat(weight, first), "first_gram": names.take(pa.array(gram[first]))}))
        return pa.concat_tables(found) if found else schema.empty_table()

    schema = pa.schema([("id", pa.int64()), ("block", pa.string()), ("initial", pa.string()), ("grams", pa.int64()), ("total", pa.float64()),
                        ("most", pa.float64()), ("first_gram", pa.string())])
    return with_frequencies(texts, solve, "id bigint, block string, initial string, grams bigint, total double, most double, first_gram string")


def part_vocabulary(grams: DataFrame, roles: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """((block, gram, idx, idfs), size): one vocabulary of all training texts with an idf for each training part.

    ``roles``: id, fold; a null fold is no training text. Part ``p`` trains on the texts of all folds but ``p``, and the last of the
    ``parts + 1`` on every training text. Leaving a fold out is a subtraction, so one count serves all parts. A gram
    that a part sees less often than its block asks for has a null there: it weighs nothing, as if it were not in the
    part's vocabulary. Places are dense and follow (block, gram); they come from the sizes of sorted ranges, not from one task.
    """
    trained = roles.where("fold IS NOT NULL").select("id", "fold")
    sizes = trained.agg(F.count("*"), *[F.count_if(F.col("fold") == p) for p in range(parts)]).first()
    counts = grams.join(trained, "id").groupBy("block", "gram").agg(
        F.count("*").alias("df"), *[F.count_if(F.col("fold") == p).alias(f"_{p}") for p in range(parts)])
    least = F.when(F.col("block") == "word", MIN_DF["word"]).otherwise(MIN_DF["char"])

    def idf(df: Column, documents: int) -> Column:
        return F.when(df >= least, F.log((F.lit(1.0) + documents) / (F.lit(1.0) + df)) + 1.0)

    idfs = [idf(F.col("df") - F.col(f"_{p}"), sizes[0] - sizes[p + 1]) for p in range(parts)]
    placed = saved(
        counts.where(F.col("df") >= least).select("block", "gram", F.array(*idfs, idf(F.col("df"), sizes[0])).alias("idfs"))
        .repartitionByRange("block", "gram").sortWithinPartitions("block", "gram").withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).withColumn(
        "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))  # one row a range
    idx = F.col("_start") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(starts, "_part").select("block", "gram", "idfs", idx.cast("int").alias("idx")), placed.count()


def part_features(grams: DataFrame, roles: DataFrame, parts: int = 0) -> DataFrame:
    """``roles`` with a feature vector ``f0`` .. for each training part of :func:`part_vocabulary`.

    A vector holds ``(1 + ln tf) idf`` of each gram, of unit length in each block. Vectors are put together from columns: their
    fields are written as the struct that a vector is stored as, and read back as vectors.
    """
    vocabulary, size = part_vocabulary(grams, roles, parts)
    damped = F.lit(1.0) + F.log(F.col("tf").cast("double"))
    entries = (grams.join(vocabulary, ["block", "gram"])
               .select("id", F.struct("idx", (F.col("block") == "word").alias("word"), F.transform("idfs", lambda x: x * damped).alias("w")).alias("e"))
               .groupBy("id").agg(F.array_sort(F.collect_list("e")).alias("entries")))

    def vector(p: int) -> Column:
        def unit(mine: Column) -> Column:
            def norm(word: bool) -> Column:
                return F.sqrt(F.aggregate(mine, F.lit(0.0), lambda a, e: a + F.when(e["word"] == word, e["w"] * e["w"]).otherwise(0.0)))

            return let(F.struct(norm(True).alias("word"), norm(False).alias("char")), lambda n: F.struct(
                F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.transform(mine, lambda e: e["idx"]).alias("indices"),
                F.transform(mine, lambda e: e["w"] / F.when(e["word"], n["word"]).otherwise(n["char"])).alias("values")))

        held = F.filter("entries", lambda e: F.get(e["w"], F.lit(p)).isNotNull())
        return let(F.transform(held, lambda e: F.struct(e["idx"], e["word"], F.get(e["w"], F.lit(p)).alias("w"))), unit)

    filled = roles.join(entries, "id", "left").withColumn("entries", F.coalesce("entries", F.expr(
        "CAST(array() AS array<struct<idx: int, word: boolean, w: array<double>>>)")))
    out = filled.select(*roles.columns, *[vector(p).alias(f"f{p}") for p in range(parts + 1)])
    schema = StructType([StructField(f.name, VectorUDT() if f.name in {f"f{p}" for p in range(parts + 1)} else f.dataType) for f in out.schema])
    return saved(out, schema=schema)


def intent_features(train: DataFrame, others: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train features, other features); the vocabulary comes from ``train`` only. Ids are unique over both."""
    roles = train.select("id", F.lit(0).alias("fold")).unionByName(others.select("id", F.lit(None).cast("int").alias("fold")))
    grams = cut(explode_grams(train.select("id", "text").unionByName(others.select("id", "text"))))
    both = part_features(grams, roles).withColumnRenamed("f0", "features")
    return both.where("fold IS NOT NULL").drop("fold"), both.where("fold IS NULL").drop("fold")


def fit_intent(features: DataFrame, labels: Sequence[str], c: float, max_iter: int = 10_000, column: str = "features",
               tol: float = 1e-5) -> LogisticRegressionModel:
    """Multinomial logistic regression with an L2 penalty of 1/(C n), fitted until it settles.

    ``features``: label and the vectors of ``column``, read once for each step of the fit.
    """
    index = F.create_map(*[x for i, k in enumerate(labels) for x in (F.lit(k), F.lit(float(i)))])
    data = features.select(F.col(column).alias("features"), F.element_at(index, F.col("label")).alias("target"))
    return LogisticRegression(
        featuresCol="features", labelCol="target", family="multinomial", elasticNetParam=0.0, standardization=False,
        regParam=1.0 / (c * data.count()), maxIter=max_iter, tol=tol).fit(data)


def class_probabilities(features: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    """Add ``probabilities`` (softmax over the labels in model order)."""
    return model.transform(features).withColumn(
        "probabilities", vector_to_array("probability")).drop(
        "rawPrediction", "probability", "prediction")


def predicted_label(probabilities: Column, labels: Sequence[str]) -> Column:
    """Label of the highest probability, the first one on ties."""
    best = F.array_position(probabilities, F.array_max(probabilities)).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in labels]), best)


def score_intent(features: DataFrame, model: LogisticRegressionModel, labels: Sequence[str],
                 threshold: float) -> DataFrame:
    """predicted, confidence and whether the prediction is acted on."""
    p = class_probabilities(features, model)
    return p.withColumn("predicted", predicted_label(F.col("probabilities"), labels)).withColumn(
        "confidence", F.array_max("probabilities")).withColumn(
        "acted_on", F.col("confidence") >= threshold)


# --------------------------------------------------------------------------- #
# Splits
# --------------------------------------------------------------------------- #


def order_families(df: DataFrame, seed: str) -> DataFrame:
    """(family, label, size, key): families with a stable key; largest first, then the key.

    The dominant label is the most frequent one, the smallest name on ties.
    """
    per = df.groupBy("family", "label").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return per.groupBy("family").agg(
        F.max_by("label", F.struct("n", F.lit(0) - F.ascii("label"))).alias("label"),
        F.sum("n").alias("size"), F.min("first").alias("first"),
    ).withColumn("key", F.sha2(F.concat_ws(":", F.lit(seed), F.col("first").cast("string")), 256))


def _running_share(families: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of members before each family within its group, in (size desc, key) order.

    Two levels: totals per (size, leading key digits) block are ranked first and families
    only within their block; the key is a hash, so 4096 blocks share even a label of
    single-text families evenly.
    """
    prefix = F.substring("key", 1, 3)
    order = families.withColumn("_block", prefix)
    sums = order.groupBy(*by, "size", "_block").agg(F.sum("size").alias("_sum"))
    upto = Window.partitionBy(*by).orderBy(F.desc("size"), "_block").rowsBetween(
        Window.unboundedPreceding, -1)
    start = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(upto), F.lit(0))).drop("_sum")
    totals = families.groupBy(*by).agg(F.sum("size").alias("_total"))
    inside = Window.partitionBy(*by, "size", "_block").orderBy("key").rowsBetween(
        Window.unboundedPreceding, -1)
    return (
        order.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(start, [*by, "size", "_block"]).join(totals, list(by))
        .withColumn("share", (F.col("_start") + F.col("_in")) / F.col("_total"))
        .drop("_in", "_start", "_total", "_block")
    )


def split_families(df: DataFrame, seed: str, shares: Sequence[float] = SPLIT) -> DataFrame:
    """(id, family, split): whole families to train / validation / test per dominant label."""
    placed = _running_share(order_families(df, seed), ["label"])
    split = F.when(F.col("share") < shares[0], "train").when(
        F.col("share") < shares[0] + shares[1], "validation").otherwise("test")
    return df.select("id", "family").join(
        placed.select("family", split.alias("split")), "family").select("id", "family", "split")


def fold_families(df: DataFrame, seed: str, k: int = 5) -> DataFrame:
    """(id, fold): whole families to k folds of near-equal size."""
    placed = _running_share(order_families(df, seed), ["label"])
    fold = F.least(F.floor(F.col("share") * k), F.lit(k - 1)).cast("int")
    return df.select("id", "family").join(placed.select("family", fold.alias("fold")),
                                          "family").select("id", "fold")


def part_entries(grams: DataFrame, roles: DataFrame, parts: int = 0) -> DataFrame:
    """(part, id, trains, word, idx, x): the grams of each text as every part that uses it weighs them, before scaling.

    Training texts are in all parts, and train in those that do not leave out their fold; others are in the last part only.
    """
    vocabulary, _ = part_vocabulary(grams, roles, parts)
    damped = F.lit(1.0) + F.log(F.col("tf").cast("double"))
    rows = grams.join(roles.select("id", "fold"), "id").join(vocabulary, ["block", "gram"])
    each = rows.select("id", "fold", (F.col("block") == "word").alias("word"), "idx", damped.alias("damped"), F.posexplode("idfs").alias("part", "idf"))
    trains = F.col("fold").isNotNull() & ((F.col("part") == parts) | (F.col("part") != F.col("fold")))
    used = each.where((F.col("part") == parts) | (F.col("fold").isNotNull())).where("idf IS NOT NULL")
    return saved(used.select("part", "id", F.coalesce(trains, F.lit(False)).alias("trains"), "word", "idx", (F.col("damped") * F.col("idf")).alias("x")))


def fit_kernel(kernel: np.ndarray, truth: np.ndarray, c: float, start: np.ndarray | None = None,
               rounds: int = 1000, settled: float = 1e-8) -> np.ndarray:
    """What :func:`fit_steps` ends with, for a kernel at hand."""
    steps = fit_steps(truth, c, start, rounds, settled)
    asked = next(steps)
    while True:
        try:
            asked = steps.send(kernel @ asked)
        except StopIteration as end:
            return end.value


def fit_parts(entries: DataFrame, marks: DataFrame, labels: Sequence[str], c_grid: Sequence[float] = C_GRID) -> DataFrame:
    """(part, idx, weights): coefficients of the models of every part, for each C of the grid and label in turn; idx -1 holds intercepts.

    ``marks``: id, label, and the fold of training texts. One task fits the models of one part on all its
    training texts, each C from where the smaller one ended; the parts are fitted side by side.
    """
    index = F.create_map(*[x for i, k in enumerate(labels) for x in (F.lit(k), F.lit(i))])
    target = F.element_at(index, F.col("label")).alias("target")
    texts = entries.where("trains").select("part", "id").distinct().join(marks.select("id", target), "id")
    if "fold" in marks.columns:  # texts without known grams train too: they count for the intercepts
        last = F.max("part").over(Window.partitionBy())
        parts = entries.select("part").distinct().withColumn("_last", F.col("part") == last)  # one row a part
        texts = marks.where("fold IS NOT NULL").select("id", "fold", target).join(F.broadcast(parts), F.col("_last") | (F.col("part") != F.col("fold"))).select(
            "part", "id", "target")
    rows = entries.where("trains").join(texts, ["part", "id"]).select("part", "id", "target", "word", "idx", "x").unionByName(
        texts.select("part", "id", "target", F.lit(True).alias("word"), F.lit(-1).alias("idx"), F.lit(0.0).alias("x")))  # every text once

    def solve(table: pa.Table) -> pa.Table:
        ids, row = np.unique(table.column("id").to_numpy(), return_inverse=True)
        word, x, target, idx = (table.column(n).to_numpy() for n in ("word", "x", "target", "idx"))
        truth = np.zeros((len(ids), len(labels)))
        truth[row, target] = 1.0
        held = idx >= 0
        row, word, x = row[held], word[held], x[held]
        places, column = np.unique(idx[held], return_inverse=True)
        block = row * 2 + word
        x = x / np.sqrt(np.bincount(block, x * x, 2 * len(ids)))[block]
        order = np.argsort(row, kind="stable")
        row, column, x = row[order], column[order], x[order]
        at = np.searchsorted(row, np.arange(len(ids) + 1))
        kernel, spread = np.zeros((len(ids), len(ids))), np.zeros(len(places))
        for i in range(len(ids)):
            mine = column[at[i]:at[i + 1]]
            spread[mine] = x[at[i]:at[i + 1]]
            kernel[i] = np.bincount(row, x * spread[column], len(ids))
            spread[mine] = 0.0
        weights, fitted = [], None
        for c in c_grid:
            fitted = fit_kernel(kernel, truth, c, fitted)
            coefficients = [np.bincount(column, x * fitted[row, j], len(places)) for j in range(len(labels))]
            weights += [np.append(w, b) for w, b in zip(coefficients, fitted[-1], strict=True)]
        flat = np.stack(weights, axis=1)
        offsets = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1])
        return pa.table({"part": pa.array(np.full(len(flat), table.column("part")[0].as_py(), np.int32)), "idx": pa.array(np.append(places, -1).astype(np.int32)),
                         "weights": pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))})

    return saved(rows.groupBy("part").applyInArrow(solve, "part int, idx int, weights array<double>"))


def score_parts(entries: DataFrame, texts: DataFrame, models: DataFrame, labels: Sequence[str], c_grid: Sequence[float] = C_GRID) -> DataFrame:
    """(part, id, c, probabilities, predicted, confidence) of ``texts`` (part, id) by the models of :func:`fit_parts`.

    A text without known grams is scored by the intercepts; a part without a model scores nothing. The texts of a part are dealt
    into groups of about SCORE_TEXTS, each of which meets the part's models.
    """
    size = len(labels) * len(c_grid)
    groups = texts.groupBy("part").agg(F.ceil(F.count("*") / SCORE_TEXTS).cast("int").alias("groups"))
    dealt = texts.select("part", "id").join(groups, "part").withColumn("group", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int")).drop("groups")
    known = entries.select("part", "id", "word", "idx", "x").join(dealt, ["part", "id"])
    marks = dealt.select("part", "id", F.lit(True).alias("word"), F.lit(-1).alias("idx"), F.lit(0.0).alias("x"), "group")  # every text once
    right = models.join(groups, "part").select("part", "idx", "weights", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    schema = pa.schema([("part", pa.int32()), ("id", pa.int64()), ("c", pa.float64()), ("probabilities", pa.list_(pa.float64()))])

    def solve(rows: pa.Table, fitted: pa.Table) -> pa.Table:
        if not rows.num_rows or not fitted.num_rows:
            return schema.empty_table()
        fitted = fitted.sort_by("idx")
        places = fitted.column("idx").to_numpy()
        weights = fitted.column("weights").combine_chunks().flatten().to_numpy().reshape(len(places), size)
        ids, row = np.unique(rows.column("id").to_numpy(), return_inverse=True)
        word, x, idx = (rows.column(n).to_numpy() for n in ("word", "x", "idx"))
        block = row * 2 + word
        norm = np.sqrt(np.bincount(block, x * x, 2 * len(ids)))[block]
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        at = np.minimum(np.searchsorted(places, idx), len(places) - 1)
        seen = (places[at] == idx) & (idx >= 0)
        row, at, x = row[seen], at[seen], x[seen]
        scores = np.stack([np.bincount(row, x * weights[at, j], len(ids)) for j in range(size)], axis=1) + weights[0]
        shares = np.concatenate([softmax(scores[:, i * len(labels):(i + 1) * len(labels)]) for i in range(len(c_grid))])
        offsets = pa.array(np.arange(len(shares) + 1, dtype=np.int32) * len(labels))
        return pa.table([pa.array(np.full(len(shares), rows.column("part")[0].as_py(), np.int32)), pa.array(np.tile(ids, len(c_grid))),
                         pa.array(np.repeat(np.array(c_grid, np.float64), len(ids))), pa.ListArray.from_arrays(offsets, pa.array(shares.ravel()))],
                        schema=schema)

    scored = known.unionByName(marks).groupBy("part", "group").cogroup(right.groupBy("part", "group")).applyInArrow(
        solve, "part int, id bigint, c double, probabilities array<double>")
    return scored.select("*", predicted_label(F.col("probabilities"), labels).alias("predicted"), F.array_max("probabilities").alias("confidence"))


def sparse_kernel(row: np.ndarray, column: np.ndarray, x: np.ndarray, texts: int) -> np.ndarray:
    """X X' of the entries of X: columns that many texts hold as dense matrices, the others by their pairs of texts."""
    kernel = np.zeros((texts, texts))
    order = np.argsort(column, kind="stable")
    row, x = row[order], x[order]
    count = np.bincount(column)
    start = np.cumsum(count) - count
    common = np.flatnonzero(count > 64)
    for i in range(0, len(common), 2048):
        dense = np.zeros((texts, len(common[i:i + 2048])))
        for j, c in enumerate(common[i:i + 2048]):
            mine = slice(start[c], start[c] + count[c])
            dense[row[mine], j] = x[mine]
        kernel += dense @ dense.T
    flat = kernel.ravel()
    for n in range(1, 65):
        held = start[count == n]
        step = max(1, (1 << 22) // (n * n))
        for i in range(0, len(held), step):
            at = held[i:i + step, None] + np.arange(n)
            pairs = row[at][:, :, None] * texts + row[at][:, None, :]
            flat += np.bincount(pairs.ravel(), (x[at][:, :, None] * x[at][:, None, :]).ravel(), texts * texts)
    return kernel


def weighed(rows: pa.Table, known: dict[str, pa.Table], documents: int) -> Iterator[tuple[int, int, bool, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, end, word, row, gram, x) of slices of ``rows``: entries before scaling, grams by their place in ``known`` of the block."""
    for i in range(0, rows.num_rows, TEXTS):
        mine = rows.slice(i, TEXTS)
        for block, text, gram, tf, names in gram_blocks(mine):
            at = pc.fill_null(pc.index_in(names, value_set=known[block].column("gram").combine_chunks()), -1).to_numpy().astype(np.int64)[gram]
            text, tf, at = text[at >= 0], tf[at >= 0], at[at >= 0]
            idf = np.log((1.0 + documents) / (1.0 + known[block].column("df").to_numpy()[at])) + 1.0
            yield i, i + mine.num_rows, block == "word", text, at, (1.0 + np.log(tf)) * idf


def part_predictions(texts: DataFrame, roles: DataFrame, labels: Sequence[str], c_grid: Sequence[float] = C_GRID, parts: int = 0) -> DataFrame:
    """(part, id, c, probabilities, predicted, confidence): models as of :func:`fit_parts`, scores as of :func:`score_parts`, grams left in tasks.

    ``texts``: id, text; ``roles``: id, label, fold. Texts of a fold are scored by the part that leaves it out (none where ``parts`` is 0),
    others by the last part, that of all folds. Models are fitted on all training texts. Up to FIT_TEXTS of them, or FIT_SIZE characters, texts are dealt into
    pieces of one fold, and what is shuffled are texts, the distinct grams of each piece, and with them the part's training texts: a model is
    their factors, and a piece makes from these the weights of its own grams. More training texts are fitted by :class:`Kernel`.
    """
    folds, size = max(parts, 1), len(labels) * len(c_grid)
    group = F.coalesce("fold", F.lit(folds))
    placed = texts.select("id", "text").join(roles.select("id", "label", group.cast("int").alias("fold")), "id")
    found = {r.fold: r for r in placed.groupBy("fold").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size")).collect()}  # one row a fold
    pieces = [max(1, -(-(found[f].size or 0) // PIECE)) if f in found else 0 for f in range(folds + 1)]
    starts = np.concatenate([[0], np.cumsum(pieces)]).tolist()
    fits = starts[-1]  # piece of the training texts of fold (or last part) f: fits + f
    trained = sum(found[f].n for f in found if f < folds)
    documents = [trained - (found[f].n if f in found and f < folds else 0) for f in range(folds + 1)]
    asked = [f for f in sorted(found) if parts or f == folds]
    if not asked or not trained:
        return texts.sparkSession.createDataFrame([], "part int, id bigint, c double, probabilities array<double>, predicted string, confidence double")
    index = F.create_map(*[x for i, k in enumerate(labels) for x in (F.lit(k), F.lit(i))])
    if trained > FIT_TEXTS or sum(found[f].size or 0 for f in found if f < folds) > FIT_SIZE:
        kernel = Kernel(texts, roles, roles.select("id", F.element_at(index, F.col("label")).alias("target")), parts, MIN_DF)
        wanted = [f if parts else 0 for f in asked if documents[f]]
        done = [kernel.scores(len(labels), *fitted) for fitted in kernel.fit(len(labels), c_grid, wanted)]
        return _labelled(reduce(DataFrame.unionByName, done), labels)
    one_of = lambda values: F.get(F.array(*[F.lit(int(v)) for v in values]), F.col("fold"))
    piece = (one_of(starts[:-1]) + F.pmod(F.xxhash64("id"), one_of([max(1, n) for n in pieces]))).cast("int")

    learning = roles.where(F.col("fold").isNotNull()).select(
        "id", F.element_at(index, F.col("label")).alias("target"),
        F.explode(F.array_except(F.array(*[F.lit(f) for f in asked]), F.array(F.col("fold").cast("int")))).alias("part")) if parts else (
        roles.where(F.col("fold").isNotNull()).select("id", F.element_at(index, F.col("label")).alias("target"), F.lit(folds).alias("part")))
    chosen = saved(learning.join(texts.select("id", "text"), "id"))

    none = F.lit(None)
    dealt = placed.select("id", "text", piece.alias("piece"), "fold", F.lit(True).alias("counts"))
    fitting = chosen.select("id", "text", (F.col("part") + fits).alias("piece"), F.col("part").alias("fold"), F.lit(False).alias("counts"))

    def count(table: pa.Table) -> pa.Table:
        fold, mine = (table.column(n)[0].as_py() for n in ("fold", "piece"))
        counts = table.column("counts")[0].as_py() and fold < folds
        tables = [counted.empty_table()]
        for block, _, gram, _, names in gram_blocks(table):
            n = np.bincount(gram, minlength=len(names)) if counts else np.zeros(len(names), np.int64)
            tables.append(pa.table([np.full(len(names), mine, np.int32), np.full(len(names), fold, np.int32), pa.array([block == "word"] * len(names), pa.bool_()),
                                    names, n.astype(np.int64)], schema=counted))
        return pa.concat_tables(tables)

    counted = pa.schema([("piece", pa.int32()), ("fold", pa.int32()), ("word", pa.bool_()), ("gram", pa.string()), ("n", pa.int64())])
    held = read_words(dealt.unionByName(fitting).repartition("piece"), "piece", "fold", "counts").groupBy("piece").applyInArrow(
        count, "piece int, fold int, word boolean, gram string, n bigint").repartition("word", "gram")
    own, every = Window.partitionBy("word", "gram", "fold"), Window.partitionBy("word", "gram")
    least = F.when(F.col("word"), MIN_DF["word"]).otherwise(MIN_DF["char"])
    known = saved(held.withColumn("_own", F.sum("n").over(own)).withColumn("df", F.sum("n").over(every) - F.col("_own"))
                  .where((F.col("df") >= least) & F.col("fold").isin(asked)).select("piece", "word", "gram", "df"))

    def by_block(known: pa.Table) -> dict[str, pa.Table]:
        return {b: known.filter(pc.equal(known.column("word"), b == "word")).select(["gram", "df"]) for b in MIN_DF}

    def fit(table: pa.Table, known: pa.Table) -> pa.Table:
        if not table.num_rows:
            return factors.empty_table()
        blocks, part = by_block(known), table.column("fold")[0].as_py()
        rows, columns, values, norms = [], [], [], np.zeros((2, table.num_rows))
        for start, end, word, row, at, x in weighed(table, blocks, documents[part]):
            norm = np.sqrt(np.bincount(row, x * x, end - start))
            norms[int(word), start:end] = norm
            rows.append(row + start)
            columns.append(at if word else at + blocks["word"].num_rows)
            values.append(x / norm[row])
        kernel = sparse_kernel(np.concatenate(rows), np.concatenate(columns), np.concatenate(values), table.num_rows)
        truth = np.zeros((table.num_rows, len(labels)))
        truth[np.arange(table.num_rows), table.column("target").to_numpy()] = 1.0
        found, fitted = [], None
        for c in c_grid:
            fitted = fit_kernel(kernel, truth, c, fitted)
            found.append(fitted)
        flat = np.concatenate(found, axis=1)  # one row a text, intercepts last
        offsets = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * size)
        return pa.table([pa.array(np.full(len(flat), part, np.int32)), pa.concat_arrays([table.column("id").combine_chunks(), pa.nulls(1, pa.int64())]),
                         pa.array(np.append(norms[1], 0.0)), pa.array(np.append(norms[0], 0.0)), pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))], schema=factors)

    factors = pa.schema([("fold", pa.int32()), ("id", pa.int64()), ("word", pa.float64()), ("char", pa.float64()), ("factors", pa.list_(pa.float64()))])
    to_fit = read_words(chosen.select("id", "text", (F.col("part") + fits).alias("piece"), F.col("part").alias("fold"), "target").repartition("piece"),
                        "piece", "fold", "target")
    models = saved(to_fit.groupBy("piece").cogroup(known.where(F.col("piece") >= fits).groupBy("piece")).applyInArrow(
        fit, "fold int, id bigint, word double, char double, factors array<double>"))

    def score(table: pa.Table, known: pa.Table) -> pa.Table:
        is_model = pc.is_valid(table.column("factors"))
        mine, model = table.filter(pc.invert(is_model)), table.filter(is_model)
        if not mine.num_rows or not model.num_rows:
            return scores_schema.empty_table()
        blocks, fold = by_block(known), table.column("fold")[0].as_py()
        alone = pc.is_null(model.column("id"))
        intercepts = model.filter(alone).column("factors").combine_chunks().flatten().to_numpy()
        model = model.filter(pc.invert(alone))
        alpha = model.column("factors").combine_chunks().flatten().to_numpy().reshape(-1, size)
        norms = {True: model.column("word").to_numpy(), False: model.column("char").to_numpy()}
        weights = {b == "word": np.zeros((size, blocks[b].num_rows)) for b in blocks}
        for start, end, word, row, at, x in weighed(model, blocks, documents[fold]):
            x = x / norms[word][start:end][row]
            for j in range(size):
                weights[word][j] += np.bincount(at, x * alpha[start:end, j][row], blocks["word" if word else "char"].num_rows)
        scores = np.zeros((mine.num_rows, size)) + intercepts
        for start, end, word, row, at, x in weighed(mine, blocks, documents[fold]):
            x = x / np.sqrt(np.bincount(row, x * x, end - start))[row]
            for j in range(size):
                scores[start:end, j] += np.bincount(row, x * weights[word][j][at], end - start)
        shares = np.concatenate([softmax(scores[:, i * len(labels):(i + 1) * len(labels)]) for i in range(len(c_grid))])
        offsets = pa.array(np.arange(len(shares) + 1, dtype=np.int32) * len(labels))
        ids = mine.column("id").to_numpy()
        part = fold if parts else 0
        return pa.table([pa.array(np.full(len(shares), part, np.int32)), pa.array(np.tile(ids, len(c_grid))),
                         pa.array(np.repeat(np.array(c_grid, np.float64), len(ids))), pa.ListArray.from_arrays(offsets, pa.array(shares.ravel()))], schema=scores_schema)

    scores_schema = pa.schema([("part", pa.int32()), ("id", pa.int64()), ("c", pa.float64()), ("probabilities", pa.list_(pa.float64()))])
    blank = {n: none.cast(t).alias(n) for n, t in (("word", "double"), ("char", "double"), ("factors", "array<double>"))}
    shared = models.join(chosen.select("id", F.col("part").alias("fold"), "text"), ["id", "fold"], "left").withColumn(
        "piece", F.explode(F.sequence(one_of(starts[:-1]), one_of([s + max(1, n) - 1 for s, n in zip(starts, pieces)])))).select(  # noqa: B905
        "id", "text", "piece", "fold", "word", "char", "factors")
    to_score = dealt.where(F.col("fold").isin(asked)).select("id", "text", "piece", "fold", *blank.values()).unionByName(shared)
    ready = read_words(to_score.repartition("piece"), "piece", "fold", "word", "char", "factors")
    scored = ready.groupBy("piece").cogroup(known.where(F.col("piece") < fits).groupBy("piece")).applyInArrow(
        score, "part int, id bigint, c double, probabilities array<double>")
    return _labelled(scored, labels)


def _labelled(scored: DataFrame, labels: Sequence[str]) -> DataFrame:
    return scored.select("*", predicted_label(F.col("probabilities"), labels).alias("predicted"), F.array_max("probabilities").alias("confidence"))


def grouped_cv(df: DataFrame, labels: Sequence[str], seed: str, c_grid: Sequence[float] = C_GRID, k: int = 5) -> DataFrame:
    """(c, id, label, predicted, confidence): each text of ``df`` (id, label, text, family) by the models that leave its fold out.

    Vocabulary and idf are those of the training folds. A fold whose texts are all there are has no predictions.
    """
    roles = saved(df.select("id", "label").join(fold_families(df, seed, k), "id"))
    return part_predictions(df, roles, labels, c_grid, k).join(roles.select("id", "label"), "id").select("c", "id", "label", "predicted", "confidence")


def best_parameter(scores: DataFrame) -> DataFrame:
    """C of the highest score at six decimals; the smaller C on ties."""
    return scores.agg(F.max_by("c", F.struct(
        F.round("score", 6).alias("s"), (-F.col("c")).alias("c"))).alias("best_c"))


class Training(NamedTuple):
    """What a training run leaves: its choices, its model and its predictions."""

    splits: DataFrame  # id, family, split
    folded: DataFrame  # c, id, label, predicted, confidence: out of fold, on the training texts
    scores: DataFrame  # c, score
    best_c: float
    calibration: DataFrame  # threshold table of the out-of-fold and validation predictions
    threshold: float
    scored: DataFrame  # split, id, label, probabilities, predicted, confidence, acted_on; validation and test


def train_intents(texts: DataFrame, families: DataFrame, labels: Sequence[str], seed: str,
                  c_grid: Sequence[float] = C_GRID, k: int = 5) -> Training:
    """Split by families, choose C by grouped cross-validation on the training texts, fit, calibrate, and score the rest once.

    ``texts``: id, label, text (masked, as the classifier reads it); ``families``: id, family. Nothing of the validation and
    test texts enters vocabulary, idf, folds or fits; the test texts take no part in the threshold either. To the driver come the
    best C and the threshold.
    """
    splits = saved(split_families(texts.join(families, "id"), seed))
    rows = saved(texts.join(splits, "id"))
    folds = fold_families(rows.where("split = 'train'"), seed, k)
    roles = rows.select("id", "label", "split").join(folds, "id", "left")
    roles = saved(roles)
    all_scores = saved(part_predictions(rows, roles, labels, c_grid, k).join(roles, "id"))
    folded = all_scores.where(F.col("part") < k).select("c", "id", "label", "predicted", "confidence")
    scores = saved(classification_metrics(folded, labels, ["c"]).select("c", F.col("macro_f1").alias("score")))
    best_c = best_parameter(scores).first()["best_c"] or min(c_grid)
    scored = all_scores.where((F.col("part") == k) & (F.col("c") == best_c)).select("split", "id", "label", "probabilities", "predicted", "confidence")
    judged = folded.where(F.col("c") == best_c).select("label", "predicted", "confidence").unionByName(
        scored.where("split = 'validation'").select("label", "predicted", "confidence"))
    calibration = saved(threshold_table(judged))
    threshold = choose_threshold(calibration).first()["threshold"] or THRESHOLD_FLOOR
    return Training(splits, folded, scores, best_c, calibration, threshold,
                    scored.withColumn("acted_on", F.col("confidence") >= threshold))


# --------------------------------------------------------------------------- #
# Evaluation
# --------------------------------------------------------------------------- #


def _cells(df: DataFrame, labels: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Counts per (true, predicted); the matrix is |labels| squared rows per group at most."""
    return df.groupBy(*by, "label", "predicted").agg(F.count(F.lit(1)).alias("n"))


def class_metrics(df: DataFrame, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """precision, recall, F1 and support per label; 0 where undefined, absent labels shown."""
    cells = _cells(df, labels, by)
    name = F.explode(F.array(*[F.lit(v) for v in labels]))
    groups = cells.select(*by).distinct() if by else cells.sparkSession.range(1).select()
    frame = groups.select(*by, name.alias("label"))
    true = cells.groupBy(*by, "label").agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    guessed = cells.groupBy(*by, F.col("predicted").alias("label")).agg(F.sum("n").alias("guessed"))
    zero = F.lit(0).cast("bigint")
    m = frame.join(true, [*by, "label"], "left").join(guessed, [*by, "label"], "left").select(
        *by, "label", F.coalesce("support", zero).alias("support"),
        F.coalesce("hit", zero).alias("hit"), F.coalesce("guessed", zero).alias("guessed"))
    precision = F.coalesce(F.try_divide("hit", "guessed"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * F.col("hit"), F.col("guessed") + F.col("support")),
                    F.lit(0.0))
    return m.select(*by, "label", precision.alias("precision"), recall.alias("recall"),
                    f1.alias("f1"), "support", "hit")


def classification_metrics(df: DataFrame, labels: Sequence[str],
                           by: Sequence[str] = ()) -> DataFrame:
    """count, accuracy, macro and weighted F1 in one row per group."""
    return class_metrics(df, labels, by).groupBy(*by).agg(
        F.sum("support").alias("count"),
        F.try_divide(F.sum("hit"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))


def confusion(df: DataFrame, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows true, columns predicted, in the fixed label order."""
    return _cells(df, labels, by).groupBy(*by, "label").pivot("predicted", list(labels)).agg(
        F.sum("n")).na.fill(0, list(labels))


def threshold_table(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accepted, coverage, errors and precision for thresholds 0.30 .. 0.95.

    One pass: fourteen conditional counts, then unpivoted; the rows are never multiplied.
    """
    ok = F.col("label") == F.col("predicted")
    aggs = [F.count(F.lit(1)).alias("_total")]
    for i, t in enumerate(THRESHOLD_GRID):
        hit = F.col("confidence") >= t
        aggs += [F.count_if(hit).alias(f"_a{i}"), F.count_if(hit & ~ok).alias(f"_e{i}")]
    rows = F.explode(F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.col(f"_a{i}").alias("accepted"),
                 F.col(f"_e{i}").alias("accepted_errors"))
        for i, t in enumerate(THRESHOLD_GRID)]))
    return df.groupBy(*by).agg(*aggs).select(*by, "_total", rows.alias("r")).select(
        *by, "r.threshold", "r.accepted",
        F.try_divide("r.accepted", "_total").alias("coverage"), "r.accepted_errors",
        F.coalesce(F.try_divide(F.col("r.accepted") - F.col("r.accepted_errors"),
                                F.col("r.accepted")), F.lit(1.0)).alias("accepted_precision"))


def choose_threshold(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Lowest threshold precise enough, else the last; never below the floor."""
    lowest = F.min(F.when(F.col("accepted_precision") >= TARGET_PRECISION, F.col("threshold")))
    return table.groupBy(*by).agg(F.greatest(
        F.coalesce(lowest, F.max("threshold")), F.lit(THRESHOLD_FLOOR)).alias("threshold"))


def system_outcome(label: Column, clarified: Column, chosen: Column, comparison: Column) -> Column:
    """correct / clarified / WRONG of a routed question against its label."""
    declines = label.isin("CLARIFICATION", "UNSUPPORTED")
    expected = (
        F.when(label == "TEMPORAL_NDWI", "temporal_ndwi").when(label == "TRUE_COLOR", "imagery")
        .otherwise(F.lower(label)))
    right = (chosen == expected) & (comparison == (label == "TEMPORAL_NDWI"))
    return (
        F.when(clarified & declines, "correct").when(clarified, "clarified")
        .when(declines, "WRONG").when(right, "correct").otherwise("WRONG"))


def system_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, "outcome").agg(F.count(F.lit(1)).alias("n"))


def latency_summary(df: DataFrame, by: Sequence[str] = (), value: str = "ms") -> DataFrame:
    """Mean and exact 95th percentile."""
    from earthframe.operators.pixels import value_percentiles

    key = list(by) or ["_all"]
    src = df if by else df.withColumn("_all", F.lit(1))
    mean = src.groupBy(*key).agg(F.avg(value).alias("mean_ms"), F.count(value).alias("n"))
    out = mean.join(value_percentiles(src, key, value, (0.95,)), key).withColumnRenamed(
        "p95", "p95_ms")
    return out if by else out.drop("_all")


def evaluate_sets(scored: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Metrics of several (set, model) predictions in one job: before and after, side by side."""
    return classification_metrics(scored, labels, ["set", "model"])


def before_after(metrics: DataFrame, before: str, after: str) -> DataFrame:
    """(set, metric, before, after, change): the figures of two models on each set that both have scored."""
    names = ("count", "accuracy", "macro_f1", "weighted_f1")
    rows = metrics.select("set", "model", F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m"))
    value = lambda model: F.max(F.when(F.col("model") == model, F.col("m.value")))
    return rows.groupBy("set", F.col("m.metric").alias("metric")).agg(value(before).alias("before"), value(after).alias("after")).where(
        "before IS NOT NULL AND after IS NOT NULL").withColumn("change", F.col("after") - F.col("before"))
