"""Whitening of embeddings along the leading components of their scatter.

Two passes over the vectors give the sums and then the scatter about the exact mean, each folded to one row a
partition before the shuffle. The scatter of one dimension is a matrix whose size depends on the dimension
alone; one task factors it: pivoted Cholesky yields a triangular factor L with L L' = scatter, and one-sided Jacobi turns the
columns of L itself until they are orthogonal, so small eigenvalues keep their digits. The squared column norms are the
eigenvalues, the normalised columns the components. A third pass projects every vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earthframe.lineage import saved

#: Components that are returned at most.
COMPONENTS = 8
#: Entries are counted in steps of 1/SCALE above -SHIFT; an entry of 2^ENTRY steps or more can't be counted exactly.
SCALE, SHIFT, ENTRY = 1024, 100_000, 44
#: Vector lengths that are fitted by one set of passes; the models of a set are what tasks are sent.
LENGTHS = 16
SWEEPS = 60


def pivoted_cholesky(scatter: np.ndarray) -> np.ndarray:
    """Columns L with L L' = scatter, the largest remaining diagonal entry first, up to the numerical rank."""
    rest = np.array(scatter, np.float64)
    size = len(rest)
    left = rest.diagonal().copy()
    floor = size * np.finfo(np.float64).eps * max(left.max(initial=0.0), 0.0)
    columns: list[np.ndarray] = []
    for _ in range(size):
        at = int(np.argmax(left))
        if left[at] <= floor:
            break
        column = rest[:, at].copy()
        for done in columns:
            column -= done * done[at]
        column /= np.sqrt(left[at])
        columns.append(column)
        left -= column * column
        left[at] = 0.0
    return np.array(columns).reshape(len(columns), size).T


def _rounds(width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of columns once, dealt into rounds of disjoint pairs; an odd last place stands for no column."""
    even = width + width % 2
    ring = np.arange(even)
    for _ in range(even - 1):
        a, b = ring[:even // 2], ring[even // 2:][::-1]
        real = np.maximum(a, b) < width
        yield a[real], b[real]
        ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """``factor`` with its columns rotated against each other until all are orthogonal, longest first."""
    turned = np.array(factor, np.float64)
    limit = np.finfo(np.float64).eps * max(1, len(turned))
    for _ in range(SWEEPS):
        worst = 0.0
        for a, b in _rounds(turned.shape[1]):
            x, y = turned[:, a], turned[:, b]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(xx * yy)
            open_ = np.abs(xy) > limit * size
            if not open_.any():
                continue
            worst = max(worst, float((np.abs(xy[open_]) / size[open_]).max()))
            zeta = (yy[open_] - xx[open_]) / (2 * xy[open_])
            tan = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            cos = 1 / np.sqrt(1 + tan * tan)
            sin = cos * tan
            turned[:, a[open_]] = cos * x[:, open_] - sin * y[:, open_]
            turned[:, b[open_]] = sin * x[:, open_] + cos * y[:, open_]
        if worst <= limit:
            break
    return turned[:, np.argsort(-(turned * turned).sum(0), kind="stable")]


def factored(scatter: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a scatter matrix, falling, and its unit eigenvectors as rows; none beyond its rank."""
    turned = one_sided_jacobi(pivoted_cholesky(scatter))[:, :k]
    values = (turned * turned).sum(0)
    return values, (turned / np.sqrt(values)).T


def counted(vectors: pa.Array, dim: int) -> np.ndarray:
    """Entries of vectors of one length as whole steps."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(flat * SCALE) + SHIFT).astype(np.int64).reshape(-1, dim)


def sound_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector, dim) of rows whose vector has entries, all finite and countable."""
    out = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= float(2**ENTRY // SCALE)))
    return out.where((F.size("vector") > 0) & ~bad).withColumn("dim", F.size("vector"))


def by_length(rows: DataFrame, fold: Callable[[int, np.ndarray], np.ndarray], kind: str) -> DataFrame:
    """(dim, place, value): arrays that ``fold`` makes of the batches of each vector length, summed over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = batch.column("dim").to_numpy()
            for dim in np.unique(lengths).tolist():
                part = fold(dim, counted(batch.column("vector").filter(pa.array(lengths == dim)), dim))
                sums[dim] = sums[dim] + part if dim in sums else part
        for dim, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([total])], ["dim", "parts"])

    parts = rows.select("dim", "vector").mapInArrow(run, f"dim int, parts array<{kind}>")
    total = "decimal(38,0)" if kind == "bigint" else "double"
    return (parts.select("dim", F.posexplode("parts").alias("place", "part")).groupBy("dim", "place")
            .agg(F.sum(F.col("part").cast(total)).alias("value")))


def _centred(steps: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Steps less their mean: whole parts subtracted exactly, the rest of the mean as a double."""
    whole = np.array([s // n for s in sums], np.int64)
    return (steps - whole) - np.array([(s % n) / n for s in sums])


def _deviation(steps: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum of (n*x - S)^2 of each row, exact; null where it is no 64-bit number."""
    rough = ((_centred(steps, n, sums) * n) ** 2).sum(1)
    wrapped = np.array([s % 2**64 for s in sums], np.uint64)
    with np.errstate(over="ignore"):  # arithmetic modulo 2^64 is exact wherever the sum itself fits
        gap = steps.astype(np.uint64) * np.uint64(n) - wrapped
        exact = (gap * gap).sum(1, dtype=np.uint64)
    return pa.array(exact.view(np.int64), mask=rough >= 2.0**63)


def fit(rows: DataFrame, lengths: list[int], k: int = COMPONENTS) -> list[tuple]:
    """(dim, n, sums, eigenvalues, trace, components) for each of the given vector lengths."""
    mine = rows.where(F.col("dim").isin(lengths))
    sums: dict[int, dict[int, int]] = {}
    for dim, place, value in by_length(mine, lambda dim, x: np.append(x.sum(0), len(x)), "bigint").collect():
        sums.setdefault(dim, {})[place] = int(value)
    means = {dim: (s[dim], [s[i] for i in range(dim)]) for dim, s in sums.items()}

    def scatter(dim: int, steps: np.ndarray) -> np.ndarray:
        gap = _centred(steps, *means[dim])
        return (gap.T @ gap).ravel()

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        dim = table.column("dim")[0].as_py()
        matrix = table.column("value").to_numpy().reshape(dim, dim) / means[dim][0]
        values, components = factored(matrix, k)
        return pa.table({"dim": pa.array([dim], pa.int32()), "values": pa.array([values], pa.list_(pa.float64())),
                         "trace": [float(np.trace(matrix))], "axes": pa.array([components.ravel()], pa.list_(pa.float64()))})

    solved = (by_length(mine, scatter, "double").groupBy("dim")
              .applyInArrow(solve, "dim int, values array<double>, trace double, axes array<double>").collect())
    return [(r["dim"], *means[r["dim"]], np.array(r["values"]), r["trace"], np.array(r["axes"]).reshape(-1, r["dim"])) for r in solved]


def project(rows: DataFrame, models: list[tuple]) -> DataFrame:
    """(vec_id, dim, n, deviation, whitened array, explained array) of the rows whose length has a model."""
    fitted = {m[0]: m[1:] for m in models}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("dim").to_numpy()
            for dim in np.unique(lengths).tolist():
                mine = batch.filter(pa.array(lengths == dim))
                n, sums, values, trace, axes = fitted[dim]
                steps = counted(mine.column("vector"), dim)
                flat = (_centred(steps, n, sums) @ axes.T) / np.sqrt(values)
                offsets = pa.array(np.arange(len(steps) + 1, dtype=np.int32) * len(values))
                explained = np.tile(values / trace if len(values) else values, len(steps))
                yield pa.RecordBatch.from_arrays(
                    [mine.column("vec_id"), mine.column("dim"), pa.array(np.full(len(steps), n)), _deviation(steps, n, sums),
                     pa.ListArray.from_arrays(offsets, pa.array(flat.ravel())), pa.ListArray.from_arrays(offsets, pa.array(explained))],
                    ["vec_id", "dim", "n", "deviation", "whitened", "explained"])

    return rows.where(F.col("dim").isin(list(fitted))).mapInArrow(
        run, "vec_id bigint, dim int, n bigint, deviation bigint, whitened array<double>, explained array<double>")


def identity_errors(whitened: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """(dim, identity_error): largest entry of the covariance of the whitened values less the identity.

    The table may hold up to LENGTHS vector lengths, so the means that are broadcast are LENGTHS rows at most.
    """
    flat = whitened.select("dim", *[F.get("whitened", F.lit(i)).alias(f"w{i}") for i in range(k)])
    means = flat.groupBy("dim").agg(*[F.avg(f"w{i}").alias(f"m{i}") for i in range(k)])
    gaps = flat.join(F.broadcast(means), "dim").select("dim", *[(F.col(f"w{i}") - F.col(f"m{i}")).alias(f"g{i}") for i in range(k)])
    entries = [F.abs(F.avg(F.col(f"g{i}") * F.col(f"g{j}")) - F.lit(float(i == j))) for i in range(k) for j in range(i, k)]
    return gaps.groupBy("dim").agg(F.greatest(*entries).alias("identity_error"))


def whiten(embeddings: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates: vec_id, component, n, deviation, whitened, explained, identity_error.

    One row for each vector and component, up to ``k`` and to the rank of the scatter: a direction without variance
    can't be whitened and has no rows, so a single vector or equal vectors give none. Rows whose vector is null, empty or
    holds a null or non-finite entry, or one of 2^34 or more, take no part. Every other row counts, repeated rows and null ids too. Vectors
    of different lengths are fitted apart, each length over its own rows. ``deviation`` is null where it exceeds a 64-bit number. Equal
    eigenvalues leave the choice of their components open.
    """
    rows = sound_vectors(embeddings)
    lengths = sorted(r[0] for r in rows.select("dim").distinct().collect())
    out = None
    for first in range(0, max(1, len(lengths)), LENGTHS):
        part = saved(project(rows, fit(rows, lengths[first:first + LENGTHS], k)))
        part = part.join(F.broadcast(identity_errors(part, k)), "dim")  # LENGTHS rows at most
        out = part if out is None else out.unionByName(part)
    return (out
            .select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "pair"))
            .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation",
                    F.col("pair.whitened").alias("whitened"), F.col("pair.explained").alias("explained"), "identity_error"))
