"""Whitening of vectors: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

Spark reads the vectors and adds up counts, sums and scatter; each task sends one row. What meets at the
driver is one matrix of the vectors' dimension, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cellweft.llm.common import fields, tune, written

SCALE = 64
SHIFT = 1_000_000
#: Quantised entries are whole numbers below this in size; a row with a larger one takes no part.
LARGEST = 2 ** 52
EPS = float(np.finfo(np.float64).eps)


# Dense algebra on one matrix ------------------------------------------------------------


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor, order) with matrix[order][:, order] = factor @ factor.T; columns stop at the numerical rank."""
    rest = np.array(matrix, np.float64)
    n = len(rest)
    order = np.arange(n)
    factor = np.zeros((n, n))
    floor = n * EPS * max(float(np.diag(rest).max(initial=0.0)), 0.0)
    for k in range(n):
        best = k + int(np.argmax(np.diag(rest)[k:]))
        if rest[best, best] <= floor:
            return factor[:, :k], order
        for part in (rest, factor, order):
            part[[k, best]] = part[[best, k]]
        rest[:, [k, best]] = rest[:, [best, k]]
        factor[k, k] = np.sqrt(rest[k, k])
        factor[k + 1:, k] = rest[k + 1:, k] / factor[k, k]
        rest[k + 1:, k + 1:] -= np.outer(factor[k + 1:, k], factor[k + 1:, k])
    return factor, order


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of 0 .. n - 1 once, in rounds of disjoint pairs."""
    seats = list(range(n + n % 2))
    for _ in range(len(seats) - 1):
        left, right = np.array(seats[:len(seats) // 2]), np.array(seats[:len(seats) // 2 - 1:-1])
        real = (left < n) & (right < n)
        yield left[real], right[real]
        seats.insert(1, seats.pop())


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Columns turned pairwise until all are orthogonal to rounding."""
    turned = factor.copy()
    for _ in range(sweeps):
        still = True
        for i, j in _rounds(turned.shape[1]):
            a, b = turned[:, i], turned[:, j]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            turn = np.abs(ab) > EPS * np.sqrt(aa * bb)
            if not turn.any():
                continue
            still = False
            i, j, a, b, aa, bb, ab = i[turn], j[turn], a[:, turn], b[:, turn], aa[turn], bb[turn], ab[turn]
            zeta = (bb - aa) / (2 * ab)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            turned[:, i], turned[:, j] = c * a - c * t * b, c * t * a + c * b
        if still:
            break
    return turned


def eigen(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of a covariance, by falling value; directions without variance are left out."""
    factor, order = pivoted_cholesky(covariance)
    turned = one_sided_jacobi(factor)
    norms = np.sqrt((turned * turned).sum(axis=0))
    falling = np.argsort(-norms, kind="stable")
    falling = falling[norms[falling] > 0]
    vectors = np.empty((len(covariance), len(falling)))
    vectors[order] = turned[:, falling] / norms[falling]
    return norms[falling] ** 2, vectors


# Passes over the rows -------------------------------------------------------------------


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers, first entries, sizes) of the non-null lists of a column, in the order of its flat values."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.flatnonzero(sizes >= 0)
    return rows, np.cumsum(sizes[rows]) - sizes[rows], sizes[rows]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), pa.array(values))


def quantised(vectors: DataFrame, id: str, vector: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, x): x = floor(scale * entry) + shift as long, of rows whose vector holds finite entries only, at least one."""
    schema = fields(id=vectors.schema[id].dataType.simpleString(), x="array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, first, sizes = _rows(batch.column(1))
            flat = batch.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null becomes nan
            whole = np.floor(flat * scale)
            bad = np.concatenate([[0], np.cumsum(~(np.abs(whole) < LARGEST))])
            good = (sizes > 0) & (bad[first + sizes] == bad[first])
            kept = whole[np.repeat(good, sizes)].astype(np.int64) + shift
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows[good])), _lists(kept, sizes[good]).cast(pa.list_(pa.int64()))],
                schema=pa.schema([("id", batch.schema.field(0).type), ("x", pa.list_(pa.int64()))]))

    return vectors.select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").alias("v")).mapInArrow(run, schema)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, size)


def _added(rows: DataFrame, size: int, width: int, kind: str, part: Callable[[np.ndarray], np.ndarray]) -> list:
    """Element-wise sums of ``part(matrix of x)`` over all rows: one row per task, added up by Spark per element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                new = part(_matrix(batch.column(0), size))
                total = new if total is None else total + new
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["part"])

    parts = rows.select("x").mapInArrow(run, fields(part=f"array<{kind}>")).select(F.posexplode("part"))
    exact = "decimal(38,0)" if kind == "bigint" else kind
    found = {r["pos"]: r["total"] for r in parts.groupBy("pos").agg(F.sum(F.col("col").cast(exact)).alias("total")).collect()}
    return [found.get(i, 0) for i in range(width)]


@dataclass(frozen=True)
class Whitening:
    """What the fit list tells: n vectors, their exact sums, and the components by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole part and remainder of the mean: sums = n * whole + rest, 0 <= rest < n."""
        return np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.parts()
        return (x - whole).astype(np.float64) - rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sum)**2, exact; null where a long can't hold it."""
        whole, rest = self.parts()
        away = x - whole
        bound = self.n * (int(np.abs(away).max(initial=0)) + 1)
        if bound * bound * x.shape[1] < 2 ** 63:
            return ((self.n * away - rest) ** 2).sum(axis=1).tolist()
        exact = ((self.n * away.astype(object) - rest.astype(object)) ** 2).sum(axis=1)
        return [int(v) if v < 2 ** 63 else None for v in exact]


def fit(x: DataFrame, components: int = 16) -> Whitening | None:
    """Fit on each distinct x once; null without rows. Vectors of another size than most distinct ones have take no part."""
    unique = written(x.select("x").distinct(), "whitening-fit")
    sizes = unique.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), "size").first()
    if most is None:
        return None
    size, n = int(most["size"]), int(most["n"])
    unique = unique.filter(F.size("x") == size)
    sums = tuple(int(s) for s in _added(unique, size, size, "bigint", lambda m: m.sum(axis=0)))
    mean = Whitening(n, sums, np.empty(0), np.empty((size, 0)), 0.0, 0.0)

    def scatter(m: np.ndarray) -> np.ndarray:
        away = mean.centred(m)
        return (away.T @ away).ravel()

    covariance = np.array(_added(unique, size, size * size, "double", scatter), np.float64).reshape(size, size) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = eigen(covariance)
    values, vectors = values[:components], vectors[:, :components]
    k = len(values)
    rough = Whitening(n, sums, values, vectors, float(np.trace(covariance)), 0.0)

    def spread(m: np.ndarray) -> np.ndarray:
        """Sum, scatter about the part's own mean, and what its mean adds."""
        y = rough.whitened(m)
        own = y.mean(axis=0)
        away = y - own
        return np.concatenate([y.sum(axis=0), (away.T @ away + len(y) * np.outer(own, own)).ravel()])

    total = np.array(_added(unique, size, k + k * k, "double", spread), np.float64)
    middle = total[:k] / n
    error = np.abs(total[k:].reshape(k, k) / n - np.outer(middle, middle) - np.eye(k)).max(initial=0.0)
    return Whitening(n, sums, values, vectors, rough.trace, float(error))


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """Per usable row: id, x, n, deviation, whitened (array), explained (array), identity_error.

    Entries become x = floor(64 * entry) + 1,000,000. Null vectors, empty ones, and those holding a null or non-finite entry
    (or one above 2**52 / 64) are left out, as are vectors of another size than that of most distinct ones (ties: the
    smaller). The fit takes each distinct x once, so repeated rows weigh no more than one; each of them is returned. A null id
    is kept. Directions without variance give no component: equal vectors have empty arrays. An empty table gives an
    empty one. Other columns are left out, whatever their names. The fit reads a written list of the distinct x three times; its
    sums are one row per task, and the driver holds one matrix of the vectors' size.
    """
    spark = tune(vectors.sparkSession)
    x = quantised(vectors, id, vector)
    schema = T.StructType([*x.schema.fields, *fields(n="bigint", deviation="bigint", whitened="array<double>",
                                                     explained="array<double>", identity_error="double").fields])
    model = fit(x, components)
    if model is None:
        return spark.createDataFrame([], schema)
    size, k = len(model.sums), len(model.values)
    explained = (model.values / model.trace).tolist() if k else []

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(1), size)
            y = model.whitened(rows)
            scored = [pa.array(model.deviations(rows), pa.int64()), _lists(y.ravel(), np.full(len(rows), k)).cast(pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *scored], names=["id", "x", "deviation", "whitened"])

    told = T.StructType([f for f in schema if f.name in ("id", "x", "deviation", "whitened")])
    scored = x.filter(F.size("x") == size).mapInArrow(score, told)
    return scored.select("id", "x", F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
                         F.lit(explained).cast("array<double>").alias("explained"), F.lit(model.identity_error).alias("identity_error"))
