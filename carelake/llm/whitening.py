"""Whitening of embeddings by incremental eigendecomposition.

Every task goes over its distinct vectors once and keeps their count, exact sums, mean and the spectrum of their
scatter matrix: a new vector is one centred rank-one update, whose eigenvalues are the roots of a secular equation.
Entries that hardly take part, and eigenvalues that coincide, are deflated before; eigenvectors come from the roots by
the formula of Loewner, which keeps them orthogonal. Spectra are combined in a tree of groups: one spectrum's pairs,
and the difference of the means, are further rank-one updates of the other. The basis that results is refined by
Rayleigh-Ritz: tasks project the exactly centred vectors, the small matrices of products are summed by Spark, and its
eigenvectors turn the basis, until what is off the diagonal is rounding. A last pass measures the covariance of the
whitened vectors.

Integers x = floor(scale * c) + OFFSET stand for components c. Vectors that are null, or hold null, non-finite or
components of 2^55 or more (no long could hold them), take no part. Shorter vectors count as padded with c = 0. Equal
vectors are fitted once; all rows are returned, repeated and null ids too. A table without variance (one vector, or
none) has no components and no result rows; components whose eigenvalue is rounding (RANK of the largest) are left
out. Further columns are passed over. A task holds one matrix of width x width and a batch of rows; a rank-one update
costs about the cube of the width. What is broadcast is a few such matrices; the driver sees one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import ship, written

OFFSET = 1_000_000
#: Spectra that one task combines.
FAN = 8
#: Eigenvalues below this share of the largest are rounding.
RANK = 1e-13
#: Passes of Rayleigh-Ritz at most, and the off-diagonal share at which they end.
PASSES, SETTLED = 6, 1e-12
_EPS = float(np.finfo(float).eps)
_SPECTRUM = "n long, sums array<decimal(38,0)>, mean array<double>, values array<double>, basis array<double>"


# ---- a rank-one update of a spectrum ----------------------------------------------------------------------------


def _secular(d: np.ndarray, z2: np.ndarray) -> np.ndarray:
    """Differences d_j - root_i (row i) for the roots of 1 + sum z2_j / (d_j - x) = 0; d ascends strictly, z2 > 0.

    Each root is sought from its nearer pole, by the interpolation that has both neighbouring poles, inside a bracket
    that is halved whenever a step would leave it.
    """
    k = len(d)
    upper = np.append(d[1:], d[-1] + z2.sum())
    gap = upper - d
    middle = d + gap / 2
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        at_middle = 1 + (z2 / (d - middle[:, None])).sum(axis=1)
        left = at_middle >= 0  # the root lies in the left half: its own pole is nearer
        left[-1] = True
        origin = np.where(left, d, upper)
        delta = d - origin[:, None]  # poles as seen from the origin, row by row
        low = np.where(left, 0.0, -gap / 2)
        high = np.where(left, np.where(np.arange(k) == k - 1, gap, gap / 2), 0.0)
        mu = (low + high) / 2
        own = np.arange(k)
        below = np.tri(k)  # the poles up to a root's own
        right = np.minimum(own + 1, k - 1)
        todo = own
        for _ in range(80):
            inverse = 1 / (delta[todo] - mu[todo, None])
            lower, square = inverse * below[todo], inverse * inverse
            up_to = lower @ z2
            total = inverse @ z2
            f = 1 + total
            wide = high[todo] - low[todo] > 2 * _EPS * np.maximum(np.abs(low[todo]), np.abs(high[todo]))
            open_ = (np.abs(f) > 4 * k * _EPS * (1 + total - 2 * up_to)) & wide
            if not open_.any():
                break
            slope, psi = (square @ z2)[open_], ((lower * lower) @ z2)[open_]
            todo, f = todo[open_], f[open_]
            low[todo], high[todo] = np.where(f < 0, mu[todo], low[todo]), np.where(f < 0, high[todo], mu[todo])
            near, far = delta[todo, todo] - mu[todo], delta[todo, right[todo]] - mu[todo]
            c = f - near * psi - far * (slope - psi)
            a = (near + far) * f - near * far * slope
            b = near * far * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            # The last root has no pole beyond it.
            step = np.where(todo == k - 1, f * near / (f - near * psi), step)
            tried = mu[todo] + step
            fits = np.isfinite(tried) & (tried > low[todo]) & (tried < high[todo])
            mu[todo] = np.where(fits, tried, (low[todo] + high[todo]) / 2)
    return delta - mu[:, None]


def rank_one(values: np.ndarray, basis: np.ndarray, vector: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum (ascending values, basis by columns) of B diag(values) B' + weight * vector vector', weight > 0."""
    z = np.sqrt(weight) * (basis.T @ vector)
    norm2 = float(z @ z)
    if norm2 == 0.0:
        return values, basis
    tiny = 8 * _EPS * max(float(values[-1]), norm2)
    # Coinciding values: a reflection leaves one entry of z for the whole cluster.
    ends = np.flatnonzero(np.append(np.diff(values) > tiny, True)) + 1
    if len(ends) < len(values):
        start, basis = 0, basis.copy()
        for end in ends:
            if end - start > 1:
                part = z[start:end].copy()
                length = np.linalg.norm(part)
                if length > 0:
                    mirror = part.copy()
                    mirror[-1] += np.copysign(length, part[-1])
                    mirror /= np.linalg.norm(mirror)
                    z[start:end] = 0.0
                    z[end - 1] = -np.copysign(length, part[-1])
                    block = basis[:, start:end]
                    basis[:, start:end] = block - 2 * np.outer(block @ mirror, mirror)
            start = end
    taking = np.flatnonzero(z * z > tiny * _EPS)
    if not len(taking):
        return values, basis
    d, z2 = values[taking], z[taking] ** 2
    k = len(d)
    if k < len(values):
        basis = basis.copy()
    apart = _secular(d, z2)  # apart[i, j] = d_j - root_i
    own = np.arange(k)
    poles = d[None, :] - d[:, None]  # poles[i, j] = d_j - d_i
    poles[own, own] = 1.0
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = apart / poles
        ratio[own, own] = apart[own, own]
        entry = np.sqrt(np.abs(ratio.prod(axis=0))) * np.sign(z[taking])
        vectors = entry / apart
        length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        vectors /= length[:, None]
    if not np.isfinite(length.sum()) or not length.all():  # a root upon a pole: the old direction stands
        lost = ~np.isfinite(length) | (length == 0)
        vectors[lost] = np.eye(k)[lost]
    if k == len(values):
        return d - apart[own, own], basis @ vectors.T  # roots ascend as the poles do
    new_values = values.copy()
    new_values[taking] = d - apart[own, own]
    basis[:, taking] = basis[:, taking] @ vectors.T
    order = np.argsort(new_values, kind="stable")
    return new_values[order], basis[:, order]


@dataclass
class Spectrum:
    """Count, exact sums, mean and scatter (values ascending, basis by columns) of some vectors."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    basis: np.ndarray

    @classmethod
    def empty(cls, width: int) -> Spectrum:
        return cls(0, [0] * width, np.zeros(width), np.zeros(width), np.eye(width))

    def add(self, rows: np.ndarray) -> None:
        """One centred update for each row of integers; `mean` is that of x - OFFSET."""
        exact = rows.astype(object) if np.abs(rows).max(initial=0) > 2**40 else rows
        self.sums = [a + int(b) for a, b in zip(self.sums, exact.sum(axis=0), strict=True)]
        for x in (rows - OFFSET).astype(float):
            self.n += 1
            apart = x - self.mean
            if self.n > 1:
                self.values, self.basis = rank_one(self.values, self.basis, apart, (self.n - 1) / self.n)
            self.mean = self.mean + apart / self.n

    def merge(self, other: Spectrum) -> None:
        """The other's pairs, then the difference of the means, as updates of this one."""
        if other.n == 0:
            return
        if self.n == 0:
            self.n, self.sums, self.mean, self.values, self.basis = other.n, other.sums, other.mean, other.values, other.basis
            return
        for value, vector in zip(other.values, other.basis.T, strict=True):
            if value > 0:
                self.values, self.basis = rank_one(self.values, self.basis, vector, float(value))
        n = self.n + other.n
        apart = other.mean - self.mean
        self.values, self.basis = rank_one(self.values, self.basis, apart, self.n / n * other.n)
        self.mean = self.mean + apart * (other.n / n)
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        self.n = n

    def row(self) -> dict[str, list]:
        return {
            "n": [self.n], "sums": [self.sums], "mean": [self.mean.tolist()],
            "values": [self.values.tolist()], "basis": [self.basis.ravel().tolist()],
        }

    @classmethod
    def of(cls, n: int, sums, mean, values, basis) -> Spectrum:
        width = len(mean)
        return cls(int(n), [int(s) for s in sums], np.array(mean, float), np.array(values, float), np.array(basis, float).reshape(width, width))


# ---- Spark: vectors, spectra, refinement, projection ------------------------------------------------------------


def integer_vectors(df: DataFrame, id_column: str, vector: str, scale: float = 64.0) -> DataFrame:
    """id and x, for the rows that take part."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= 2.0**55))
    chosen = df.where(F.col(vector).isNotNull()).where(~odd)
    x = F.transform(vector, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long") + F.lit(OFFSET).cast("long"))
    return chosen.select(F.col(id_column).alias("id"), x.alias("x"))


def _padded(x: str, width: int) -> Column:
    missing = F.array_repeat(F.lit(OFFSET).cast("long"), F.lit(width) - F.size(x))
    return F.when(F.size(x) == width, F.col(x)).otherwise(F.concat(F.col(x), missing))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A batch of arrays, all of one width, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def spectrum(distinct: DataFrame, width: int) -> Spectrum:
    """The spectrum of all vectors (column x): one per task, then groups of FAN until one is left."""
    spark = distinct.sparkSession
    ship(spark)
    shape = spark.createDataFrame([], _SPECTRUM).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(shape)

    def batch(found: Spectrum) -> pa.RecordBatch:
        columns = found.row()
        columns["sums"] = [[_decimal(s) for s in columns["sums"][0]]]
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Spectrum.empty(width)
        for rows in batches:
            found.add(_matrix(rows.column(0), width))
        if found.n:
            yield batch(found)

    def combine(table: pa.Table) -> pa.Table:
        found = Spectrum.empty(width)
        for row in sorted(table.select(arrow.names).to_pylist(), key=lambda r: (r["n"], r["mean"])):
            found.merge(Spectrum.of(**row))
        return pa.Table.from_batches([batch(found)])

    level = written(distinct.select("x").mapInArrow(fit, shape), "spectra")
    while (left := level.count()) > FAN:
        groups = -(-left // FAN)
        key = F.pmod(F.xxhash64("n", "mean"), F.lit(groups))
        level = written(level.withColumn("part", key).groupBy("part").applyInArrow(combine, shape), "spectra")
    found = Spectrum.empty(width)
    for row in sorted(level.collect(), key=lambda r: (r["n"], r["mean"])):  # FAN spectra at most
        found.merge(Spectrum.of(*row))
    return found


def _decimal(value: int):
    from decimal import Decimal

    return Decimal(value)


def centred(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: as 64-bit integers where they suffice, else as Python's."""
    largest = max(int(np.abs(rows).max(initial=0)), max(map(abs, sums), default=0) // max(n, 1))
    if 4 * n * (largest + 1) < 2**63:
        return n * rows - np.array(sums, np.int64)
    return n * rows.astype(object) - np.array(sums, object)


def _deviation(apart: np.ndarray) -> list[int | None]:
    """Sum of squares per row, exactly; None where no long can hold it."""
    largest = int(np.abs(apart).max(initial=0))
    if apart.dtype != object and apart.shape[1] * largest * largest < 2**63:
        return (apart * apart).sum(axis=1).tolist()
    whole = apart.astype(object)
    return [int(s) if s < 2**63 else None for s in (whole * whole).sum(axis=1)]


def products(distinct: DataFrame, width: int, n: int, sums: list[int], basis: np.ndarray) -> np.ndarray:
    """The covariance (divisor n) of all vectors, centred and projected on `basis`: summed per task, then by Spark."""
    ship(distinct.sparkSession)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((basis.shape[1], basis.shape[1]))
        for rows in batches:
            y = (centred(_matrix(rows.column(0), width), n, sums) / n).astype(float) @ basis
            total += y.T @ y
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(total.size), pa.int32()), "v": pa.array(total.ravel() / n)})

    summed = distinct.select("x").mapInArrow(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(basis.shape[1] ** 2)
    for row in summed.collect():  # the square of the basis' size
        out[row["i"]] = row["v"]
    return out.reshape(basis.shape[1], basis.shape[1])


@dataclass(frozen=True)
class Whitening:
    """Components by falling eigenvalue: unit columns of `basis`, with what the projection needs."""

    width: int
    n: int
    sums: list[int]
    values: np.ndarray
    basis: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit(vectors: DataFrame, components: int = 16) -> Whitening:
    """The first `components` of the distinct vectors (column x of `vectors`, a written table)."""
    width = vectors.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    nothing = Whitening(width, 0, [0] * width, np.zeros(0), np.zeros((width, 0)), np.zeros(0), 0.0)
    if width == 0:
        return nothing
    distinct = written(vectors.select(_padded("x", width).alias("x")).distinct(), "distinct-vectors")
    found = spectrum(distinct, width)
    if found.n < 2:
        return nothing
    basis = np.linalg.qr(found.basis[:, ::-1])[0]
    for _ in range(PASSES):
        ritz = products(distinct, width, found.n, found.sums, basis)
        values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        basis = np.linalg.qr(basis @ turn[:, ::-1])[0]
        off = np.abs(ritz - np.diag(np.diag(ritz))).max()
        if off <= SETTLED * max(abs(values[-1]), 1e-300):
            break
    values = values[::-1]
    kept = min(components, int((values > RANK * max(values[0], 0.0)).sum()))
    if values[0] <= 0 or kept == 0:
        return nothing
    whitened = products(distinct, width, found.n, found.sums, basis[:, :kept] / np.sqrt(values[:kept]))
    error = float(np.abs(whitened - np.eye(kept)).max())
    return Whitening(width, found.n, found.sums, values[:kept], basis[:, :kept], values[:kept] / values.sum(), error)


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """A row per row of `vectors` (id, x) and component: id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    ship(spark)
    scaled = model.basis / np.sqrt(model.values) if len(model.values) else model.basis
    width, n, sums = model.width, model.n, model.sums
    id_type = vectors.schema["id"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not scaled.shape[1]:
                continue
            apart = centred(_matrix(rows.column(1), width), n, sums)
            y = (apart / n).astype(float) @ scaled
            flat = pa.array(y.ravel())
            at = pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(_deviation(apart), pa.int64()), pa.ListArray.from_arrays(at, flat)],
                names=["id", "deviation", "whitened"],
            )

    mapped = vectors.select("id", _padded("x", max(width, 1)).alias("x")).mapInArrow(
        project, f"id {id_type}, deviation long, whitened array<double>"
    )
    explained = F.array(*[F.lit(float(e)) for e in model.explained]) if len(model.explained) else F.array().cast("array<double>")
    return mapped.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "id",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
