"""Whitening of embeddings from an exact integer scatter matrix.

Entries become integers, x = floor(scale * c). Over the distinct x vectors each task subtracts a shift and adds
up counts, sums and cross-products as integers of any size (products of 20-bit limbs are exact in float64);
n * X'X - S S' is formed exactly, and only then are floats made and decomposed by eigh. Where the eigenvalues
asked for differ by more than eigh can resolve (far outliers, badly scaled dimensions), the leading subspace is
iterated in fixed point, taken out exactly, and eigh works on the rest.

The driver holds d x d integers, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import add_up, chunked, remove, settle, shuffles_removed

SCALE = 256
COMPONENTS = 4
#: Bits of a limb: 8192 products of two limbs add up exactly in float64. Rows a task works on at once.
LIMB, ROWS = 20, 4096
#: eigh gives eigenvalues down to this share of the largest; those asked for that are smaller are found after the larger are taken out.
RESOLVED = 1e-4
#: Bits behind the point of vectors and matrices in fixed point, and bits to which an iterated subspace is settled.
POINT, SETTLED = 512, 480
#: Rows whose float projection could be off by more than this (of a unit of variance) are projected in fixed point.
BLUR = 1e-9
#: Rows of which the shift is the median. The shift changes no result, only the size of the integers.
SHIFT_ROWS = 256


def quantised(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, x (array of long) of vectors that take part.

    Null vectors and those with a null or non-finite entry are dropped. Integers beyond a long become the nearest
    long. Vectors shorter than the longest count as followed by zeros. A null vec_id is kept.
    """
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = rows.where(F.coalesce(fine, F.lit(False))).select("vec_id", F.transform("embedding", lambda c: F.floor(c * scale)).alias("x"))
    least, most = x.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least == most:
        return x
    return x.select("vec_id", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(most) - F.size("x"))).alias("x"))


def matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def linear(n: int, x: np.ndarray, s: np.ndarray) -> np.ndarray:
    """n * x - s, exactly: as int64 where that surely holds it, else as Python integers."""
    if n * largest(x) + largest(s) < 1 << 62:
        return n * x - s.astype(np.int64)
    return n * x.astype(object) - s


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Float arrays that add up to x when the k-th is taken times 2 ** (LIMB * k)."""
    out = []
    while largest(x) >= 1 << LIMB:
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x = x >> LIMB
    return [*out, x.astype(np.float64)]


def cross(x: np.ndarray) -> np.ndarray:
    """x'x as Python integers, for at most 8192 rows."""
    parts = limbs(x)
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts[: i + 1]):
            p = (a.T @ b).astype(np.int64).astype(object)
            total += (p if i == j else p + p.T) << (LIMB * (i + j))
    return total


def packed(numbers: np.ndarray) -> bytes:
    """Integers of any size, all in as many bytes as the largest needs."""
    width = largest(numbers).bit_length() // 8 + 1
    return width.to_bytes(4, "little") + b"".join(int(v).to_bytes(width, "little", signed=True) for v in numbers)


def unpacked(blob: bytes) -> np.ndarray:
    width = int.from_bytes(blob[:4], "little")
    return np.array([int.from_bytes(blob[i : i + width], "little", signed=True) for i in range(4, len(blob), width)], object)


def sum_exactly(df: DataFrame, ways: int = 32) -> np.ndarray | None:
    """Sum of packed integer vectors in the column v, in two steps, so that the driver gets at most `ways` of them."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            for blob in b.column(0).to_pylist():
                out = unpacked(blob) if out is None else out + unpacked(blob)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([packed(out)], pa.binary())], ["v"])

    with shuffles_removed(df.sparkSession):
        rows = df.select("v").repartition(ways).mapInArrow(total, "v binary").collect()
    return sum((unpacked(r.v) for r in rows[1:]), unpacked(rows[0].v)) if rows else None


def scatter(fit: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Of the integer vectors x: their number n, their sums S, and n * X'X - S S', all exact."""
    near = [np.array(r.x, object) for r in fit.limit(SHIFT_ROWS).collect()]
    if not near:
        return 0, np.zeros(0, object), np.zeros((0, 0), object)
    shift = np.sort(np.array(near, object), axis=0)[len(near) // 2] if near[0].size else near[0]
    d = len(shift)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, object), np.zeros((d, d), object)
        for t in chunked(batches, most_rows=ROWS):
            x = linear(1, matrix(t.column(0)), shift)
            n += len(x)
            sums += x.astype(object).sum(axis=0) if x.dtype == object or largest(x) > 1 << 48 else x.sum(axis=0).astype(object)
            products += cross(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([packed(np.concatenate([[n], sums, products.ravel()]))], pa.binary())], ["v"])

    total = sum_exactly(fit.select("x").mapInArrow(partial, "v binary"))
    n, sums, products = int(total[0]), total[1 : d + 1], total[d + 1 :].reshape(d, d)
    return n, sums + n * shift, n * products - np.outer(sums, sums)


def floats(m: np.ndarray, unit: int = 1) -> np.ndarray:
    """m / unit, each entry rounded once."""
    return np.array([int(v) / unit for v in m.ravel()], np.float64).reshape(m.shape)


def falling(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w, q = np.linalg.eigh(m)
    return w[::-1], q[:, ::-1]


def orthonormal(columns: np.ndarray, against: list[np.ndarray]) -> list[np.ndarray]:
    """Gram-Schmidt in fixed point, each column twice."""
    out: list[np.ndarray] = []
    for y in columns.T:
        for _ in range(2):
            for q in [*against, *out]:
                y = y - (q * (int(q.dot(y)) >> POINT) >> POINT)
            y = (y << (POINT + 64)) // max(1, math.isqrt(int(y.dot(y)))) >> 64
        out.append(y)
    return out


def principal(m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, of a positive semidefinite matrix of integers, and unit eigenvectors in columns, in fixed point.

    Eigenvalues under 2 ** -64 are zero (an integer matrix with such a leading value is not of full rank). The
    entry of a vector that is largest in absolute value is positive.
    """
    k = min(k, len(m))
    values, known = [], []
    rest = m << POINT
    while len(values) < k and (top := largest(rest)) >> (POINT - 64):
        w, q = falling(floats(rest, top))
        need = k - len(values)
        good = int((w[:need] >= RESOLVED * w[0]).sum())
        if good == need:
            values += [x * (top / (1 << POINT)) for x in w[:need]]
            known += orthonormal(np.array([[int(x * (1 << 80)) << (POINT - 80) for x in row] for row in q[:, :need]], object), known)
            break
        # A gap is left among the leading ones: the subspace over the widest is iterated until it is settled, then taken out.
        floor = np.maximum(w[: good + 1], 1e-16 * w[0])
        a = int((floor[:-1] / floor[1:]).argmax()) + 1
        basis = orthonormal(np.array([[int(x * (1 << 80)) << (POINT - 80) for x in row] for row in q[:, :a]], object), known)
        before = None
        while True:
            b = np.array(basis, object).T
            y = rest.dot(b)
            inner = b.T.dot(y) >> POINT
            off = largest(y - (b.dot(inner) >> POINT))
            # Rounding leaves a little of what was taken out before: then nothing is won any more.
            if off <= largest(y) >> SETTLED or before is not None and off >= before:
                break
            before = off
            basis = orthonormal(y >> max(0, largest(y).bit_length() - POINT), known)
        size = largest(inner)
        w, u = falling(floats(inner + inner.T, 2 * size))
        values += [x * (size / (1 << (2 * POINT))) for x in w]
        known += orthonormal(b.dot(np.array([[int(x * (1 << 80)) << (POINT - 80) for x in row] for row in u], object)) >> POINT, known)
        rest = rest - (b.dot(inner.dot(b.T) >> POINT) >> (2 * POINT))
    known += [np.zeros(len(m), object)] * (k - len(known))
    values += [0.0] * (k - len(values))
    known = [-q if q[np.abs(q).argmax()] < 0 else q for q in known]
    return np.array(values), np.array(known, object).reshape(k, len(m)).T


@dataclass
class Whitening:
    """A fit: the number of distinct vectors, their sums, the eigenvalues of n * n * covariance, its trace, and the components in columns."""

    scale: int
    n: int
    sums: np.ndarray
    values: np.ndarray
    trace: int
    fixed: np.ndarray
    identity_error: float | None = None

    def __post_init__(self) -> None:
        self.components = floats(self.fixed, 1 << POINT)

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - S, exactly, and the whitened coordinates; those on components without any variance are nan."""
        y = linear(self.n, x, self.sums)
        z = y.astype(np.float64)
        live = self.values > 0
        p = z @ self.components
        if live.any() and z.size:
            far = np.flatnonzero(np.abs(z).max(axis=1) * (x.shape[1] * 2.0**-52) > BLUR * math.sqrt(self.values[live].min()))
            if len(far):
                p[far] = floats(y[far].astype(object).dot(self.fixed), 1 << POINT)
        with np.errstate(divide="ignore", invalid="ignore"):
            return y, np.where(live, p / np.sqrt(self.values), np.nan)


def fit(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> Whitening | None:
    """Fits on each distinct x vector once; None if no vector takes part."""
    spark = rows.sparkSession
    kept, path = settle(quantised(rows, scale).select("x").distinct())
    n, sums, m = scatter(kept)
    if not n:
        remove(spark, path)
        return None
    values, vectors = principal(m, components)
    out = Whitening(scale, n, sums, values, int(np.trace(m)), vectors)
    live = np.flatnonzero(values > 0)
    k = len(live)

    def sums_of(power: int, centre: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k if power == 1 else k * k)
            for t in chunked(batches, most_rows=ROWS):
                w = out.project(matrix(t.column(0)))[1][:, live] - centre
                total += w.sum(0) if power == 1 else (w.T @ w).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

        return add_up(kept.mapInArrow(run, "v binary"), k if power == 1 else k * k)

    if k:
        centre = sums_of(1, np.zeros(k)) / n
        out.identity_error = float(np.abs(sums_of(2, centre).reshape(k, k) / n - np.eye(k)).max())
    remove(spark, path)
    return out


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"


def transform(rows: DataFrame, w: Whitening) -> DataFrame:
    """A row for each vector that takes part and each component.

    deviation is the exact sum of (n * x - S) ** 2, null where it is beyond a long; deviation_text always has it.
    whitened is null on a component without variance (then explained is 0), explained and identity_error are null
    if there is no variance at all.
    """
    k = len(w.values)
    explained = [v / w.trace if w.trace else None for v in w.values.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunked(batches, most_rows=ROWS):
            y, z = w.project(matrix(t.column(1)))
            if y.size and largest(y) ** 2 * y.shape[1] >= 1 << 63:
                y = y.astype(object)
            deviation = [int(v) for v in (y * y).sum(axis=1)]
            m = t.num_rows
            yield from pa.Table.from_arrays(
                [
                    t.column(0).combine_chunks().take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, w.n)),
                    pa.array([v if v < 1 << 63 else None for v in deviation for _ in range(k)], pa.int64()),
                    pa.array(z.ravel(), from_pandas=True),
                    pa.array(explained * m, pa.float64()),
                    pa.array([w.identity_error] * (m * k), pa.float64()),
                    pa.array([str(v) for v in deviation for _ in range(k)]),
                ],
                [c.split()[0] for c in RESULT.split(", ")],
            ).to_batches()

    return quantised(rows.withColumn("vec_id", F.col("vec_id").cast("long")), w.scale).mapInArrow(run, RESULT)


def whiten(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Fit and transform; a table without a vector that takes part, or with empty ones only, gives no rows."""
    w = fit(rows, components, scale)
    return transform(rows, w) if w else rows.sparkSession.createDataFrame([], RESULT)
