"""Whitening of vectors by a compensated covariance and its eigenvectors.

Sums of outer products are kept in double-double: a value is an unevaluated sum of a high and a low double, and the rounding errors
of every product and sum go to the low part by error-free transformations.  A task sums its rows, tasks are merged high and low
apart, and the driver sees a few symmetric matrices, whose size is the square of the dimension, never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import saved
from lodestone.llm.vectors import as_lists, finite, matrices

#: Quantisation: floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Components that are returned at most.
COMPONENTS = 8
#: Rows whose products are held at once; merged partial sums that the driver takes.
ROWS, MERGED = 64, 16
#: Below this share of the largest eigenvalue a component is rounding noise of a constant direction.
FLAT = 1e-13

Pair = tuple[np.ndarray, np.ndarray]


# Error-free transformations
def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def split(a: np.ndarray) -> Pair:
    """Two halves of 26 bits each, for products without error."""
    c = 134217729.0 * a
    high = c - (c - a)
    return high, a - high


def two_product(a: np.ndarray, b: np.ndarray, a_halves: Pair, b_halves: Pair) -> Pair:
    p = a * b
    (ah, al), (bh, bl) = a_halves, b_halves
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(x: Pair, y: Pair) -> Pair:
    s, e = two_sum(x[0], y[0])
    t, f = two_sum(x[1], y[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def total(x: Pair) -> Pair:
    """The sum over the first axis, by halves."""
    high, low = x
    while len(high) > 1:
        half = len(high) // 2
        a = add((high[:half], low[:half]), (high[half : 2 * half], low[half : 2 * half]))
        high, low = (np.concatenate([p, q[2 * half :]]) for p, q in zip(a, (high, low)))
    return high[0], low[0]


def outer_sum(high: np.ndarray, low: np.ndarray) -> Pair:
    """The sum of the rows' outer products, upper triangle row by row."""
    i, j = np.triu_indices(high.shape[1])
    out = (np.zeros(len(i)), np.zeros(len(i)))
    for at in range(0, len(high), ROWS):
        h, w = high[at : at + ROWS], low[at : at + ROWS]
        halves = split(h)
        p, e = two_product(h[:, i], h[:, j], (halves[0][:, i], halves[1][:, i]), (halves[0][:, j], halves[1][:, j]))
        e = e + (h[:, i] * w[:, j] + w[:, i] * h[:, j])
        out = add(out, total(two_sum(p, e)))
    return out


# Eigenvectors of a symmetric matrix
def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q): a = q t q' by Householder reflections."""
    a, n = a.astype(np.float64).copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0 or not np.any(x[1:]):
            continue
        x[0] += np.copysign(norm, x[0])
        x /= np.linalg.norm(x)
        a[k + 1 :] -= 2 * np.outer(x, x @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def _secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of diag(d) + rho z z', d rising and distinct, z without zeros, rho > 0.

    A root is held as its distance from the nearer of the poles around it, so that differences to poles keep their digits.
    """
    n, square = len(d), z * z
    above = np.append(d[1:], d[-1] + rho * square.sum())
    middle = (d + above) / 2
    value = 1 + rho * (square / (d[None, :] - middle[:, None])).sum(axis=1)
    left = (value >= 0) | (np.arange(n) == n - 1)
    pole = np.where(left, d, above)
    gap = (above - d) / 2
    low, high = np.where(left, 0.0, -gap), np.where(left, np.where(np.arange(n) == n - 1, 2 * gap, gap), 0.0)
    apart = d[None, :] - pole[:, None]
    for _ in range(200):  # halving, in the exponent first where the interval touches the pole
        near = np.minimum(np.abs(low), np.abs(high))
        far = np.maximum(np.abs(low), np.abs(high))
        sign = np.where(left, 1.0, -1.0)
        wide = far > 4 * np.maximum(near, far * 1e-40)
        mid = np.where(wide, sign * np.sqrt(np.maximum(near, far * 1e-40) * far), (low + high) / 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            f = 1 + rho * (square / (apart - mid[:, None])).sum(axis=1)
        low, high = np.where(f < 0, mid, low), np.where(f < 0, high, mid)
        if np.all(np.abs(high - low) <= 2e-16 * np.maximum(np.abs(low), np.abs(high))):
            break
    root = (low + high) / 2
    to_pole = apart - root[:, None]  # d[j] - value[i]
    # The z for which these values are exact: vectors of it are orthogonal to working precision.
    with np.errstate(divide="ignore"):
        logs = np.log(np.abs(to_pole)).sum(axis=0)
        others = np.abs(d[None, :] - d[:, None])
        np.fill_diagonal(others, 1.0)
        logs -= np.log(others).sum(axis=0)
    exact = np.copysign(np.exp(logs / 2), z)
    vectors = exact[None, :] / to_pole
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    return pole + root, vectors.T


def _rank_one(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of diag(d) + rho z z': entries that z doesn't touch, and all but one of equal ones, are deflated."""
    n = len(d)
    if rho < 0:
        values, vectors = _rank_one(-d, z, -rho)
        return -values, vectors
    order = np.argsort(d, kind="stable")
    d, z, back = d[order].copy(), z[order].copy(), np.eye(n)[:, order]
    small = 8e-16 * max(np.abs(d).max(initial=0.0), abs(rho) * (z @ z))
    kept: list[int] = []
    for i in range(n):
        if rho * abs(z[i]) * np.sqrt(z @ z) <= small:
            z[i] = 0.0
            continue
        if kept and d[i] - d[kept[-1]] <= small:  # a rotation moves the earlier one's share of z to this one
            p = kept.pop()
            r = np.hypot(z[p], z[i])
            c, s = z[i] / r, z[p] / r
            z[i], z[p] = r, 0.0
            back[:, [p, i]] = back[:, [p, i]] @ np.array([[c, s], [-s, c]])
        kept.append(i)
    values, vectors = d.copy(), np.eye(n)
    if kept:
        values[kept], vectors[np.ix_(kept, kept)] = _secular(d[kept], z[kept], rho)
    return values, back @ vectors


def divide_and_conquer(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors (columns) of a tridiagonal matrix: two halves and an update of rank one."""
    n = len(d)
    if n == 1:
        return d.copy(), np.ones((1, 1))
    m = n // 2
    rho = e[m - 1]
    upper, lower = d[:m].copy(), d[m:].copy()
    upper[-1] -= rho
    lower[0] -= rho
    (a, p), (b, q) = divide_and_conquer(upper, e[: m - 1]), divide_and_conquer(lower, e[m:])
    vectors = np.zeros((n, n))
    vectors[:m, :m], vectors[m:, m:] = p, q
    values = np.concatenate([a, b])
    if rho == 0:
        return values, vectors
    values, turn = _rank_one(values, np.concatenate([p[-1], q[0]]), rho)
    return values, vectors @ turn


def eigen(matrix: Pair) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit vectors (columns) of a symmetric double-double matrix.

    The high part is solved; a step of refinement with residuals in double-double takes up the low part.
    """
    d, e, q = tridiagonal(matrix[0])
    values, vectors = divide_and_conquer(d, e)
    vectors = q @ vectors
    for _ in range(2):
        residual = _product(matrix, vectors)
        inner = vectors.T @ residual
        excess = np.eye(len(values)) - vectors.T @ vectors
        values = np.diag(inner) / (1 - np.diag(excess))
        gaps = values[None, :] - values[:, None]
        close = np.abs(gaps) <= 1e-10 * np.abs(values).max(initial=0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            turn = np.where(close, excess / 2, (inner + values[None, :] * excess) / gaps)
        vectors = vectors + vectors @ turn
        vectors /= np.linalg.norm(vectors, axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _product(matrix: Pair, vectors: np.ndarray) -> np.ndarray:
    """matrix @ vectors, summed in double-double."""
    out = []
    for v in vectors.T:
        p, e = two_product(matrix[0], v[None, :], split(matrix[0]), split(v[None, :]))
        high, low = total((p.T, (e + matrix[1] * v[None, :]).T))
        out.append(high + low)
    return np.array(out).T


# The job
class Center:
    """S / n per dimension, as double-double."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.high = np.array([s / n for s in sums])
        self.low = np.array([float(Fraction(s, n) - Fraction(h)) for s, h in zip(sums, self.high.tolist())])

    def of(self, x: np.ndarray) -> Pair:
        high = x.astype(np.float64)
        low = (x - high.astype(np.int64)).astype(np.float64)
        h, e = two_sum(high, -self.high)
        return two_sum(h, e + (low - self.low))


def quantised(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors).astype(np.int64) + OFFSET


def _merge(parts: DataFrame) -> dict[int, tuple[int, Pair]]:
    """Sums of (d, n, high, low) per d: tasks merge most of them, the driver the last few."""

    def merged(rows: Iterable[tuple[int, int, np.ndarray, np.ndarray]]) -> dict[int, tuple[int, Pair]]:
        out: dict[int, tuple[int, Pair]] = {}
        for d, n, high, low in rows:
            own = out.get(d)
            out[d] = (n, (high, low)) if own is None else (own[0] + n, add(own[1], (high, low)))
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r["d"], r["n"], np.array(r["high"], np.float64), np.array(r["low"], np.float64)) for b in batches for r in b.to_pylist())
        yield from _rows(merged(rows))

    few = parts.repartition(MERGED).mapInArrow(run, parts.schema).collect()
    return merged((r["d"], r["n"], np.array(r["high"], np.float64), np.array(r["low"], np.float64)) for r in few)


def _rows(sums: dict[int, tuple[int, Pair]]) -> Iterator[pa.RecordBatch]:
    for d, (n, (high, low)) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([n], pa.int64()), as_lists(high[None, :]), as_lists(low[None, :])], ["d", "n", "high", "low"])


def _sums(vectors: DataFrame, work: Callable[[int, np.ndarray], Pair]) -> dict[int, tuple[int, Pair]]:
    """(count, double-double sum) per `_d` over the vectors `_v`; work(d, matrix) gives the sum of a block's rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, tuple[int, Pair]] = {}
        for batch in batches:
            for d, _, m in matrices(batch.column(1), batch.column(0)):
                n, so_far = own.get(d, (0, None))
                got = work(d, m)
                own[d] = (n + len(m), got if so_far is None else add(so_far, got))
        yield from _rows(own)

    return _merge(vectors.select("_d", "_v").mapInArrow(run, "d int, n long, high array<double>, low array<double>"))


def _square(d: int, n: int, triangle: Pair) -> Pair:
    """The covariance of a triangle of sums."""
    out = []
    i, j = np.triu_indices(d)
    high = triangle[0] / n
    p, e = two_product(high, np.float64(n), split(high), split(np.float64(n)))
    low = ((triangle[0] - p) - e + triangle[1]) / n
    for part in two_sum(high, low):
        m = np.zeros((d, d))
        m[i, j] = part
        m[j, i] = part
        out.append(m)
    return out[0], out[1]


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error (and deviation_exact) per vector and component.

    Vectors that are null or hold null or non-finite entries are dropped; all others are fitted and returned, rows with a null or a
    repeated id too.  Vectors of each dimension are a fit of their own (of none, no rows).  `deviation` is null where the exact value
    is beyond 63 bits; `deviation_exact` has it up to 38 digits.  Along a direction without variance (all vectors equal, or fewer
    of them than dimensions) `whitened` is null; `identity_error` is about the others, and null if there are none.  An empty table
    gives no rows; other columns aren't looked at.
    """
    vector = F.col(f"`{vector_col}`")
    data = df.where(finite(vector_col)).where(F.size(vector) > 0)
    data = saved(data.select(F.col(f"`{id_col}`").alias("vec_id"), F.size(vector).alias("_d"), vector.cast("array<double>").alias("_v")), "vectors")

    def halves(d: int, m: np.ndarray) -> Pair:  # of 2^26, so that doubles hold a block's sums, and pairs of them all sums, exactly
        x = quantised(m)
        sums = np.concatenate([(x >> 26).astype(np.float64).sum(axis=0), (x & (2**26 - 1)).astype(np.float64).sum(axis=0)])
        return sums, np.zeros_like(sums)

    centers = {}
    for d, (n, (high, low)) in _sums(data, halves).items():
        exact = [int(h) + int(w) for h, w in zip(high.tolist(), low.tolist())]
        centers[d] = Center(n, [(a << 26) + b for a, b in zip(exact[:d], exact[d:])])
    fits, explained = {}, {}
    for d, (n, triangle) in _sums(data, lambda d, m: outer_sum(*centers[d].of(quantised(m)))).items():
        covariance = _square(d, n, triangle)
        values, vectors = eigen(covariance)
        k = min(components, d)
        trace = float(np.trace(covariance[0]))
        firm = values[:k] > FLAT * max(values[0], 0.0)
        fits[d] = (vectors[:, :k], firm, 1 / np.sqrt(np.where(firm, values[:k], 1.0)))
        explained[d] = [float(v) / trace if trace > 0 else None for v in values[:k]]

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, m in matrices(batch.column(2)):
                x = quantised(m)
                high, low = centers[d].of(x)
                vectors, firm, scale = fits[d]
                z = np.where(firm, (high @ vectors + low @ vectors) * scale, 0.0)
                n, sums = centers[d].n, centers[d].sums
                exact = [str(sum((n * c - s) ** 2 for c, s in zip(row, sums))) for row in x.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(exact, pa.string()), as_lists(z)], ["vec_id", "_d", "_dev", "_v"])

    kind = data.schema["vec_id"].dataType.simpleString()
    made = saved(data.mapInArrow(project, f"vec_id {kind}, _d int, _dev string, _v array<double>"), "whitened")

    # The covariance of what was written, centred by its own means.
    means = {d: (h + w) / n for d, (n, (h, w)) in _sums(made, lambda _, m: total((m, np.zeros_like(m)))).items()}
    facts = []
    for d, (n, triangle) in _sums(made, lambda d, m: outer_sum(*two_sum(m, np.broadcast_to(-means[d], m.shape)))).items():
        firm = fits[d][1]
        own = _square(len(firm), n, triangle)[0][np.ix_(firm, firm)]
        error = float(np.abs(own - np.eye(len(own))).max()) if firm.any() else None
        facts += [(d, c + 1, n, bool(firm[c]), explained[d][c], error) for c in range(len(firm))]
    known = df.sparkSession.createDataFrame(facts, "_d int, component int, n long, _firm boolean, explained double, identity_error double")
    rows = made.select("vec_id", "_d", F.col("_dev").try_cast("decimal(38,0)").alias("deviation_exact"), F.posexplode("_v").alias("_c", "_w"))
    rows = rows.withColumn("component", F.col("_c") + 1).join(F.broadcast(known), ["_d", "component"])
    return rows.select(
        "vec_id",
        "component",
        "n",
        F.col("deviation_exact").try_cast("long").alias("deviation"),
        F.when(F.col("_firm"), F.col("_w")).alias("whitened"),
        "explained",
        "identity_error",
        "deviation_exact",
    )
