"""Embedding whitening by a bidiagonal qd solver.

Vectors become integers ``x = floor(1024 c) + 100000``; the covariance of x over all
usable vectors (divisor n) is never formed. Blocks of centred rows are reduced to
triangles by Householder QR in parallel, triangles are stacked and reduced in a
tree, Householder reflections bring the last one to an upper bidiagonal B, dqds finds
its singular values to high relative accuracy, and a twisted factorisation of each
shifted ``B^T B`` gives the whitening direction; directions of values closer than
``CLOSE`` are made orthogonal to each other. Eigenvalues are ``sigma^2 / n``.

Rows with a null vector, null or non-finite entries, entries whose x does not fit a
long, no entries, or another length than most (of equally common lengths the
longest) are dropped. Components without variance (n too small, constant or
dependent dimensions: sigma below ``dim * 2^-49`` of the largest) have no whitened
value and are left out, so one vector alone gives no rows. Repeated rows count as
often as they stand. A null id is an id. ``deviation`` is null where it exceeds a long.
Extra columns are ignored; empty tables give no rows.

Memory: a task holds a block of ``BLOCK`` rows and a triangle; the driver sees one row
a dimension and one triangle.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagemark.llm.common import store

SCALE, SHIFT = 1024.0, 100_000
BLOCK = 2048
FAN = 32
CLOSE = 1e-3
EPS = 2.0 ** -53
_LIMIT = 2.0 ** 61


# ---- the solver, on one small triangle

def householder_r(rows: np.ndarray) -> np.ndarray:
    """R of a QR factorisation (LAPACK's Householder one), at most square."""
    return np.linalg.qr(rows, mode="r")


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of ``U^T R V`` and V, for square R."""
    a, m = r.astype(np.float64).copy(), len(r)
    v = np.eye(m)

    def mirror(x):
        u, size = x.copy(), np.linalg.norm(x)
        u[0] += np.copysign(size, x[0])
        length = np.linalg.norm(u)
        return u / length if length else u

    for k in range(m):
        u = mirror(a[k:, k])
        a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k < m - 2:
            w = mirror(a[k, k + 1:])
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ w, w)
            v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def dqds(d: list[float], e: list[float]) -> list[float]:
    """Squared singular values of the bidiagonal (d, e), largest first. ``q, e`` hold the
    squares; a shifted transform that would lose positivity is repeated with half
    the shift, and without shift at last."""
    found: list[float] = []
    blocks = [([x * x for x in d], [x * x for x in e], 0.0)]
    while blocks:
        q, e, sigma = blocks.pop()
        turned = 0
        while q:
            if len(q) == 1:
                found.append(sigma + q[0])
                break
            if e[-1] <= EPS * EPS * (sigma + q[-1]):
                found.append(sigma + q.pop())
                e.pop()
                continue
            cut = next((i for i in range(len(e)) if e[i] <= EPS * EPS * (sigma + min(q[i], q[i + 1]))), None)
            if cut is not None:
                blocks.append((q[:cut + 1], e[:cut], sigma))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if q[0] * 1.5 < q[-1] and turned < 8:   # the small end goes last
                q, e, turned = q[::-1], e[::-1], turned + 1
            shift = _shift(q, e)
            for attempt in range(5):
                done = _transform(q, e, shift if attempt < 4 else 0.0)
                if done is not None:
                    break
                shift = shift / 2 if attempt < 2 else shift / 16
            else:
                raise ArithmeticError("dqds without shift lost positivity")
            sigma += shift if attempt < 4 else 0.0
            q, e = done
    return sorted(found, reverse=True)


def _shift(q: list[float], e: list[float]) -> float:
    """A little less than the smaller eigenvalue of the last two rows of ``L L^T``."""
    a, b, c = q[-2] + e[-1], q[-1], e[-1] * q[-1]
    before = e[-2] if len(e) > 1 else 0.0
    mean, half = (a + b) / 2, (a - b) / 2
    root = (half * half + c) ** 0.5
    low = (a * b - c) / (mean + root) if mean + root else 0.0
    return max(0.0, low - (before * low) ** 0.5) * (1 - 1e-10) if low > before else low * 0.25


def _transform(q: list[float], e: list[float], shift: float):
    """One differential qd step with shift; None if a value would get negative."""
    new_q, new_e = [], []
    d = q[0] - shift
    for i in range(len(e)):
        if d < 0:
            return None
        top = d + e[i]
        new_q.append(top)
        if top == 0.0:
            if shift:
                return None
            new_e.append(0.0)
            d = q[i + 1]
            continue
        ratio = q[i + 1] / top
        new_e.append(e[i] * ratio)
        d = d * ratio - shift
    if d < 0 or d != d:
        return None
    new_q.append(d)
    return new_q, new_e


def _twisted(d: np.ndarray, e: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """Vector z with ``(B^T B - value) z = gamma e_k`` at the twist k where gamma is least,
    by a stationary transform from the top and a progressive one from the bottom."""
    n = len(d)
    q, low = d * d, e / d[:-1]           # B^T B = L D L^T, D = q, L below its diagonal = low
    tiny = np.finfo(float).tiny ** 0.5
    s, p = np.empty(n), np.empty(n)
    left, right = np.empty(n - 1), np.empty(n - 1)
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + q[i]
        pivot = pivot if abs(pivot) > tiny else tiny
        left[i] = q[i] * low[i] / pivot
        s[i + 1] = left[i] * low[i] * s[i] - value
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = q[i] * low[i] * low[i] + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else tiny
        ratio = q[i] / pivot
        right[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - value
    gamma = s + p + value
    k = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -left[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -right[i] * z[i]
    return z, gamma[k]


def _unreduced(d: np.ndarray, e: np.ndarray, sigma2: list[float]) -> tuple[list[float], np.ndarray]:
    """Squared singular values and right singular vectors of a bidiagonal whose
    superdiagonal has no zeros."""
    n, vectors, values = len(d), [], []
    rng = np.random.default_rng(0)
    for value in sigma2:
        z, gamma = _twisted(d, e, value)
        size = np.linalg.norm(z)
        z, step = z / size, gamma / (size * size)
        if 4 * EPS * value < abs(step) < CLOSE * CLOSE * value:   # one Rayleigh step
            again, _ = _twisted(d, e, value + step)
            if np.all(np.isfinite(again)):
                value, z = value + step, again / np.linalg.norm(again)
        near = [v for v, x in zip(vectors, values) if abs(x - value) <= CLOSE * max(x, value)]
        rest = _apart(z, near)
        for _ in range(8):
            if np.linalg.norm(rest) > 1e-3:
                break
            # Parallel to one found: inverse iteration from a random start inside the cluster's space.
            rest = rng.standard_normal(n)
            b = np.diag(d) + np.diag(e, 1)
            shifted = b.T @ b - np.diag(np.full(n, value * (1 + 4 * EPS * rng.standard_normal())) + np.finfo(float).tiny)
            for _ in range(3):
                rest = _apart(np.linalg.lstsq(shifted, rest, rcond=0)[0], near)
                rest /= np.linalg.norm(rest)
        vectors.append(rest / np.linalg.norm(rest))
        values.append(value)
    return values, np.array(vectors).T


def _apart(z: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """z without its parts along the vectors found, taken off twice."""
    for _ in range(2):
        for v in found:
            z = z - (v @ z) * v
    return z


def eigen(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values, falling, and right singular vectors (columns) of a triangle."""
    m = r.shape[1]
    square = np.zeros((m, m))
    square[:len(r)] = r[:m]
    unit = np.abs(square).max(initial=0.0)
    if unit == 0.0:
        return np.zeros(m), np.eye(m)
    d, e, v = bidiagonal(square / unit)
    d = np.where(np.abs(d) < 1e-140, 1e-140, d)
    e = np.where(np.abs(e) <= EPS, 0.0, e)      # less than the reflections' own rounding
    values, vectors = [], np.zeros((m, m))
    edges = [0, *[i + 1 for i in range(m - 1) if e[i] == 0.0], m]
    for a, b in zip(edges, edges[1:]):
        if b - a == 1:
            found, z = [d[a] ** 2], np.ones((1, 1))
        else:
            found, z = _unreduced(d[a:b], e[a:b - 1], dqds(list(d[a:b]), list(e[a:b - 1])))
        vectors[a:b, len(values):len(values) + b - a] = z
        values += found
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order] * unit * unit, v @ vectors[:, order]


# ---- the Spark side

@dataclass(frozen=True)
class Fit:
    """n, the sums of x, and per component (falling eigenvalue) the eigenvalue and its
    unit direction, as a (components, dim) matrix; ``trace`` of the covariance."""
    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    directions: np.ndarray
    trace: float


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x`` (array of longs) of the rows that count, all of one length."""
    c = F.col(vector_col)
    fits = lambda v: F.abs(v.cast("double") * SCALE) < _LIMIT  # noqa: E731  (not so for NaN)
    whole = F.transform(c, lambda v: F.floor(F.when(fits(v), v.cast("double") * SCALE)) + F.lit(SHIFT).cast("long"))
    rows = vectors.filter(c.isNotNull() & (F.size(c) > 0)).filter(
        F.forall(c, lambda v: v.isNotNull() & fits(v)))
    sizes = rows.groupBy(F.size(c).alias("dim")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("dim")).head()
    rows = rows.filter(F.size(c) == (sizes["dim"] if sizes else 0))
    return rows.select(F.col(id_col).alias("vec_id"), whole.alias("x"))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - S/n: the whole part in integers, then the rest."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def _fold(rows: Iterator[np.ndarray], dim: int) -> np.ndarray:
    r = np.zeros((0, dim))
    for block in rows:
        r = householder_r(np.vstack([r, block]))
    return r


def _triangles(rows: DataFrame, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """R of all centred rows: one triangle a task, then ``FAN`` at a time."""
    dim = len(sums)
    schema = "part long, r array<double>"

    def blocks(batches):
        from pyspark import TaskContext

        def cut():
            for batch in batches:
                x = _matrix(batch.column("x"), dim)
                for i in range(0, len(x), BLOCK):
                    yield _centred(x[i:i + BLOCK], n, sums)

        r = _fold(cut(), dim)
        if len(r):
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "r": [r.ravel().tolist()]},
                                             schema=pa.schema([("part", pa.int64()), ("r", pa.list_(pa.float64()))]))

    def join(pdf):
        import pandas as pd

        r = _fold((np.asarray(x).reshape(-1, dim) for x in pdf.sort_values("part")["r"]), dim)
        return pd.DataFrame({"part": [int(pdf["part"].min()) // FAN], "r": [r.ravel().tolist()]})

    found = store(rows.select("x").mapInArrow(blocks, schema))
    while found.count() > 1:
        found = store(found.groupBy(F.floor(F.col("part") / FAN).alias("g")).applyInPandas(join, schema))
    return np.array(found.head()["r"]).reshape(-1, dim)


def fit(rows: DataFrame, components: int = 8) -> Fit | None:
    """Whitening of all ``usable`` rows; None without rows."""
    sums = rows.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(
        F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).orderBy("at").collect()
    if not sums:
        return None
    n, totals = sums[0]["n"], tuple(int(r["s"]) for r in sums)
    values, vectors = eigen(_triangles(rows, n, totals))
    keep = values > values[0] * (len(totals) * 16 * EPS) ** 2 if values[0] > 0 else values > 0
    k = min(components, int(keep.sum()))
    return Fit(n, totals, values[:k] / n, vectors[:, :k].T, float(values.sum() / n))


def _project(x: np.ndarray, model: Fit) -> np.ndarray:
    return _centred(x, model.n, model.sums) @ model.directions.T / np.sqrt(model.eigenvalues)


def _exact_deviation(x: np.ndarray, model: Fit) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, in integers; null beyond a long."""
    if max(int(np.abs(x).max(initial=0)) * model.n, max(abs(s) for s in model.sums)) < 2 ** 62:
        away = x * model.n - np.array(model.sums, dtype=np.int64)
        if int(np.abs(away).max(initial=0)) ** 2 * x.shape[1] < 2 ** 63:
            return (away * away).sum(axis=1).tolist()
    exact = [sum((int(v) * model.n - s) ** 2 for v, s in zip(row, model.sums)) for row in x]
    return [v if v < 2 ** 63 else None for v in exact]


def identity_error(rows: DataFrame, model: Fit) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity. Tasks
    give counts, means and centred products, which are merged pair by pair."""
    k = len(model.eigenvalues)

    def moments(batches):
        n, mean, product = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = _project(_matrix(batch.column("x"), len(model.sums)), model)
            if len(w):
                n, mean, product = _merge((n, mean, product), (len(w), w.mean(axis=0), (w - w.mean(axis=0)).T @ (w - w.mean(axis=0))))
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "mean": [mean.tolist()], "product": [product.ravel().tolist()]})

    schema = "n long, mean array<double>, product array<double>"
    parts = rows.select("x").mapInArrow(moments, schema)
    # Sums over tasks: of n, n mean, and product + n mean mean^T, about means that are near zero.
    at = parts.select("n", F.posexplode("product").alias("at", "p"), "mean").select(
        "at", "n", (F.col("p") + F.col("n") * F.get("mean", F.expr(f"at div {k}")) * F.get("mean", F.expr(f"at % {k}"))).alias("p"),
        F.when(F.col("at") < k, F.col("n") * F.get("mean", F.col("at"))).alias("m"))
    sums = at.groupBy("at").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum("m").alias("m")).orderBy("at").collect()
    mean = np.array([r["m"] / r["n"] for r in sums[:k]])
    covariance = np.array([r["p"] / r["n"] for r in sums]).reshape(k, k) - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max())


def _merge(a, b):
    (n, mean, product), (m, other, more) = a, b
    gap = other - mean
    return n + m, mean + gap * (m / (n + m)), product + more + np.outer(gap, gap) * (n * m / (n + m))


def whiten(rows: DataFrame, model: Fit | None) -> DataFrame:
    """Per row and component ``vec_id, component, n, deviation, whitened, explained``."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double"
    if model is None or not len(model.eigenvalues):
        return rows.sparkSession.createDataFrame([], schema)
    k = len(model.eigenvalues)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), len(model.sums))
            if not len(x):
                continue
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k)))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, model.n)),
                pa.array(_exact_deviation(x, model), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                pa.array(_project(x, model).ravel()), pa.array(np.tile(model.eigenvalues / model.trace, len(x)))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return rows.mapInArrow(run, schema)
