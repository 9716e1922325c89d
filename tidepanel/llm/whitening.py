"""Principal components and whitened coordinates by distributed Golub-Kahan-Lanczos bidiagonalisation.

Vectors are put on the integer grid ``floor(256 * c)``, where counts and sums are exact. The fit list X (each distinct
grid vector once, centred) lies in blocks of rows in the shared folder. Step j takes v, forms u = Xv - beta * u' and Xᵀu in
one pass over the blocks, with the inner products of u and all earlier u's, takes the rest of them out of u and Xᵀu, and
makes the next v orthogonal to all earlier ones twice. A left vector is as long as the table, but each is X times a short
vector w, so w is what is kept; a block makes its piece of every u anew. After as many steps as there are dimensions,
X V = U B holds with a small bidiagonal B, whose singular value decomposition gives components and deviations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidepanel.llm.storage import Scratch

GRID = 256
COMPONENTS = 4
BLOCK_ROWS = 4096
_EXACT = 2.0 ** 53
_HALF = 1 << 20


def grid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec, x, dim) of the rows that remain: x is the vector on the grid, as longs."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec"), F.col(vector_col).cast("array<double>").alias("c"))
    fine = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * GRID) < _EXACT))
    kept = rows.where(F.col("c").isNotNull() & (F.size("c") > 0) & fine)
    return kept.select("vec", F.transform("c", lambda c: F.floor(c * GRID).cast("long")).alias("x")).withColumn("dim", F.size("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


_BLOCK = pa.schema([("dim", pa.int32()), ("rows", pa.int32()), ("x", pa.binary())])


def _blocks(block_rows: int):
    """Rows of one dimension, packed; partitions are sorted by dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, dim, n = [], None, 0

        def block() -> pa.RecordBatch:
            x = np.concatenate(held)
            return pa.RecordBatch.from_pylist([{"dim": dim, "rows": len(x), "x": x.astype("<i8").tobytes()}], schema=_BLOCK)

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for a, b in _spans(dims):
                if held and (dims[a] != dim or n >= block_rows):
                    yield block()
                    held, n = [], 0
                dim = int(dims[a])
                held.append(_matrix(batch.column("x").slice(a, b - a), dim))
                n += b - a
        if held:
            yield block()
    return run


def _spans(keys: np.ndarray) -> list[tuple[int, int]]:
    edge = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return [(a, b) for a, b in zip(edge, edge[1:]) if a < b]


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for row in batch.to_pylist():
            yield np.frombuffer(row["x"], "<i8").reshape(row["rows"], row["dim"])


def _exact_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sums and sums of squares per dimension of a task, as decimal text: no size of table rounds them."""
    n, sums, squares = 0, 0, 0
    for x in _each_block(batches):
        n += len(x)
        high, low = x // _HALF, x % _HALF  # their sums over a block fit 64 bits
        big = bool(len(x)) and int(np.abs(x).max()) >= 1 << 25
        parts = x.astype(object) if big else x
        sums = sums + high.sum(axis=0).astype(object) * _HALF + low.sum(axis=0).astype(object)
        squares = squares + (parts * parts).sum(axis=0).astype(object)
    if n:
        yield pa.RecordBatch.from_pydict({
            "k": pa.array([-1, *range(len(sums))], pa.int32()), "a": pa.array([str(n), *map(str, sums)]),
            "b": pa.array(["0", *map(str, squares)])})


def _added(df: DataFrame, run, schema: str, total) -> list:
    """What the tasks give, added up by position: as many rows come to the driver as there are positions."""
    parts = df.mapInArrow(run, schema)
    return parts.groupBy("k").agg(*[total(c).alias(c) for c in parts.columns if c != "k"]).orderBy("k").collect()


@dataclass
class Fit:
    """Counts and sums of the fit list, and its components (rows of ``axes``) with their variances."""

    dim: int
    n: int
    sums: list[int]
    trace: float
    axes: np.ndarray
    variances: np.ndarray
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _centred(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return x.astype(np.float64) - mean


def _step(mean: np.ndarray, w: np.ndarray, lefts: np.ndarray):
    """Of u = Xw: Xᵀu, the inner products with the earlier left vectors X·lefts, and |u|²."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(len(mean) + lefts.shape[1] + 1), False
        for x in _each_block(batches):
            c, seen = _centred(x, mean), True
            u = c @ w
            total += np.concatenate([u @ c, u @ (c @ lefts), [u @ u]])
        if seen:
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(len(total), dtype=np.int32)), "a": pa.array(total)})
    return run


def _orthogonal(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = v - basis.T @ (basis @ v)
    return v


def bidiagonalise(blocks: DataFrame, mean: np.ndarray, scale: float, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(V, B) after all steps: the right vectors as rows, and the upper bidiagonal matrix. ``scale`` is the norm of X.

    A step whose left or next right vector vanishes has found an invariant space; it goes on with a random direction
    outside of it, so repeated and zero singular values are found as well.
    """
    dim, random = len(mean), np.random.default_rng(seed)
    tiny = scale * 1e-13 * max(dim, 8)
    basis, b = np.zeros((0, dim)), np.zeros((dim, dim))
    lefts, products = np.zeros((dim, 0)), np.zeros((dim, 0))  # w of each left vector, and Xᵀu of it
    columns: list[int] = []  # the step that each left vector belongs to
    v, beta = _unit(random.standard_normal(dim)), 0.0
    for j in range(dim):
        basis = np.vstack([basis, v])
        joined = bool(beta) and bool(columns) and columns[-1] == j - 1
        w = v - beta * lefts[:, -1] if joined else v
        got = np.array([r["a"] for r in _added(blocks, _step(mean, w, lefts), "k int, a double", F.sum)])
        product, rest, norm2 = got[:dim], got[dim:-1], got[-1]
        w, product = w - lefts @ rest, product - products @ rest
        alpha = float(np.sqrt(max(norm2 - rest @ rest, 0.0)))
        if joined:
            b[j - 1, j] = beta
        after = np.zeros(dim)
        if alpha > tiny:
            b[j, j] = alpha
            lefts, products = np.column_stack([lefts, w / alpha]), np.column_stack([products, product / alpha])
            columns.append(j)
            after = _orthogonal(product / alpha - alpha * v, basis)
        beta = float(np.linalg.norm(after))
        if beta > tiny:
            v = after / beta
        elif j + 1 < dim:
            beta, v = 0.0, _unit(_orthogonal(random.standard_normal(dim), basis))
    return basis, b


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v)


def _covariance_of(mean: np.ndarray, project: np.ndarray):
    """Sums of products of the whitened coordinates of the fit list, and of the coordinates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = project.shape[1]
        total, seen = np.zeros(k * k + k), False
        for x in _each_block(batches):
            y, seen = _centred(x, mean) @ project, True
            total += np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])
        if seen:
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(len(total), dtype=np.int32)), "a": pa.array(total)})
    return run


def fit_components(blocks: DataFrame, dim: int, components: int = COMPONENTS) -> Fit | None:
    """The components of one fit list, or None if it has no rows."""
    rows = _added(blocks, _exact_sums, "k int, a string, b string", lambda c: F.sum(F.col(c).cast("decimal(38,0)")))
    if not rows:
        return None
    n, sums, squares = int(rows[0]["a"]), [int(r["a"]) for r in rows[1:]], [int(r["b"]) for r in rows[1:]]
    spread = sum(n * q - s * s for q, s in zip(squares, sums))  # n * n times the trace
    fit = Fit(dim, n, sums, spread / (n * n), np.zeros((0, dim)), np.zeros(0))
    if not spread:
        return fit
    basis, b = bidiagonalise(blocks, fit.mean, float(np.sqrt(spread / n)))
    _, deviations, rights = np.linalg.svd(b)
    variances = deviations ** 2 / n
    # A variance that is rounding only has no direction.
    some = np.flatnonzero(deviations > deviations[0] * 1e-12 * dim)[:components]
    axes = rights[some] @ basis
    fit.axes, fit.variances = axes / np.linalg.norm(axes, axis=1, keepdims=True), variances[some]
    project = (fit.axes / np.sqrt(fit.variances)[:, None]).T
    got = np.array([r["a"] for r in _added(blocks, _covariance_of(fit.mean, project), "k int, a double", F.sum)])
    k = len(some)
    means = got[k * k:] / n
    covariance = got[:k * k].reshape(k, k) / n - np.outer(means, means)
    fit.identity_error = float(np.abs(covariance - np.eye(k)).max())
    return fit


_OUT = ("vec long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def _whiten(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits = {f.dim: f for f in shared.value}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for a, b in _spans(dims):
                fit = fits[int(dims[a])]
                k, rows = len(fit.variances), b - a
                x = _matrix(batch.column("x").slice(a, rows), fit.dim)
                whitened = _centred(x, fit.mean) @ (fit.axes / np.sqrt(fit.variances)[:, None]).T
                yield pa.RecordBatch.from_pydict({
                    "vec": pa.array(batch.column("vec").slice(a, rows).to_pylist(), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    "n": pa.array(np.full(rows * k, fit.n, np.int64)),
                    "deviation": _deviations(x, fit).take(pa.array(np.repeat(np.arange(rows), k))),
                    "whitened": pa.array(whitened.ravel()),
                    "explained": pa.array(np.tile(fit.variances / fit.trace, rows)),
                    "identity_error": pa.array(np.full(rows * k, fit.identity_error))})
    return run


def _deviations(x: np.ndarray, fit: Fit) -> pa.Array:
    """Sum of (n * x - S)² of each row, exact; null where 64 bits can't hold it."""
    most = max(int(np.abs(x).max(initial=0)) * fit.n + max(map(abs, fit.sums)), 1)
    if most * most * fit.dim < 1 << 62:
        d = x * fit.n - np.array(fit.sums, np.int64)
        return pa.array((d * d).sum(axis=1))
    d = x.astype(object) * fit.n - np.array(fit.sums, object)
    return pa.array([int(s) if s < 1 << 63 else None for s in (d * d).sum(axis=1)], pa.int64())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per row and component: its whitened coordinate, its exact deviation, and how well the fit did.

    Rows whose vector is null, empty, holds null or non-finite entries, or entries of 2**45 or more, are dropped; all others are
    returned, also repeated ones and those without an id (with a null one). Vectors of each length are a fit of their
    own. Equal grid vectors count once in the fit and each get their rows. There are fewer components where fewer have a
    variance; a fit of one distinct vector has none, so its rows do not appear. An empty table gives an empty result.
    Other columns are ignored. Components with the same variance are some orthogonal basis of their space, the same for
    all rows. The driver holds a few matrices of dim x dim; each fit takes dim + 2 passes over its blocks.
    """
    scratch = Scratch(vectors.sparkSession, "whitening")
    rows = grid_vectors(vectors, id_col, vector_col)
    distinct = rows.select("dim", "x").distinct().sortWithinPartitions("dim")
    blocks = scratch.store(distinct.mapInArrow(_blocks(block_rows), "dim int, rows int, x binary"), "blocks")
    dims = [r["dim"] for r in blocks.select("dim").distinct().orderBy("dim").collect()]
    fits = [fit_components(blocks.where(F.col("dim") == d), d, components) for d in dims]
    shared = vectors.sparkSession.sparkContext.broadcast(fits)
    return rows.mapInArrow(_whiten(shared), _OUT).withColumnRenamed("vec", id_col)
