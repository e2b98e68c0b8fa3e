"""Whitening of embeddings by the leading eigenvectors of their covariance, found by a block Jacobi-Davidson method.

The covariance is never formed: a job multiplies it with a few vectors, summing C'(C q) over blocks C of centred rows. The basis,
dimensions by a few dozen, lives on the driver. A round takes the Ritz vectors of the basis, locks those whose residual is down to
rounding, and adds for the others corrections that a few steps of MINRES on the projected equation give, all at once.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Values of a block of rows: 2 MB.
BLOCK_VALUES = 1 << 18
#: x = floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Entries of this size or more have no exact x; their vectors are dropped like those with infinite ones.
TOO_LARGE = float(1 << 46)
#: A residual counts as rounding below this many units in the last place of the largest eigenvalue.
ULPS = 64.0
#: Eigenvalues below this share of the largest belong to directions without spread.
FLAT = 1e-12


@dataclass(frozen=True)
class Whitening:
    """The fit: number and dimension of the vectors, their exact sums, and components as columns with their eigenvalues."""

    n: int
    dim: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray

    def offsets(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whole numbers y and r with n x - S = n y - r and 0 <= r < n."""
        return x - np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        y, r = self.offsets(x)
        return y - r / self.n

    def deviations(self, x: np.ndarray) -> list[decimal.Decimal]:
        """The exact sum of (n x - S)^2 of each row."""
        y, r = self.offsets(x)
        most = int(np.abs(y).max(initial=0)) + 1
        if max(most, self.n) * most * self.dim >= 1 << 62:
            y, r = y.astype(object), r.astype(object)
        squares, mixed, rest = (y * y).sum(axis=1).tolist(), (y @ r).tolist(), sum(v * v for v in r.tolist())
        return [decimal.Decimal(self.n * (self.n * a - 2 * b) + rest) for a, b in zip(squares, mixed, strict=True)]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def _blocks(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """Blocks of usable vectors: ids, dim, and x as bytes of 64-bit integers, the values of one vector after another."""
    usable = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < TOO_LARGE))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, ids = batch.column("v"), batch.column("id")
            size, values = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
            x, starts = np.floor(values * SCALE).astype(np.int64) + OFFSET, np.cumsum(size) - size
            for dim in np.unique(size).tolist():
                of, step = np.flatnonzero(size == dim), max(1, BLOCK_VALUES // dim)
                for a in range(0, len(of), step):
                    some = of[a : a + step]
                    named = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), ids.take(pa.array(some)))
                    data = x[starts[some][:, None] + np.arange(dim)].tobytes()
                    yield pa.RecordBatch.from_arrays([named, pa.array([dim], pa.int64()), pa.array([data], pa.binary())], ["ids", "dim", "x"])

    packed = rows.where(usable).select(F.col(vec_id).cast("long").alias("id"), F.transform(vector, lambda v: v.cast("double")).alias("v"))
    return materialise(packed.mapInArrow(pack, "ids array<long>, dim long, x binary"))


def _summed(blocks: DataFrame, dim: int, part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum of ``part(x)`` over all blocks: a task sums its own, the shuffle those of the tasks, place by place."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column("x"):
                got = part(np.frombuffer(data.as_buffer(), np.int64).reshape(-1, dim))
                total = got if total is None else total + got
        if total is not None:
            width = total.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size) // width), pa.array(np.arange(total.size) % width), pa.array(total.ravel())], ["row", "at", "v"])

    # As many rows as the result has places: dimensions by columns of a block.
    cells = blocks.select("x").mapInArrow(add, f"row long, at long, v {kind}").groupBy("row", "at").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((int(cells["row"].max()) + 1, int(cells["at"].max()) + 1), np.int64 if kind == "long" else float)
    out[cells["row"], cells["at"]] = cells["v"]
    return out


def _halves(x: np.ndarray) -> np.ndarray:
    """Sums of the low 26 bits and of the rest, so that no sum leaves 64 bits."""
    return np.stack([(x & ((1 << 26) - 1)).sum(axis=0), (x >> 26).sum(axis=0)])


def orthonormal(t: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The directions of ``t`` outside ``basis``, made orthonormal; those that depend on the others go."""
    t = t / np.maximum(np.linalg.norm(t, axis=0), 1e-300)
    for _ in range(2):
        t = t - basis @ (basis.T @ t)
    u, s, _ = np.linalg.svd(t, full_matrices=False)
    t = u[:, s > 1e-8] if len(s) else t
    t = t - basis @ (basis.T @ t)
    return np.linalg.qr(t)[0]


def minres(apply, b: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of (P(A - theta)P) t = b for each column: the least residual in a Krylov space of ``steps`` products.

    ``apply`` multiplies all columns at once, so a step is one job. The Lanczos recurrence with Givens rotations, columns apart.
    """
    k = b.shape[1]
    beta = np.linalg.norm(b, axis=0)
    live = beta > 0
    v_old, v = np.zeros_like(b), b / np.where(live, beta, 1)
    w_old, w, t = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    eta, c_old, c, s_old, s, beta_now = beta.copy(), np.ones(k), np.ones(k), np.zeros(k), np.zeros(k), np.zeros(k)
    for _ in range(steps):
        p = apply(v)
        alpha = np.einsum("ij,ij->j", v, p)
        p = p - alpha * v - beta_now * v_old
        beta_next = np.linalg.norm(p, axis=0)
        low = c * alpha - c_old * s * beta_now
        r1 = np.hypot(low, beta_next)
        r2 = s * alpha + c_old * c * beta_now
        r3 = s_old * beta_now
        live = live & (r1 > 0)
        safe = np.where(live, r1, 1)
        c_old, c, s_old, s = c, np.where(live, low / safe, 1), s, np.where(live, beta_next / safe, 0)
        w_old, w = w, np.where(live, (v - r3 * w_old - r2 * w) / safe, 0)
        t = t + np.where(live, c * eta, 0) * w
        eta = -s * eta
        v_old, v = v, p / np.where(beta_next > 0, beta_next, 1)
        beta_now = beta_next
    return t


def jacobi_davidson(apply: Callable[[np.ndarray], np.ndarray], dim: int, want: int, inner: int = 4, most: int = 160, rounds: int = 60, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` largest eigenvalues of a symmetric matrix that ``apply`` multiplies, and their vectors as columns.

    Ritz vectors are locked when their residual is within ULPS units in the last place of the largest eigenvalue. Locked ones
    take no more corrections; they stay in the basis, and the equations of the others are projected onto the complement of
    all. Where the basis has become the whole space, products of the Ritz vectors themselves take away what rounding left.
    Residuals that stop falling above the limit are taken if they are rounding's (1e-12 of the largest eigenvalue); others raise.
    """
    want = min(want, dim)
    guard = min(dim, want + 4)  # a few more, so that none of the largest is missed
    most = max(most, 3 * guard)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, guard)))[0]
    image = apply(basis)
    best, stalled = np.inf, 0
    for _ in range(rounds):
        small = basis.T @ image
        theta, y = np.linalg.eigh((small + small.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        ritz = basis @ y[:, :guard]
        residual = image @ y[:, :guard] - ritz * theta[:guard]
        norm, scale = np.linalg.norm(residual, axis=0), max(abs(theta[0]), abs(theta[-1]))
        unlocked = np.flatnonzero(norm > ULPS * np.finfo(float).eps * scale)
        worst = norm[:want].max()
        stalled = stalled + 1 if worst > best / 2 else 0
        best = min(best, worst)
        if not (unlocked < want).any() or (stalled > 2 and worst <= 1e-12 * scale):
            return theta[:want], ritz[:, :want]
        if basis.shape[1] == dim:
            basis = np.linalg.qr(basis @ y)[0]
            image = apply(basis)
            continue
        if basis.shape[1] + len(unlocked) > most and dim > most:
            basis, image = basis @ y[:, : 2 * guard], image @ y[:, : 2 * guard]
        shift = theta[unlocked]
        new = orthonormal(_corrections(apply, ritz, shift, residual[:, unlocked], inner), basis)[:, : dim - basis.shape[1]]
        basis, image = np.hstack([basis, new]), np.hstack([image, apply(new)])
    raise ArithmeticError(f"no convergence in {rounds} rounds: a residual of {best} is left")


def _corrections(apply: Callable[[np.ndarray], np.ndarray], ritz: np.ndarray, shift: np.ndarray, residual: np.ndarray, steps: int) -> np.ndarray:
    """Solves (I - U U')(A - theta I)(I - U U') t = -r for all residuals at once, roughly."""

    def away(t: np.ndarray) -> np.ndarray:
        return t - ritz @ (ritz.T @ t)

    def projected(t: np.ndarray) -> np.ndarray:
        t = away(t)
        return away(apply(t) - shift * t)

    return away(minres(projected, -away(residual), steps))


def fit_whitening(blocks: DataFrame, components: int = 32, inner: int = 4) -> Whitening | None:
    """The leading components of the covariance of all vectors in ``blocks``; None without vectors.

    Vectors of another length than most (at a tie, than the longer) are left out. Directions without spread are no components.
    """
    sizes = blocks.groupBy("dim").agg(F.sum(F.size("ids")).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if sizes is None:
        return None
    dim, n = int(sizes["dim"]), int(sizes["n"])
    blocks = blocks.where(F.col("dim") == dim)
    low, high = _summed(blocks, dim, _halves, "long").tolist()
    mean = Whitening(n, dim, tuple(a + (b << 26) for a, b in zip(low, high, strict=True)), np.zeros(0), np.zeros((dim, 0)))

    def apply(q: np.ndarray) -> np.ndarray:
        def product(x: np.ndarray) -> np.ndarray:
            c = mean.centred(x)
            return c.T @ (c @ q)

        return _summed(blocks, dim, product) / n

    values, vectors = jacobi_davidson(apply, dim, components, inner)
    some = values > FLAT * max(float(values[0]), 0.0)
    return Whitening(n, dim, mean.sums, values[some], vectors[:, some])


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 32, inner: int = 4) -> DataFrame:
    """Whitened vectors: vec_id, n, deviation (decimal), whitened (array), explained (array), identity_error.

    The entries c of a vector become x = floor(64 c) + 1,000,000. whitened holds the centred x along each component, over the
    root of its eigenvalue; explained holds eigenvalues as shares of the trace, both from the largest on, at most ``components``
    (fewer if the vectors spread in fewer directions). deviation is the exact sum of (n x - S)^2. identity_error is the largest
    entry of the whitened vectors' covariance minus the identity, over all vectors.

    Rows are left out whose vector is null or empty, holds a null, an infinity, NaN, or an entry of 2^46 or more, or has another
    length than most (at a tie, than the longer). A null vec_id stays null; repeated rows count and come back one by one. Without
    usable vectors the result is empty, and with equal vectors only the arrays are. Columns that aren't named are left out.
    """
    blocks = _blocks(rows, vec_id, vector)
    fit = fit_whitening(blocks, components, inner)
    if fit is None:
        fit = Whitening(0, 0, (), np.zeros(0), np.zeros((0, 0)))
    blocks, k = blocks.where(F.col("dim") == fit.dim), len(fit.values)
    error, explained = None, []
    if k:

        def moments(x: np.ndarray) -> np.ndarray:
            w, c = fit.whitened(x), fit.centred(x)
            return np.vstack([w.T @ w, w.sum(axis=0), np.full(k, np.einsum("ij,ij->", c, c))])

        got = _summed(blocks, fit.dim, moments) / fit.n
        error = float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())
        explained = (fit.values / got[k + 1, 0]).tolist()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data in zip(batch.column("ids"), batch.column("x"), strict=True):
                x = np.frombuffer(data.as_buffer(), np.int64).reshape(-1, fit.dim)
                whitened = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(fit.whitened(x).ravel()))
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(fit.deviations(x), pa.decimal128(38, 0)), whitened], ["vec_id", "deviation", "whitened"])

    out = blocks.select("ids", "x").mapInArrow(project, "vec_id long, deviation decimal(38,0), whitened array<double>")
    shares = F.array(*[F.lit(e) for e in explained]).cast("array<double>")
    return out.select("vec_id", F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
