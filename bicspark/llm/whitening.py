"""Whitening of vectors by incremental eigendecomposition.

Each task keeps the spectrum of its vectors' scatter and takes in one centred vector at a
time: in the basis of the present eigenvectors the scatter changes from a diagonal matrix
by a rank-one term, whose eigenvalues are the roots of a secular equation. Directions that
the new vector doesn't move, and equal eigenvalues, are deflated. Spectra of tasks are
combined by as many rank-one updates as they have eigenvalues, and one for the distance of
their means, over a tree of tasks. The basis found that way is refined once: one more
distributed pass projects every vector on it, and the eigenvectors of that small, nearly
diagonal covariance (Rayleigh-Ritz) are those of the whole to double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bicspark.plans.stages import Stages

#: So many spectra grow side by side in a task, and are joined at its end.
LANES = 16
#: So many spectra are combined by a task of the tree.
FAN_IN = 8
#: Eigenvalues and moves below this share of the largest are equal, or none.
TINY = 1e-15
#: Where a secular equation counts as solved; eigenvectors are exact for the roots found.
CLOSE = 1e-11
#: Eigenvalues below this share of the trace are no variance.
NO_VARIANCE = 1e-12


# --- spectra in a task -----------------------------------------------------------------


class Spectra:
    """Several spectra side by side, so that one numpy call serves all of them.

    Spectrum k is of ``n[k]`` vectors with a mean; their scatter is
    ``basis[k] @ diag(values[k]) @ basis[k].T``, with rising values.
    """

    def __init__(self, n: np.ndarray, mean: np.ndarray, values: np.ndarray, basis: np.ndarray):
        self.n, self.mean, self.values, self.basis = n, mean, values, basis

    @classmethod
    def empty(cls, lanes: int, width: int) -> Spectra:
        return cls(np.zeros(lanes), np.zeros((lanes, width)), np.zeros((lanes, width)), np.tile(np.eye(width), (lanes, 1, 1)))

    def __getitem__(self, part: slice) -> Spectra:
        return Spectra(self.n[part].copy(), self.mean[part].copy(), self.values[part].copy(), self.basis[part].copy())

    def add(self, vectors: np.ndarray) -> None:
        """One more vector for each of the first spectra: a term along its distance from the mean."""
        k = len(vectors)
        apart = vectors - self.mean[:k]
        self.n[:k] += 1
        self.update(apart, (self.n[:k] - 1) / self.n[:k])
        self.mean[:k] += apart / self.n[:k, None]

    def join(self, other: Spectra) -> None:
        """All vectors of other spectra: one term per eigenvalue, one for the means."""
        k = len(other.n)
        for j in range(self.values.shape[1]):
            self.update(other.basis[:, :, j], np.maximum(other.values[:, j], 0))
        apart = other.mean - self.mean[:k]
        n = np.maximum(self.n[:k] + other.n, 1)
        self.update(apart, self.n[:k] * other.n / n)
        self.mean[:k] += apart * (other.n / n)[:, None]
        self.n[:k] += other.n

    def joined(self) -> Spectra:
        """All spectra in one: halves are joined until one is left."""
        left = self
        while len(left.n) > 1:
            half = -(-len(left.n) // 2)
            left, rest = left[:half], left[half:]
            left.join(rest)
        return left

    def update(self, direction: np.ndarray, weight: np.ndarray) -> None:
        """Add ``weight * outer(direction, direction)`` to the scatter of the first spectra."""
        k = len(weight)
        values, basis = self.values[:k], self.basis[:k]
        z = np.matmul(direction[:, None, :], basis)[:, 0]
        scale = TINY * np.maximum(values[:, -1], weight * (z * z).sum(axis=1))
        moved = weight[:, None] * z * z > (scale * TINY)[:, None]
        plain = moved.all(axis=1) & (np.diff(values, axis=1) > scale[:, None]).all(axis=1)
        for j in np.flatnonzero(~plain & (weight > 0) & (scale > 0)):
            values[j], basis[j] = _deflated(values[j], basis[j], z[j], weight[j], scale[j])
        if plain.all():
            values[:], turn = secular(values, z, weight)
            basis[:] = basis @ turn
        elif plain.any():
            values[plain], turn = secular(values[plain], z[plain], weight[plain])
            basis[plain] = basis[plain] @ turn


def _deflated(values: np.ndarray, basis: np.ndarray, z: np.ndarray, weight: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """One update in which some directions stay, or some eigenvalues are equal.

    Within each run of equal eigenvalues the basis is turned until one direction moves.
    Then only directions that move enter the secular equation.
    """
    values, basis, z = values.copy(), basis.copy(), z.copy()
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(values) > tolerance, [True]]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        length = np.linalg.norm(z[a:b])
        if b - a < 2 or length == 0:
            continue
        # The reflection that takes this part of z to the last direction of the run.
        mirror = z[a:b].copy()
        mirror[-1] += np.copysign(length, mirror[-1])
        mirror /= np.linalg.norm(mirror)
        basis[:, a:b] -= 2 * np.outer(basis[:, a:b] @ mirror, mirror)
        z[a:b] = 0
        z[b - 1] = -np.copysign(length, mirror[-1])
        values[a:b] = values[a:b].mean()
    moved = np.flatnonzero(weight * z * z > tolerance * TINY)
    if len(moved):
        roots, turn = secular(values[None, moved], z[None, moved], np.array([weight]))
        values[moved] = roots[0]
        basis[:, moved] = basis[:, moved] @ turn[0]
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


def secular(poles: np.ndarray, z: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of each ``diag(poles) + weight * outer(z, z)``.

    Poles rise strictly, no z is 0. Each root lies between its pole and the next, and is
    kept as a distance from the nearer one, so that close roots stay exact. The steps fit
    a rational function through value and slope on both sides; one that leaves the bracket
    is replaced by halving it. The vector z is then computed anew from the roots, for
    which these are the exact eigenvalues, so eigenvectors are orthogonal.
    """
    n = poles.shape[1]
    squares = weight[:, None] * z * z
    if n == 1:
        return poles + squares, np.ones((len(poles), 1, 1))
    last = np.arange(n) == n - 1
    above = np.concatenate([poles[:, 1:], poles[:, -1:] + squares.sum(axis=1, keepdims=True)], axis=1)
    gaps = above - poles
    terms = squares[:, None, :] / (poles[:, None, :] - (poles + gaps / 2)[:, :, None])
    at_middle = 1 + terms.sum(axis=2)
    left = (at_middle >= 0) | last  # the root lies in the left half, or is the last one
    origin = np.where(left, poles, above)
    # distances[j, i] = poles[i] - origin[j], exactly 0 at the nearer pole
    distances = poles[:, None, :] - origin[:, :, None]
    low = np.where(left, 0.0, -gaps / 2)
    high = np.where(left, np.where(last, gaps, gaps / 2), 0.0)
    # The first guess keeps the two poles next to a root, and the others as they are at the middle.
    next_squares = np.where(last, 0.0, np.roll(squares, -1, axis=1))
    rest = at_middle - squares / (-gaps / 2) - next_squares / (gaps / 2)
    offset = _rational(rest, squares, next_squares, poles - origin, np.where(last, np.inf, above - origin))
    offset = np.where((offset > low) & (offset < high), offset, (low + high) / 2)
    up_to_own = np.tri(n)
    next_column = np.minimum(np.arange(n) + 1, n - 1)
    for _ in range(60):
        apart = distances - offset[:, :, None]
        terms = squares[:, None, :] / apart
        f = 1 + terms.sum(axis=2)
        below = np.einsum("lij,ij->li", terms, up_to_own)
        high = np.where(f > 0, offset, high)
        low = np.where(f > 0, low, offset)
        found = (np.abs(f) <= CLOSE * (1 + 2 * np.abs(below) + np.abs(f))) | (high - low <= CLOSE * np.abs(offset))
        if found.all():
            break
        # c + s / (own - t) + S / (following - t), with the slopes of the poles on either side.
        terms /= apart
        below = np.einsum("lij,ij->li", terms, up_to_own)
        beyond = terms.sum(axis=2) - below
        own = np.diagonal(apart, axis1=1, axis2=2)
        to_next = np.where(last, 0.0, apart[:, np.arange(n), next_column])
        following = np.where(last, np.inf, to_next)
        trial = offset + _rational(f - below * own - beyond * to_next, below * own * own, beyond * to_next * to_next, own, following)
        inside = (trial > low) & (trial < high)
        offset = np.where(found, offset, np.where(inside, trial, (low + high) / 2))
    apart = distances - offset[:, :, None]  # poles[i] - root[j]
    roots = origin + offset
    # z from the roots: product over j of (root_j - pole_i) / (pole_j - pole_i), without j = i below.
    between = poles[:, None, :] - poles[:, :, None]  # [j, i] = poles[i] - poles[j]
    between[:, np.arange(n), np.arange(n)] = 1.0
    renewed = np.sqrt(np.abs(np.prod(apart / between, axis=1)))
    vectors = np.copysign(renewed, z)[:, None, :] / apart
    vectors /= np.sqrt(np.einsum("lij,lij->li", vectors, vectors))[:, :, None]
    return roots, vectors.transpose(0, 2, 1)


def _rational(c, s, big, own, following):
    """The root of ``c + s / (own - t) + big / (following - t)`` between the two poles.

    Without a finite second pole, that of ``c + s / (own - t)``.
    """
    with np.errstate(all="ignore"):
        last = np.isinf(following)
        second = np.where(last, 0.0, following)
        b = c * (own + second) + s + big
        e = c * own * second + s * second + big * own
        root = np.sqrt(np.maximum(b * b - 4 * c * e, 0.0))
        return np.where(last, own + s / c, np.where(b >= 0, 2 * e / (b + root), (b - root) / (2 * c)))


_SPECTRA = "slot long, n double, mean array<double>, values array<double>, basis array<double>"


def _pack(slot: int, one: Spectra) -> pa.RecordBatch:
    arrays = [[one.mean[0]], [one.values[0]], [one.basis[0].ravel()]]
    return pa.RecordBatch.from_arrays(
        [pa.array([slot], pa.int64()), pa.array(one.n), *[pa.array(a, pa.list_(pa.float64())) for a in arrays]],
        names=["slot", "n", "mean", "values", "basis"],
    )


def _unpack(table: pa.Table) -> Spectra:
    n = np.array(table.column("n").to_pylist())
    mean, values, basis = (np.array(table.column(c).to_pylist()) for c in ("mean", "values", "basis"))
    return Spectra(n, mean, values, basis.reshape(len(n), *mean.shape[1:], -1))


# --- the distributed passes ------------------------------------------------------------


def usable(vector: str) -> Column:
    """Not null, and without null or non-finite entries."""
    x = F.col(vector).cast("array<double>")
    return F.col(vector).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))


def quantised(vector: str, scale: int = 256) -> Column:
    """Each entry as the long ``floor(scale * entry)``; beyond 64 bits the nearest long."""
    return F.transform(F.col(vector).cast("array<double>"), lambda v: F.floor(F.lit(float(scale)) * v))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """Lists of longs, all of one width, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _centred(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - S / n`` in doubles."""
    exact = _scaled(rows, n, sums)
    return exact.astype(float) / n


def _scaled(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S`` exactly: as longs, or as Python integers where these could overflow."""
    most = max(int(rows.max(initial=0)), -int(rows.min(initial=0)))
    if n * most + max(map(abs, sums), default=0) < 2**63:
        return n * rows - np.array(sums, dtype=np.int64)
    return n * rows.astype(object) - np.array(sums, dtype=object)


def _deviations(rows: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sums of squares of ``n * x - S``, exactly; None beyond 64 bits."""
    exact = _scaled(rows, n, sums)
    if exact.dtype != object and float(np.abs(exact).max(initial=0)) ** 2 * exact.shape[1] < 2.0**62:
        return (exact * exact).sum(axis=1).tolist()
    found = [sum(int(v) ** 2 for v in row) for row in exact]
    return [v if v < 2**63 else None for v in found]


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct vectors with sums ``sums``; ``basis[:, k]`` is component k, of
    variance ``values[k]``; ``error`` is how far whitened vectors are from the identity."""

    n: int
    sums: list[int]
    basis: np.ndarray
    values: np.ndarray
    trace: float
    error: float


def _totals(points: DataFrame, width: int) -> list[int]:
    """Exact sums per dimension; each task adds up its rows before the shuffle."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=object)
        for batch in batches:
            rows = _rows(batch.column("x"), width)
            # Halves of 32 bits, whose sums over a batch can't overflow.
            total += (rows >> 32).sum(axis=0).astype(object) * 2**32 + (rows & 0xFFFFFFFF).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_pydict({"dim": np.arange(width, dtype=np.int32), "total": pa.array([str(v) for v in total])})

    partial = points.mapInArrow(add, "dim int, total string")
    found = partial.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    by_dim = {r["dim"]: int(r["total"]) for r in found}
    return [by_dim.get(d, 0) for d in range(width)]


def spectrum(points: DataFrame, width: int) -> Spectra:
    """The spectrum of all points' scatter, by rank-one updates in tasks and over a tree."""

    def take_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, slot = Spectra.empty(LANES, width), pyspark.TaskContext.get().partitionId()
        for batch in batches:
            rows = _rows(batch.column("x"), width).astype(float)
            for k in range(0, len(rows), LANES):
                own.add(rows[k : k + LANES])
        if own.n[0]:
            yield _pack(slot, own[: int((own.n > 0).sum())].joined())

    def combine(table: pa.Table) -> pa.Table:
        # Sorted, so that a task run again gives the same.
        table = table.sort_by([("n", "descending"), ("part", "ascending")])
        return pa.Table.from_batches([_pack(table.column("slot")[0].as_py(), _unpack(table).joined())])

    spectra = points.mapInArrow(take_in, _SPECTRA)
    n_slots = max(points.rdd.getNumPartitions(), 1)
    while n_slots > 1:
        spectra = spectra.withColumn("part", F.col("slot")).withColumn("slot", F.floor(F.col("slot") / FAN_IN))
        spectra = spectra.groupBy("slot").applyInArrow(combine, _SPECTRA)
        n_slots = -(-n_slots // FAN_IN)
    found = spectra.toArrow()  # one, or none
    return _unpack(found) if found.num_rows else Spectra.empty(1, width)


def _covariance(points: DataFrame, n: int, sums: list[int], basis: np.ndarray, means: bool = False) -> np.ndarray:
    """The covariance of the points' projections on a basis, centred before multiplying.

    ``means`` returns their means instead. A task sends one small matrix.
    """
    width, size = basis.shape

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size if means else size * size)
        for batch in batches:
            found = _centred(_rows(batch.column("x"), width), n, sums) @ basis
            total += found.sum(axis=0) if means else (found.T @ found).ravel()
        yield pa.RecordBatch.from_pydict({"cell": np.arange(len(total), dtype=np.int32), "value": total})

    partial = points.mapInArrow(multiply, "cell int, value double")
    total = np.zeros(size if means else size * size)
    for row in partial.groupBy("cell").agg(F.sum("value").alias("value")).collect():
        total[row["cell"]] = row["value"]
    return total / n if means else total.reshape(size, size) / n


def fit(points: DataFrame, n: int, width: int, components: int) -> Whitening:
    """Fit on a written table of distinct vectors ``x``, all of which are read in each pass."""
    sums = _totals(points, width)
    basis, _ = np.linalg.qr(spectrum(points, width).basis[0])
    small = _covariance(points, n, sums, basis)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    trace = float(np.trace(small))
    falling = np.argsort(-values, kind="stable")[:components]
    falling = falling[values[falling] > NO_VARIANCE * trace]
    values, basis = values[falling], basis @ turn[:, falling]
    error = 0.0
    if len(values):
        whitened = _covariance(points, n, sums, basis / np.sqrt(values))
        error = float(np.abs(whitened - np.eye(len(values))).max())
    return Whitening(n, sums, basis, values, trace, error)


def whiten(table: DataFrame, components: int = 4, vector: str = "embedding", key: str = "vec_id", scale: int = 256) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)``.

    One record per remaining row and component. Rows whose vector is null or holds null
    or non-finite entries are dropped; repeated rows and null keys stay. Entries that a
    vector lacks against the longest one count as 0. There are fewer components where
    the vectors vary in fewer directions, so none for one distinct vector or an empty
    table. ``deviation`` is null where it exceeds 64 bits. Components of equal variance
    come in any rotation, the same for all rows. Other columns are not read.
    """
    schema = f"{key} {table.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    good = table.where(usable(vector)).select(F.col(key), F.col(vector).alias("x"))
    width = good.agg(F.max(F.size("x"))).first()[0] or 0
    lacking = F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("x"))
    x = quantised("x", scale)
    rows = good.select(F.col(key), F.when(F.size("x") < width, F.concat(x, lacking)).otherwise(x).alias("x"))
    stages = Stages(table.sparkSession)
    points, seen = stages.observed_table(rows.select("x").distinct(), "points", n=F.count("*"))
    n = seen["n"]
    model = fit(points, n, width, components) if n and width else Whitening(n, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
    stages.drop()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(model.values)
        if not size:
            return
        for batch in batches:
            x = _rows(batch.column("x"), width)
            found = _centred(x, model.n, model.sums) @ model.basis / np.sqrt(model.values)
            each = np.repeat(np.arange(len(x)), size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), model.n)),
                    pa.array(_deviations(x, model.n, model.sums), pa.int64()).take(pa.array(each)),
                    pa.array(found.ravel()),
                    pa.array(np.tile(model.values / model.trace, len(x))),
                    pa.array(np.full(len(each), model.error)),
                ],
                schema=pa.schema(
                    [(key, batch.column(key).type), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                     ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]
                ),
            )

    return rows.mapInArrow(project, schema)
