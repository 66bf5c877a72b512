"""Whitening of vectors with leading components found by spectrum slicing.

The entries become whole numbers, so sums and the covariance are exact: vectors are
centred at the whole number next to each mean, products are added as whole numbers
on Spark, and the rest of the centring is done with whole numbers on the driver,
which holds one matrix of the vectors' dimension.

The number of positive pivots of an LDL^T factorisation of the covariance, shifted
by s, is the number of eigenvalues above s. Halving intervals by these counts
isolates each leading eigenvalue; Rayleigh quotient iteration, which converges
cubically, then gives it with its vector, and counts on both sides of the result
certify its number. Eigenvalues that no shift can part are taken as one group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import append, bound_batches, grown, require

SCALE, OFFSET = 1024, 100_000
#: Entries beyond are set to it: 2**40 is far outside what an embedding holds and keeps products whole.
GREATEST = float(1 << 40)
EXACT = float(1 << 53)
LONG = 1 << 63


# --- eigenvalues by counting ----------------------------------------------------------


def inertia(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above the shift, by symmetric pivoting with pivots of one or two rows (Bunch and Kaufman)."""
    a = matrix - shift * np.eye(len(matrix))
    least = np.finfo(float).eps * max(1e-300, float(np.abs(a).max(initial=0.0)))
    bound = (1 + 17**0.5) / 8
    above = 0
    while len(a):
        column = np.abs(a[1:, 0])
        r = int(column.argmax()) + 1 if len(column) else 0
        beside = float(column[r - 1]) if r else 0.0
        two = False
        if r and abs(a[0, 0]) < bound * beside:
            other = np.abs(a[:, r])
            other[r] = 0.0
            most = float(other.max())
            if abs(a[0, 0]) * most < bound * beside * beside:
                if abs(a[r, r]) >= bound * most:
                    a[[0, r]] = a[[r, 0]]
                    a[:, [0, r]] = a[:, [r, 0]]
                else:
                    two = True
                    a[[1, r]] = a[[r, 1]]
                    a[:, [1, r]] = a[:, [r, 1]]
        if two:
            # the off-diagonal entry outweighs the rest, so the two signs differ
            above += 1
            block = a[2:, :2]
            a = a[2:, 2:] - block @ np.linalg.solve(a[:2, :2], block.T)
        else:
            pivot = float(a[0, 0])
            if abs(pivot) < least:
                pivot = -least
            above += pivot > 0
            a = a[1:, 1:] - np.outer(a[1:, 0], a[0, 1:]) / pivot
    return above


class Spectrum:
    """Counts of eigenvalues above the shifts tried so far, which all eigenvalues share."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        radius = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
        self.tiny = max(radius, 1e-300) * np.finfo(float).eps * max(1, len(matrix))
        self.shifts = [-radius - self.tiny, radius + self.tiny]
        self.counts = [len(matrix), 0]

    def above(self, shift: float) -> int:
        k = int(np.searchsorted(self.shifts, shift))
        if k < len(self.shifts) and self.shifts[k] == shift:
            return self.counts[k]
        count = inertia(self.matrix, shift)
        self.shifts.insert(k, shift)
        self.counts.insert(k, count)
        return count

    def bracket(self, number: int) -> tuple[float, float, int, int]:
        """(low, high, count above low, count above high): the narrowest interval known to hold eigenvalue ``number``."""
        k = next(i for i, c in enumerate(self.counts) if c < number)
        return self.shifts[k - 1], self.shifts[k], self.counts[k - 1], self.counts[k]

    def halve(self, number: int) -> None:
        low, high, _, _ = self.bracket(number)
        self.above(0.5 * (low + high))


def _away(vector: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for u in found:
            vector = vector - (u @ vector) * u
    return vector / np.linalg.norm(vector)


def _solve(matrix: np.ndarray, shift: float, vector: np.ndarray, tiny: float) -> np.ndarray:
    eye = np.eye(len(matrix))
    for step in (0.0, tiny, -3 * tiny):
        try:
            y = np.linalg.solve(matrix - (shift + step) * eye, vector)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(y).all() and np.linalg.norm(y) > 0:
            return y / np.linalg.norm(y)
    return vector


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(values, vectors as columns, counts): up to ``most`` eigenvalues above rounding, falling.

    ``counts`` holds, for each, how many eigenvalues lie above the certified lower
    edge of its group: its own number, or that of its group's last member.
    """
    spectrum = Spectrum(matrix)
    d = len(matrix)
    start = np.cos(np.arange(1, d + 1) * 1.6180339887498949) + 0.1
    wanted = min(most, spectrum.above(4 * spectrum.tiny)) if d else 0
    values: list[float] = []
    vectors: list[np.ndarray] = []
    counts: list[int] = []
    number = 1
    while number <= wanted:
        low, high, upper, lower = spectrum.bracket(number)
        if upper - lower > 1 and high - low > 8 * spectrum.tiny:
            spectrum.halve(number)
            continue
        if upper - lower > 1:
            # no shift parts these: any orthonormal basis of their space will do
            for k in range(upper - lower):
                x = _away(np.roll(start, k), vectors)
                for _ in range(4):
                    x = _away(_solve(matrix, high + 2 * spectrum.tiny, x, spectrum.tiny), vectors)
                vectors.append(x)
                values.append(float(x @ matrix @ x))
                counts.append(upper)
            number = upper + 1
            continue
        found = _isolated(spectrum, number, start, vectors)
        if found is None:
            spectrum.halve(number)
            continue
        values.append(found[0])
        vectors.append(found[1])
        counts.append(number)
        number += 1
    # a group may reach over the wanted number
    basis = np.array(vectors[:wanted]).reshape(-1, d).T
    at = np.abs(basis).argmax(axis=0) if wanted else []
    signs = np.sign(basis[at, np.arange(wanted)]) if wanted else np.ones(0)
    return np.array(values[:wanted]), basis * signs, counts[:wanted]


def _isolated(spectrum: Spectrum, number: int, start: np.ndarray, found: list[np.ndarray]) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration for the one eigenvalue of a bracket; None if it leaves it or is not certified."""
    low, high, _, _ = spectrum.bracket(number)
    matrix, tiny = spectrum.matrix, spectrum.tiny
    x = _away(start, found)
    for _ in range(2):
        x = _away(_solve(matrix, 0.5 * (low + high), x, tiny), found)
    value = float(x @ matrix @ x)
    for _ in range(12):
        if not low <= value <= high:
            break
        y = _solve(matrix, value, x, tiny)
        new = float(y @ matrix @ y)
        done = abs(new - value) <= tiny and np.linalg.norm(matrix @ y - new * y) <= 4 * tiny
        x, value = y, new
        if done:
            break
    error = float(np.linalg.norm(matrix @ x - value * x)) + 4 * tiny
    if error > 64 * tiny or not low <= value <= high:
        if high - low <= 16 * tiny:
            # as narrow as counts can tell: inverse iteration away from what was found
            for _ in range(4):
                x = _away(_solve(matrix, 0.5 * (low + high), x, tiny), found)
            return float(x @ matrix @ x), x
        return None
    if spectrum.above(value - error) != number or spectrum.above(value + error) != number - 1:
        return None if high - low > 16 * tiny else (value, _away(x, found))
    # beside a near eigenvalue a vector is only known up to the rounding over the gap
    return value, _away(x, found)


# --- exact sums on Spark --------------------------------------------------------------


def _valid(vector: str) -> Column:
    v = F.col(vector)
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _numbers(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of whole numbers, one per vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return np.clip(np.floor(SCALE * flat) + OFFSET, -GREATEST, GREATEST).astype(np.int64).reshape(-1, dim)


def _whole(values: np.ndarray) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values.tolist()], pa.decimal128(38, 0))


def _summed(parts: DataFrame, *keys: str) -> list:
    return parts.groupBy(*keys).agg(F.sum("v").alias("v")).collect()


def _sums(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """(dimension, vectors, sum per dimension) of the most common dimension, of equals the greatest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                rows = _numbers(batch.column(0).filter(pa.array(sizes == dim)), dim) if dim else np.zeros((int((sizes == 0).sum()), 0), np.int64)
                # the last cell counts vectors; cells stay exact, as Python numbers
                new = np.array([*rows.sum(axis=0).tolist(), len(rows)], object)
                sums[dim] = sums.get(dim, 0) + new
        for dim, cells in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(cells), pa.int32()), pa.array(range(len(cells)), pa.int32()), _whole(cells)], names=["dim", "i", "v"])

    rows = _summed(vectors.mapInArrow(run, "dim int, i int, v decimal(38,0)"), "dim", "i")
    if not rows:
        return 0, 0, []
    cells = {(r["dim"], r["i"]): int(r["v"]) for r in rows}
    dim = max((cells[d, d], d) for d, i in cells if d == i)[1]
    return dim, cells[dim, dim], [cells[dim, i] for i in range(dim)]


def _products(vectors: DataFrame, dim: int, centre: list[int]) -> np.ndarray:
    """Sum of outer products of the centred vectors, exact (object numbers)."""
    upper = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(upper[0]), object)
        whole = np.zeros((dim, dim), np.int64)
        held = 0.0
        for batch in batches:
            rows = _numbers(batch.column(0), dim) - np.array(centre, np.int64)
            for at in range(0, len(rows), 4096):
                part = rows[at : at + 4096]
                most = float(np.abs(part).max(initial=0)) ** 2 * len(part)
                if most < EXACT:
                    # the product of doubles has no rounding here
                    whole += (part.T.astype(np.float64) @ part.astype(np.float64)).astype(np.int64)
                    held += most
                else:
                    big = part.astype(object)
                    total += (big.T @ big)[upper]
                if held > float(1 << 61):
                    total += whole[upper].astype(object)
                    whole[:] = 0
                    held = 0.0
        total += whole[upper].astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), _whole(total)], names=["i", "j", "v"])

    out = np.zeros((dim, dim), object)
    for r in _summed(vectors.mapInArrow(run, "i int, j int, v decimal(38,0)"), "i", "j"):
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = int(r["v"])
    return out


@dataclass
class Whitening:
    """What a fit keeps: bounded by the square of the dimension."""

    dim: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    counts: list[int]
    trace: float

    @property
    def centre(self) -> list[int]:
        """The whole number next to each mean."""
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums] if self.n else []

    @property
    def rest(self) -> list[int]:
        """n times what each mean is above its centre."""
        return [s - self.n * c for s, c in zip(self.sums, self.centre)]

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.values]


def usable(df: DataFrame, vector: str = "embedding", dim: int | None = None) -> DataFrame:
    """The rows that take part: no null vector, no null, NaN or infinite entry, and of the given dimension."""
    rows = df.filter(_valid(vector))
    return rows if dim is None else rows.filter(F.size(vector) == dim)


def fit(df: DataFrame, vector: str = "embedding", components: int = 8) -> Whitening:
    """Fit on all usable rows.

    If vectors differ in length, those of the most common length take part.
    Components whose eigenvalue cannot be told from zero are left out, so fewer
    vectors than dimensions, or equal ones, give fewer components; an empty table
    gives none.
    """
    require(df, vector)
    bound_batches(df.sparkSession)
    column = F.col(vector).cast("array<double>").alias("v")
    dim, n, sums = _sums(usable(df, vector).select(column))
    model = Whitening(dim, n, sums, np.zeros(0), np.zeros((dim, 0)), [], 0.0)
    if not dim or not n:
        return model
    products = _products(usable(df, vector, dim).select(column), dim, model.centre)
    rest = np.array(model.rest, object)
    exact = n * products - np.outer(rest, rest)
    square = n * n
    covariance = np.array([[x / square for x in row] for row in exact.tolist()], np.float64)
    model.trace = sum(exact.diagonal().tolist()) / square
    model.values, model.vectors, model.counts = leading(covariance, min(components, dim))
    return model


def _projected(rows: np.ndarray, model: Whitening) -> np.ndarray:
    return (rows - np.array([r / model.n for r in model.rest])) @ (model.vectors / np.sqrt(model.values))


def _deviation(rows: np.ndarray, n: int, rest: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; null if beyond a LONG."""
    most = n * int(np.abs(rows).max(initial=0)) + max(map(abs, rest), default=0)
    if most * most * max(1, rows.shape[1]) < LONG:
        return ((n * rows - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
    far = (n * rows.astype(object) - np.array(rest, object)) ** 2
    return [v if v < LONG else None for v in far.sum(axis=1).tolist()]


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """The usable rows with ``deviation`` and ``whitened``, an array of one value per component.

    Other columns stay; columns named like the new ones are replaced.
    """
    require(df, vector)
    bound_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in ("deviation", "whitened")]
    work = usable(df, vector, model.dim).select(*kept, F.col(vector).cast("array<double>").alias("__v"))
    size = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _numbers(batch.column(len(kept)), model.dim) - np.array(model.centre, np.int64)
            values = _projected(rows, model)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * size), pa.array(values.ravel(), pa.float64()))
            told = pa.RecordBatch.from_arrays(batch.columns[: len(kept)], names=kept)
            yield append(told, deviation=pa.array(_deviation(rows, model.n, model.rest), pa.int64()), whitened=lists)

    return work.mapInArrow(run, grown(df.select(*kept), "deviation long, whitened array<double>"))


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """Largest absolute entry of the measured covariance of the whitened rows minus the identity."""
    size = len(model.values)
    if not size:
        return 0.0
    dim = model.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            values = _projected(_numbers(batch.column(0), dim) - np.array(model.centre, np.int64), model)
            total += values.T @ values
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    column = F.col(vector).cast("array<double>").alias("v")
    rows = _summed(usable(df, vector, dim).select(column).mapInArrow(run, "i int, j int, v double"), "i", "j")
    return max(abs(r["v"] / model.n - (r["i"] == r["j"])) for r in rows)
