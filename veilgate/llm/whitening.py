"""Whitening of embeddings by eigenvectors refined in mixed precision.

Entries are fixed-point integers, so moments are exact whatever the order of tasks: each task adds up products of
integers centred on the integer part of the mean, Spark sums them as decimals, and what the integer part leaves of the
mean is taken off exactly. The covariance (dimension squared, not rows) is decomposed in float32 and corrected by
Ogita-Aishima iterations: matrix products in extended precision give each eigenvector's part in every other. Where
eigenvalues are too close for that, their block is shifted, scaled up and decomposed on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgate.llm.common import batch, scan

#: Steps per unit and value of zero of the fixed-point entries.
STEPS, ZERO = 64, 1_000_000
#: Entries of this many steps or more are not exact as doubles and count as not finite.
RANGE = float(1 << 53)
#: Components returned at most.
COMPONENTS = 32

_WIDE = np.longdouble
_EXACT = 1 << 53  # integers up to here are exact as doubles


@dataclass(frozen=True)
class Whitening:
    """A fitted model: n vectors with sums S, components as columns, eigenvalues falling."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def scales(self) -> np.ndarray:
        """1 / sqrt(e); 0 for components without variance beyond rounding."""
        least = self.trace * len(self.sums) * np.finfo(float).eps
        some = self.values > least
        return np.where(some, 1 / np.sqrt(np.where(some, self.values, 1)), 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S of every entry, exact: int64, or Python integers where those are too narrow."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], object)
        y = x - whole
        most = max(int(np.abs(y).max(initial=0)), 1) * self.n + self.n
        kind = np.int64 if most < 1 << 62 else object
        return y.astype(kind) * self.n - rest.astype(kind)

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(float) @ (self.vectors * self.scales)


# entries --------------------------------------------------------------------------------------------


def fixed_point(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have a vector, its entries floor(64 c) + 1000000 as int64, one row each).

    Null and empty vectors and those with a null, non-finite or out-of-range entry have none.
    """
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    steps = STEPS * pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    good = np.abs(steps) < RANGE
    bad = np.concatenate(([0], np.cumsum(~good)))
    ends = np.cumsum(lengths)
    keep = (lengths > 0) & (bad[ends] == bad[ends - lengths])
    sizes = np.unique(lengths[keep])
    if len(sizes) > 1:
        raise ValueError(f"vectors of several lengths: {sizes.tolist()}")
    x = np.floor(steps[np.repeat(keep, lengths)]).astype(np.int64) + ZERO
    return keep, x.reshape(-1, sizes[0] if len(sizes) else 1)


def products(y: np.ndarray) -> np.ndarray:
    """y^T y of integers, exact."""
    if len(y) * int(np.abs(y).max(initial=0)) ** 2 < _EXACT:
        wide = y.astype(float)
        return (wide.T @ wide).astype(np.int64)
    return y.astype(object).T @ y.astype(object)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for rows in batches:
        _, x = fixed_point(rows.column(0))
        if len(x):
            n += len(x)
            part = x.sum(axis=0, dtype=np.int64) if int(np.abs(x).max()) * len(x) < 1 << 62 else x.astype(object).sum(axis=0)
            if total is not None and len(total) != len(part):
                raise ValueError(f"vectors of several lengths: {sorted((len(total), len(part)))}")
            total = part.astype(object) if total is None else total + part
    if n:
        d = len(total)
        yield batch(
            {
                "d": ([d] * d, pa.int32()),
                "j": (range(d), pa.int32()),
                "n": ([n] * d, pa.int64()),
                "s": (pa.array([int(v) for v in total], pa.decimal128(38, 0)), None),
            }
        )


def _moments(whole: np.ndarray):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for rows in batches:
            _, x = fixed_point(rows.column(0))
            if len(x):
                part = products(x - whole).astype(object)
                total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(whole))
            values = pa.array([int(v) for v in total[i, j]], pa.decimal128(38, 0))
            yield batch({"i": (i, pa.int32()), "j": (j, pa.int32()), "s": (values, None)})

    return each


# eigenvectors ---------------------------------------------------------------------------------------


def eigen(v: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and orthonormal eigenvectors, as columns, of a symmetric matrix, in extended precision."""
    v = np.asarray(v, _WIDE)
    size = np.abs(v).max(initial=0)
    if not size:
        return np.zeros(len(v), _WIDE), np.eye(len(v), dtype=_WIDE)
    v = v / size
    x = np.linalg.eigh(v.astype(np.float32))[1].astype(_WIDE)
    values, x = _refined(v, x, rounds)
    order = np.argsort(-values, kind="stable")
    return values[order] * size, x[:, order]


def _refined(v: np.ndarray, x: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Ogita-Aishima iterations on approximate eigenvectors ``x``; clusters are decomposed as blocks of their own."""
    unit = np.eye(len(v), dtype=_WIDE)
    before, block = np.inf, None
    for _ in range(rounds):
        r = unit - x.T @ x
        s = x.T @ (v @ x)
        s = (s + s.T) / 2  # rounding must not tilt the vectors against each other
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        close = 2 * (np.sqrt((off**2).sum()) + np.sqrt((r**2).sum()) * np.sqrt((v**2).sum()))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > close
        if block is not None:  # within a cluster its own decomposition holds
            apart &= block[:, None] != block[None, :]
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        change = np.abs(e).max()
        if change > before / 2 and change < 1e-9 and block is not None:
            break  # as far as the precision goes
        before = change
        if change < 1e-9 and block is None:
            x, block = _split_clusters(v, x, values, rounds)
            before = np.inf
    x = x / np.sqrt((x**2).sum(axis=0))
    return np.einsum("ij,ij->j", x, v @ x), x


def _split_clusters(v: np.ndarray, x: np.ndarray, values: np.ndarray, rounds: int, width: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """``x`` with the vectors of each cluster (neighbours at most ``width`` apart) turned to the eigenvectors of its block,
    and the number of each vector's block.

    The block is shifted by its mean, so its decomposition is as precise as the differences within it allow. A block of
    rounding alone is a multiple eigenvalue, of which any basis will do.
    """
    order = np.argsort(values)
    x, number = x.copy(), np.empty(len(v), int)
    for k, block in enumerate(np.split(order, np.flatnonzero(np.diff(values[order]) > width) + 1)):
        number[block] = k
        if len(block) > 1:
            own = x[:, block]
            shifted = own.T @ (v @ own) - values[block].mean() * (own.T @ own)
            if np.abs(shifted).max() > 16 * len(v) * np.finfo(_WIDE).eps:
                x[:, block] = own @ eigen((shifted + shifted.T) / 2, rounds)[1]
    return x, number


# the operator ---------------------------------------------------------------------------------------


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all vectors, or None if there are none. Two scans; the driver gets numbers per pair of dimensions."""
    column = vectors.select(F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    sums = scan(column, _sums, "d int, j int, n long, s decimal(38,0)").groupBy("d", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    first = sums.orderBy("d", "j").collect()
    if not first:
        return None
    d = first[0].d
    if len(first) != d:
        raise ValueError(f"vectors of several lengths: {sorted({row.d for row in first})}")
    n, total = int(first[0].n), [int(row.s) for row in first]
    whole = np.array([s // n for s in total], np.int64)
    rest = [s % n for s in total]
    found = scan(column, _moments(whole), "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s"))
    v = np.zeros((d, d), _WIDE)
    for i, j, s in found.collect():
        v[i, j] = v[j, i] = _WIDE(int(s) * n - rest[i] * rest[j]) / _WIDE(n) / _WIDE(n)
    values, axes = eigen(v)
    top = min(components, d)
    return Whitening(n, tuple(total), axes[:, :top].astype(float), np.maximum(values[:top].astype(float), 0), float(np.trace(v)))


def identity_error(vectors: DataFrame, model: Whitening, vector_col: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured on all rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for rows in batches:
            _, x = fixed_point(rows.column(0))
            if len(x):
                w = np.column_stack((np.ones(len(x)), model.whiten(model.centred(x))))
                total = total + w.T @ w
        if np.ndim(total):
            i, j = np.triu_indices(len(total))
            yield batch({"i": (i, pa.int32()), "j": (j, pa.int32()), "s": (total[i, j], pa.float64())})

    column = vectors.select(F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    k = len(model.values)
    moments = np.zeros((k + 1, k + 1))
    for i, j, s in scan(column, each, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        moments[i, j] = moments[j, i] = s / model.n
    mean = moments[0, 1:]
    return float(np.abs(moments[1:, 1:] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """One row per vector and component: ``id_col``, component, n, deviation, whitened, explained, identity_error.

    Rows without a vector (null, empty, or with a null, non-finite or, from 2^53 steps on, out-of-range entry) are left
    out and not fitted; repeated rows count and come back repeatedly; other columns are ignored; no vectors give no
    rows, vectors of several lengths are an error. ``deviation`` is null where it does not fit a long. A component
    without variance is 0 for all rows, which ``identity_error`` then shows as 1; ``explained`` of no variance is 0.
    """
    model = fit(vectors, vector_col, components)
    keyed = vectors.select(F.col(f"`{id_col}`"), F.col(f"`{vector_col}`").cast("array<double>").alias("__vector"))
    kind = keyed.schema[0]
    schema = T.StructType(
        [kind, T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keep, x = fixed_point(rows.column(1))
            if not len(x) or model is None:
                continue
            z = model.centred(x)
            most = int(np.abs(z).max())
            square = z if most * most * z.shape[1] < 1 << 63 else z.astype(object)
            deviation = [v if v < 1 << 63 else None for v in (square * square).sum(axis=1).tolist()]
            w = model.whiten(z)
            ends = np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)
            yield batch(
                {
                    id_col: (rows.column(0).filter(pa.array(keep)), None),
                    "deviation": (deviation, pa.int64()),
                    "whitened": (pa.ListArray.from_arrays(ends, w.ravel()), None),
                }
            )

    error = identity_error(vectors, model, vector_col) if model else 0.0
    share = (model.values / model.trace if model.trace > 0 else model.values * 0).tolist() if model else [0.0]
    wide = scan(keyed, each, schema).select(f"`{id_col}`", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return wide.select(
        f"`{id_col}`",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(F.array(*map(F.lit, share)), F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
