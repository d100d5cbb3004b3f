"""Whitening of integer-scaled vectors with an exact covariance from bit-sliced scatter matrices.

Every entry c of a vector becomes the integer ``x = floor(scale * c) + offset``.  The fit list holds each distinct x vector once.  A task packs the
bits of its vectors, less the least value of each dimension, into words: one row of words for each dimension and bit.  The
number of common ones of two such rows, weighted by both bits' values, adds up to the exact cross-products of two dimensions.  Cross-products
(d * d numbers a task) are summed by Spark, centred on the driver as integers, and only then divided and decomposed.

Defined results: a vector that is null or holds a null, NaN or infinite entry is left out, and so is one with fewer entries than the longest (the others
are missing).  Scaled entries are held within +-2^61.  Repeated rows count once in the fit and each get a result.  Components whose
variance is zero up to rounding have null in ``whitened``.  A ``deviation`` that no long can hold is null.  Without rows the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import kind, map_batches, settle

# Vectors that are packed and compared at a time.
PACKED = 8192
# Sums of cross-products travel as two decimals: multiples of 2^60, and the rest.
HALF = 60
LARGEST = 2.0**61


def scaled(column: str, scale: int = 64, offset: int = 1_000_000) -> Column:
    """The integer vector of an array of numbers; null for a vector that is left out."""
    entry = lambda c: c.cast("double")
    sound = F.forall(column, lambda c: c.isNotNull() & (F.abs(entry(c)) < float("inf")))
    whole = lambda c: F.floor(F.greatest(F.least(entry(c) * scale, F.lit(LARGEST)), F.lit(-LARGEST))).cast("bigint") + F.lit(offset).cast("bigint")
    return F.when(F.col(column).isNotNull() & sound, F.transform(column, whole))


def bit_planes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of non-negative integers (n, d) as words (plane, word), and the dimension and place value of each plane."""
    planes, dims, bits = [], [], []
    for j in range(v.shape[1]):
        for b in range(int(v[:, j].max()).bit_length()):
            planes.append(np.packbits((v[:, j] >> b & 1).astype(bool)))
            dims.append(j)
            bits.append(b)
    words = np.zeros((len(planes), -(-len(v) // 64) * 8), np.uint8)
    if planes:
        words[:, : len(planes[0])] = planes
    return words.view(np.uint64), np.array(dims, int), np.array(bits, int)


def cross_products(x: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross-products of ``x - offset`` as Python integers, by AND and popcount of bit planes."""
    n, d = x.shape
    low = x.min(axis=0)
    words, dims, bits = bit_planes(x - low)
    common = np.zeros((len(words), len(words)), np.int64)
    for k in range(len(words)):
        common[k, k:] = np.bitwise_count(words[k:] & words[k]).sum(axis=1, dtype=np.int64)
        common[k:, k] = common[k, k:]
    narrow = not len(bits) or 2 * (int(bits.max()) + 1) + n.bit_length() + 1 < 62
    kind_ = np.int64 if narrow else object
    weight = np.array([1 << int(b) for b in bits], kind_)
    place = np.zeros((len(words), d), kind_)
    place[np.arange(len(words)), dims] = weight
    sums = (place.T @ np.diag(common).astype(kind_)).astype(object)
    cross = (place.T @ common.astype(kind_) @ place).astype(object)
    shift = np.array([int(a) - offset for a in low], object)
    cross = cross + np.outer(shift, sums) + np.outer(sums, shift) + n * np.outer(shift, shift)
    return sums + n * shift, cross


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _scatter(fit: DataFrame, d: int, offset: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of vectors, their sums and cross-products about ``offset``: every task sends one row a pair of dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((d + 1, d + 1), object)
        for batch in batches:
            for at in range(0, batch.num_rows, PACKED):
                x = _matrix(batch.column(0).slice(at, PACKED), d)
                sums, cross = cross_products(x, offset)
                n += len(x)
                total[:d, :d] += cross
                total[d, :d] += sums
        if n:
            total[d, d] = n
            i, j = np.tril_indices(d + 1)
            values = [int(v) for v in total[i, j]]
            half = lambda f: pa.array([Decimal(f(v)) for v in values], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), half(lambda v: v >> HALF), half(lambda v: v & ((1 << HALF) - 1))], ["i", "j", "high", "low"]
            )

    parts = fit.select("x").mapInArrow(run, "i int, j int, high decimal(38,0), low decimal(38,0)")
    found = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()  # (d + 1) * (d + 2) / 2 rows
    total = {(r["i"], r["j"]): (int(r["high"]) << HALF) + int(r["low"]) for r in found}
    return total[d, d], [total[d, j] for j in range(d)], [[total[max(i, j), min(i, j)] for j in range(d)] for i in range(d)]


@dataclass
class Whitening:
    """A fitted transform: ``n`` vectors with sums ``sums``, eigenvalues (falling) with their vectors as columns, and what the fit achieved."""

    n: int = 0
    sums: list[int] = field(default_factory=list)
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    explained: np.ndarray = field(default_factory=lambda: np.zeros(0))
    identity_error: float = 0.0

    @property
    def known(self) -> np.ndarray:
        """Components whose variance is not zero up to rounding."""
        return self.values > (self.values[:1].max(initial=0.0) * len(self.sums) * np.finfo(float).eps)

    def away(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact (Python integers where 64 bits might not do)."""
        most = max(abs(int(x.min())), abs(int(x.max()))) * self.n + max(map(abs, self.sums)) if x.size else 0
        wide = most >= 2**62
        return (x.astype(object) if wide else x) * self.n - np.array(self.sums, object if wide else np.int64)

    def whiten(self, away: np.ndarray) -> np.ndarray:
        """Components of vectors given as ``n * x - sums``; NaN for components without variance."""
        known = self.known
        scale = np.where(known, np.sqrt(np.where(known, self.values, 1.0)), np.nan)
        return (away.astype(float) / self.n) @ self.vectors / scale


def deviations(away: np.ndarray) -> list[int | None]:
    """Sums of squares; null where a long cannot hold them."""
    if away.dtype != object and away.size and int(np.abs(away).max()) ** 2 * away.shape[1] < 2**63:
        return (away * away).sum(axis=1).tolist()
    found = [sum(int(v) ** 2 for v in row) for row in away]
    return [v if v < 2**63 else None for v in found]


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, over the components with variance."""
    known = np.flatnonzero(model.known)
    k, d = len(known), len(model.sums)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for at in range(0, batch.num_rows, PACKED):
                w = model.whiten(model.away(_matrix(batch.column(0).slice(at, PACKED), d)))[:, known]
                total[:k] += w.T @ w
                total[k] += w.sum(axis=0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    total = np.zeros((k + 1, k))
    for r in fit.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # (k + 1) * k rows
        total[r["i"], r["j"]] = r["v"]
    mean = total[k] / model.n
    return float(np.abs(total[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def decompose(n: int, sums: list[int], cross: list[list[int]], components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Falling eigenvalues, their vectors (greatest entry positive) and shares of the trace, from sums and cross-products."""
    d = len(sums)
    v = np.array([[(n * cross[i][j] - sums[i] * sums[j]) / (n * n) for j in range(d)] for i in range(d)], float).reshape(d, d)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    trace = float(np.trace(v))
    return values, vectors, values / trace if trace > 0 else np.zeros(len(values))


def with_x(df: DataFrame, column: str, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """``df`` with the integer vectors as ``_x``, without the rows that have none."""
    return df.withColumn("_x", scaled(column, scale, offset)).where("_x is not null")


def fit(df: DataFrame, column: str, components: int = 16, scale: int = 64, offset: int = 1_000_000) -> Whitening:
    """Fit on the distinct integer vectors of a column (written once, read three times)."""
    vectors = settle(with_x(df.select(column), column, scale, offset).select(F.col("_x").alias("x")).distinct(), "whitening")
    d = vectors.agg(F.max(F.size("x"))).first()[0]
    if not d:
        return Whitening()
    vectors = vectors.where(F.size("x") == d)
    n, sums, cross = _scatter(vectors, d, offset)
    values, axes, explained = decompose(n, sums, cross, components)
    model = Whitening(n, [s + n * offset for s in sums], values, axes, explained)
    model.identity_error = _identity_error(vectors, model)
    return model


def transform(df: DataFrame, column: str, model: Whitening, keep: list[str], scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """The kept columns of every row that has a vector, with ``deviation`` (the exact sum of squares of ``n * x - sums``) and ``whitened``."""
    keep, d = [c for c in keep if c not in ("deviation", "whitened")], len(model.sums)
    rows = with_x(df.select(*keep, F.col(column).alias("_v")), "_v", scale, offset).where(F.size("_x") == d).select(*keep, "_x")
    rows = rows if d else rows.where(F.lit(False))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        away = model.away(_matrix(batch.column(len(keep)), d))
        w = model.whiten(away)
        at = pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32())
        return pa.RecordBatch.from_arrays(
            [*batch.columns[: len(keep)], pa.array(deviations(away), pa.int64()), pa.ListArray.from_arrays(at, pa.array(w.ravel(), from_pandas=True))],
            [*keep, "deviation", "whitened"],
        )

    return map_batches(rows, run, ", ".join([f"`{c}` {kind(df, c)}" for c in keep] + ["deviation bigint", "whitened array<double>"]), PACKED)
