"""Embedding whitening: blockwise QR of the centred vectors, then singular values and directions of the small factor."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxward.llm.bidiagonal import right_singular
from voxward.llm.tables import stored


@dataclass(frozen=True)
class WhitenParams:
    """Entries become floor(``scale`` c) + ``offset``; ``components`` are kept. ``block`` rows are reduced at once, factors of
    up to ``factor_bytes`` together. Entries of ``limit`` or more in size count as not finite."""

    scale: int = 1024
    offset: int = 100_000
    components: int = 8
    block: int = 4096
    factor_bytes: int = 1 << 26
    limit: float = 2.0**30

    def __post_init__(self) -> None:
        if min(self.scale, self.components, self.block, self.factor_bytes) < 1 or self.offset < 0:
            raise ValueError("scale, components, block and factor_bytes must be positive, offset not negative")
        if not 0 < self.limit * self.scale + self.offset < 2.0**42:
            raise ValueError("limit times scale and offset must stay below 2 to the power of 42")


@dataclass(frozen=True)
class Fit:
    """Number of vectors, sums of their whole numbers, and the directions found: eigenvalues and their share of the trace."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def _usable(rows: DataFrame, params: WhitenParams) -> DataFrame:
    value = F.col("embedding").cast("array<double>")
    good = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < params.limit))
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(good).select("vec_id", value.alias("value"))


def _whole(batch: pa.RecordBatch, dim: int, params: WhitenParams) -> np.ndarray:
    flat = batch["value"].flatten().to_numpy(zero_copy_only=False)
    return np.floor(params.scale * flat.reshape(-1, dim)).astype(np.int64) + params.offset


def _sums(rows: DataFrame, params: WhitenParams) -> tuple[int, list[int]]:
    """Number and sums of the vectors of the most frequent length (of the longest, where lengths are equally frequent)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            sizes = np.diff(batch["value"].offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                count, total = found.get(dim, (0, [0] * dim))
                added = _whole(part, dim, params).sum(axis=0).tolist()
                found[dim] = (count + part.num_rows, [a + b for a, b in zip(total, added, strict=True)])
        made = [(d, n, [Decimal(x) for x in total]) for d, (n, total) in found.items()]
        columns = list(zip(*made, strict=True)) or [[], [], []]
        types = (pa.int64(), pa.int64(), pa.list_(pa.decimal128(38, 0)))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["dim", "n", "total"])

    parts = stored(rows.select("value").mapInArrow(run, "dim bigint, n bigint, total array<decimal(38,0)>"), "vector-sums")
    first = parts.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if first is None:
        return 0, []
    cells = parts.where(F.col("dim") == first.dim).select(F.posexplode("total").alias("at", "x"))
    sums = cells.groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
    return first.n, [int(r.x) for r in sums]


def _offsets(batch: pa.RecordBatch, n: int, sums: tuple[int, ...], params: WhitenParams) -> np.ndarray:
    """n x - S, exactly: 64-bit numbers where they are large enough, else Python's."""
    x = _whole(batch, len(sums), params)
    if n * (2 * int(np.abs(x).max(initial=1))) + max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _factor(rows: DataFrame, n: int, sums: tuple[int, ...], params: WhitenParams) -> np.ndarray:
    """R with R'R = sum of the outer products of the centred vectors: a factor per task, then factors of factors."""
    dim = len(sums)
    schema = "part bigint, r array<double>"

    def row(part: int, r: np.ndarray) -> pa.RecordBatch:
        full = np.zeros((dim, dim))
        full[: len(r)] = r
        return pa.record_batch({"part": pa.array([part], pa.int64()), "r": pa.array([full.ravel()], pa.list_(pa.float64()))})

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, waiting, held = np.zeros((0, dim)), [], 0
        for batch in batches:
            waiting.append(_offsets(batch, n, sums, params).astype(np.float64) / n)
            held += batch.num_rows
            if held >= max(params.block, 2 * dim):
                r, waiting, held = np.linalg.qr(np.vstack([r, *waiting]), mode="r"), [], 0
        if held:
            r = np.linalg.qr(np.vstack([r, *waiting]), mode="r")
        if len(r):
            yield row(TaskContext.get().partitionId(), r)

    def join(group: pa.Table) -> pa.Table:
        stack = group["r"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        return pa.Table.from_batches([row(group["part"][0].as_py(), np.linalg.qr(stack, mode="r"))])

    fan = max(2, params.factor_bytes // (8 * dim * dim))
    factors = stored(rows.mapInArrow(reduce, schema), "factors")
    while (count := factors.count()) > 1:
        numbered = factors.groupBy("part").agg(F.first("r").alias("r"))
        dealt = numbered.withColumn("part", F.floor(F.col("part") / fan))
        if count <= fan:
            dealt = numbered.withColumn("part", F.lit(0).cast("bigint"))
        factors = stored(dealt.groupBy("part").applyInArrow(join, schema), "factors")
    return np.array(factors.first().r).reshape(dim, dim)


def fit(rows: DataFrame, params: WhitenParams = WhitenParams()) -> Fit | None:
    """Directions of the vectors in ``rows`` (``vec_id``, ``embedding``), or None without any usable vector.

    Only sums and one triangular factor reach the driver; their size follows the length of a vector, not their number.
    """
    good = _usable(rows, params)
    n, sums = _sums(good, params)
    if not n:
        return None
    r = _factor(good.where(F.size("value") == len(sums)), n, tuple(sums), params)
    values, vectors = right_singular(r, params.components)
    total = values.sum()
    return Fit(n, tuple(sums), vectors, values[: len(vectors)] / n, values[: len(vectors)] / (total or 1.0))


def _projected(batch: pa.RecordBatch, found: Fit, params: WhitenParams) -> tuple[np.ndarray, np.ndarray]:
    offsets = _offsets(batch, found.n, found.sums, params)
    return offsets, offsets.astype(np.float64) / found.n @ found.vectors.T / np.sqrt(found.values)


def _identity_error(rows: DataFrame, found: Fit, params: WhitenParams) -> float:
    """Largest entry by which the covariance of the whitened vectors differs from the identity."""
    k = len(found.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            white = _projected(batch, found, params)[1]
            total += np.concatenate((white.sum(axis=0), (white.T @ white).ravel()))
        yield pa.record_batch({"total": pa.array([total], pa.list_(pa.float64()))})

    cells = rows.mapInArrow(run, "total array<double>").select(F.posexplode("total").alias("at", "x"))
    sums = np.array([r.x for r in cells.groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()]) / found.n
    return float(np.abs(sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k]) - np.eye(k)).max())


def whiten(rows: DataFrame, params: WhitenParams = WhitenParams()) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each vector and component of ``rows``.

    Entries become whole numbers x. ``deviation`` is the exact sum of (n x - S) squared, as a decimal; NULL from 10 to the
    power of 38. Components are the unit eigenvectors of the covariance of x, from the largest eigenvalue on; ``whitened`` is
    the centred vector's projection over the square root of it, ``explained`` its share of the trace. There are fewer
    components where the vectors span fewer dimensions, none where all are equal.

    Rows whose vector is null or empty, holds null, NaN, infinite or enormous (``limit``) entries, or isn't of the
    most frequent length are left out. Repeated rows count as often as they are there; a null ``vec_id`` is kept;
    other columns are not read. Without any usable vector there are no rows.
    """
    kind = rows.schema["vec_id"].dataType
    schema = f"vec_id {kind.simpleString()}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    found = fit(rows, params)
    if found is None or not len(found.values):
        return rows.sparkSession.createDataFrame([], schema)
    good = _usable(rows, params).where(F.size("value") == len(found.sums))
    error, k, most = _identity_error(good, found, params), len(found.values), 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimal = pa.decimal128(38, 0)
        for batch in batches:
            offsets, white = _projected(batch, found, params)
            if offsets.dtype != object and int(np.abs(offsets).max(initial=0)) ** 2 * offsets.shape[1] < 1 << 63:
                deviation = pa.array((offsets * offsets).sum(axis=1)).cast(decimal)
            else:
                exact = (offsets.astype(object) ** 2).sum(axis=1)
                deviation = pa.array([Decimal(v) if v < most else None for v in exact], decimal)
            each = pa.array(np.repeat(np.arange(len(white)), k))
            yield pa.record_batch(
                {
                    "vec_id": batch["vec_id"].take(each),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(white))),
                    "n": pa.array(np.full(len(each), found.n, np.int64)),
                    "deviation": deviation.take(each),
                    "whitened": pa.array(white.ravel()),
                    "explained": pa.array(np.tile(found.explained, len(white))),
                    "identity_error": pa.array(np.full(len(each), error)),
                }
            )

    return good.mapInArrow(run, schema)
