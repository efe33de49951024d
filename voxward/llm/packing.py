"""Best-fit packing with exact-complement hashing.

Only the number of pieces of each length decides which lengths share a sequence,
so the plan is made from a table of at most ``capacity`` counts: combinations of
one, two or three lengths that fill a gap exactly are looked up by their sum and
used as often as all their counts allow, what remains is placed best fit,
longest first. Then every piece takes its place by its rank among the pieces of
its length, which is counted in buckets, so no length is gathered in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxward.llm.encoding import WORDS_KEPT, encoder, public_path
from voxward.llm.tables import stored

#: Pieces of one length are ranked in buckets of about this many.
BUCKET_ROWS = 100_000


@dataclass(frozen=True)
class PackParams:
    """Tokens in a sequence, the id that ends each document, and the vocabulary file (a path, or a public name).

    ``words_kept`` trades a worker's memory for speed (400 bytes a word).
    """

    capacity: int = 1024
    end_id: int = 2
    vocabulary: str = "byte_bpe_50k.json"
    words_kept: int = WORDS_KEPT

    def __post_init__(self) -> None:
        if self.capacity < 1:
            raise ValueError("capacity must be positive")

    def path(self) -> str:
        return self.vocabulary if "/" in self.vocabulary else public_path(self.vocabulary)


def pieces(docs: DataFrame, params: PackParams = PackParams(), keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every document's tokens; stored.

    A document is its ids and the end id. Only those longer than a sequence
    are cut, into full pieces from the end; the first piece takes the rest. Null
    and empty texts have the end id alone. Repeated rows give repeated pieces.
    """
    path, capacity, end = params.path(), params.capacity, np.array([params.end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, params.words_kept, added=True).encode
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = encode(text) + end
                    n = len(ids) // 4
                    bounds = [0, *range(n - capacity * ((n - 1) // capacity), n, capacity), n]
                    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                        part = ids[4 * a : 4 * b]
                        rows.append((doc_id, k, a, b - a, zlib.crc32(part), part)[: len(schema)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
                )

    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32())] + [(c, pa.int64()) for c in ("start", "length", "ids_crc32")]
        + [("ids", pa.binary())] * keep_ids
    )
    shape = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids
    return stored(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, shape), "pieces")


class _Counts:
    """Pieces left of each length, with look-up of combinations by their sum."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n

    def single(self, total: int) -> tuple[int, ...] | None:
        return (total,) if total > 0 and self.left[total] else None

    def pair(self, total: int) -> tuple[int, ...] | None:
        """The pair of lengths with this sum whose longer one is longest."""
        if total < 2:
            return None
        low = np.arange(1, total // 2 + 1)
        good = (self.left[low] > 0) & (self.left[total - low] > (low == total - low))
        return (int(total - low[good.argmax()]), int(low[good.argmax()])) if good.any() else None

    def triple(self, total: int) -> tuple[int, ...] | None:
        for first in np.flatnonzero(self.left[: max(0, total - 1)])[::-1].tolist():
            self.left[first] -= 1
            pair = self.pair(total - first)
            self.left[first] += 1
            if pair:
                return (first, *pair)
        return None

    def take(self, lengths: tuple[int, ...]) -> int:
        """Use a combination as often as it goes."""
        kinds, times = np.unique(lengths, return_counts=True)
        n = int((self.left[kinds] // times).min())
        self.left[kinds] -= n * times
        return n


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Kinds of sequences: (length, how often in the sequence) in order, and how many such sequences.

    Their number is bounded by the number of lengths, not by the number of
    pieces: each step uses up a length or a kind.
    """
    state, full, kinds = _Counts(counts, capacity), [], []
    if state.left[capacity]:
        full.append(([(capacity, 1)], int(state.left[capacity])))
        state.left[capacity] = 0
    for find in (state.single, state.pair, state.triple):
        for length in range(capacity - 1, 0, -1):
            while state.left[length]:
                state.left[length] -= 1
                others = find(capacity - length)
                state.left[length] += 1
                if not others:
                    break
                n = state.take((length, *others))
                kinds.append((_runs((length, *others)), n))
    return full + _with_rest(kinds, state.left, capacity)


def _with_rest(kinds: list, left: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """The exact kinds and best-fit ones for what is left.

    Exact fills can use up the small pieces that large leftovers need. While
    there are more sequences than the total length asks for, the last of the
    exact kinds are given back, in growing shares, and the best of these plans
    is taken.
    """
    best, fewest = None, None
    for share in (0, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1):
        keep = len(kinds) - round(share * len(kinds))
        rest = left.copy()
        for content, size in kinds[keep:]:
            for length, times in content:
                rest[length] += times * size
        made = _best_fit(rest, capacity)
        n = sum(size for _, size in kinds[:keep] + made)
        if fewest is None or n < fewest:
            best, fewest = kinds[:keep] + made, n
        total = sum(size for _, size in kinds[:keep]) + -(-int(rest @ np.arange(capacity + 1)) // capacity)
        if n == total:
            break
    return best


def _runs(lengths: tuple[int, ...]) -> list[tuple[int, int]]:
    return [(length, lengths.count(length)) for length in sorted(set(lengths), reverse=True)]


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Longest first, each into the fullest sequences that still have room."""
    bins: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            gap = min((g for g, groups in bins.items() if g >= length and groups), default=capacity)
            groups = bins.get(gap)
            if groups:
                content, size = groups.pop()
            else:
                content, size = [], n
            if n < size:
                groups.append((content, size - n)) if content else None
                size = n
            times = max(1, min(gap // length, n // size))
            if not content:
                # New sequences: as many as these pieces fill.
                times = min(gap // length, n)
                size = n // times
            bins.setdefault(gap - times * length, []).append(([*content, (length, times)], size))
            n -= size * times
    return [group for groups in bins.values() for group in groups]


def slots(kinds: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """``length, first rank, end rank, first sequence, times, offset``: where the pieces of a length go by rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for content, size in kinds:
        offset = 0
        for length, times in content:
            first = used.get(length, 0)
            used[length] = first + size * times
            rows.append((length, first, used[length], sequence, times, offset))
            offset += length * times
        sequence += size
    return rows


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """``items`` (stored, with a ``length``) with ``sequence_id`` and ``offset``.

    Lengths must lie between 1 and ``capacity``; rows with others, or null, get
    nulls. Each sequence is filled from offset 0 without gaps. Equal rows get
    different places. Columns ``sequence_id`` and ``offset`` of ``items`` are replaced.
    """
    spark = items.sparkSession
    items = items.drop("sequence_id", "offset")
    names = items.columns
    fits = F.col("length").between(1, capacity)
    good = items.where(fits)
    buckets = max(1, good.count() // BUCKET_ROWS)
    bucket = F.pmod(F.xxhash64(*(c for c in names if c != "ids")), F.lit(buckets)).cast("int")
    dealt = good.withColumn("_bucket", bucket)
    sizes = stored(dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n")), "lengths")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).toLocalIterator()}
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    places = spark.createDataFrame(
        slots(plan(counts, capacity)),
        "_length bigint, _first bigint, _end bigint, _sequence bigint, _times bigint, _offset bigint",
    )
    order = Window.partitionBy("length", "_bucket").orderBy(*(c for c in names if c not in ("length", "ids")))
    rank = F.col("_rank") - F.col("_first")
    ranked = (
        dealt.withColumn("_row", F.row_number().over(order) - 1)
        .join(starts, ["length", "_bucket"])
        .withColumn("_rank", F.col("_row") + F.col("_before"))
    )
    # The slots are no more than a small multiple of the capacity.
    placed = ranked.join(
        F.broadcast(places),
        (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")),
    ).select(
        *names,
        (F.col("_sequence") + F.floor(rank / F.col("_times"))).alias("sequence_id"),
        (F.col("_offset") + rank % F.col("_times") * F.col("length")).alias("offset"),
    )
    nothing = F.lit(None).cast("bigint")
    return placed.union(items.where(~F.coalesce(fits, F.lit(False))).select(*names, nothing, nothing))


def pack_documents(docs: DataFrame, params: PackParams = PackParams(), keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents with the sequence and offset of each."""
    return pack(pieces(docs, params, keep_ids), params.capacity)
