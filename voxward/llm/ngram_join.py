"""N-gram Jaccard join over parity sketches.

A document's set of word shingles is hashed into a sketch of bits: each shingle
flips one bit, so the number of bits in which two sketches differ is at most the
size of the symmetric difference of the two sets. A similarity of t allows a
document with n shingles at most D = n(1-t)/t differences. Sizes fall into bands;
within a band all sketches are cut into the same m > D parts, so at least m - D
parts of two linked documents agree in all bits (pigeonhole). A document needs to
offer only D + 1 of its parts for that if all documents leave out parts by one
common order; here parts with few bits go first and, among equals, those that
most documents share. Candidates from common parts pass a test on the folded
sketch, then the shingle sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxward.llm.components import connected_components
from voxward.llm.hashing import mix, shingle_sets
from voxward.llm.tables import small_side, stored

#: Bits of one part of a sketch; parts are kept as lists of set bits, so their width costs nothing.
PART_BITS = 20
#: Parts are ordered by their number of set bits up to this one.
MOST_BITS = 3
#: Parts with up to FEW members are joined with themselves, larger ones are compared in blocks of BLOCK members.
FEW = 64
BLOCK = 8192

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class JaccardParams:
    """Shingles of ``width`` words; a link needs 100 * intersection >= percent * union."""

    width: int = 5
    percent: int = 80

    def __post_init__(self) -> None:
        if self.width < 1 or not 50 <= self.percent <= 100:
            raise ValueError("width must be positive and percent between 50 and 100")

    def differences(self, n: int) -> int:
        """The most elements in which a set of n elements may differ from a linked one."""
        return (100 - self.percent) * n // self.percent


def _band(n: int) -> int:
    """Bands end at powers of the square root of two."""
    return (n * n).bit_length() - 1


def _parts(band: int, params: JaccardParams) -> int:
    """The number of parts of a band: half as many again as its largest set may have differences."""
    largest = int((2 ** (band + 1)) ** 0.5) + 1
    most = params.differences(largest)
    return max(8, most * 3 // 2 + 2) if most else 1


def _layouts(n: int, params: JaccardParams) -> list[int]:
    """The bands in which a set of n elements meets others: its own and its largest partner's."""
    return list(range(_band(n), _band(n * 100 // params.percent) + 1))


def _signatures(shingles: np.ndarray, band: int, params: JaccardParams) -> tuple[np.ndarray, int, int]:
    """Keys of the parts that a set offers in a band.

    Returns the keys, those of the boundary class first, the size of that
    class, and how many of it may still be left out.
    """
    m = _parts(band, params)
    part = ((shingles >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    cells, times = np.unique((part << np.uint64(PART_BITS)) | (shingles & np.uint64((1 << PART_BITS) - 1)), return_counts=True)
    cells = cells[times % 2 == 1]
    of = (cells >> np.uint64(PART_BITS)).astype(np.int64)
    bits = np.minimum(np.bincount(of, minlength=m), MOST_BITS)
    keys = np.zeros(m, np.uint64)
    if len(cells):
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        keys[of[first]] = np.add.reduceat(mix(cells), first)
    keys = mix(keys + np.arange(m, dtype=np.uint64) * _GOLDEN + np.uint64(band << 48))
    spare = m - params.differences(len(shingles)) - 1
    least = np.partition(bits, spare)[spare]
    low = bits == least
    return np.concatenate((keys[low], keys[bits > least])), int(low.sum()), spare - int((bits < least).sum())


def _fold(shingles: np.ndarray) -> bytes:
    """The sketch folded to some four bits a shingle, a power of two."""
    size = 1 << max(8, (4 * len(shingles) - 1).bit_length())
    flips = np.bincount((shingles >> np.uint64(20)).astype(np.uint64) & np.uint64(size - 1), minlength=size)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little").tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """Bits in which two folded sketches differ; the longer one is folded to the shorter one's length."""
    x, y = (np.frombuffer(v, np.uint64) for v in (a, b))
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _may_link(n_a: int, n_b: int, apart: int, percent: int) -> bool:
    """Whether two sets with at least so many differences can reach the similarity."""
    return apart * (100 + percent) <= (100 - percent) * (n_a + n_b)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(a) + len(b) - common)


def _bytes(column: pa.Array) -> list[bytes]:
    """Lower-cased (A-Z) UTF-8 bytes of a string column, null as empty."""
    return [(v or b"").lower() for v in column.cast(pa.binary()).to_pylist()]


_SKETCH = (
    "doc_id bigint, n bigint, print_a bigint, print_b bigint, fold binary,"
    " layouts array<struct<band: int, n_low: int, spare: int, keys: array<bigint>>>"
)


def sketches(docs: DataFrame, params: JaccardParams) -> DataFrame:
    """One row per document: set size, a 128-bit fingerprint of the set, folded sketch, and part keys by band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows = []
                for shingles in shingle_sets(_bytes(batch.column(1)), params.width):
                    layouts = []
                    for band in _layouts(len(shingles), params) if len(shingles) else []:
                        keys, n_low, spare = _signatures(shingles, band, params)
                        layouts.append({"band": band, "n_low": n_low, "spare": spare, "keys": keys.view(np.int64)})
                    prints = np.array([mix(shingles).sum(), mix(shingles ^ _GOLDEN).sum()], np.uint64).view(np.int64)
                    rows.append((len(shingles), *prints.tolist(), _fold(shingles), layouts))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c, t.type) for c, t in zip(columns, list(schema)[1:], strict=True))],
                    schema=schema,
                )

    layout = pa.struct([("band", pa.int32()), ("n_low", pa.int32()), ("spare", pa.int32()), ("keys", pa.list_(pa.int64()))])
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("print_a", pa.int64()), ("print_b", pa.int64())]
        + [("fold", pa.binary()), ("layouts", pa.list_(layout))]
    )
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, _SKETCH)


def _offered(sketched: DataFrame) -> DataFrame:
    """``doc_id, band, low, spare, key`` for each part that a document offers."""
    return sketched.select("doc_id", F.explode("layouts").alias("l")).select(
        "doc_id", "l.band", "l.n_low", "l.spare", F.posexplode("l.keys").alias("at", "key")
    ).select("doc_id", "band", "spare", (F.col("at") < F.col("n_low")).alias("low"), "key")


def _shared_parts(sketched: DataFrame) -> DataFrame:
    """``key, doc_id``: the parts that at least two documents offer, after each has left out its spare ones."""
    offered = _offered(sketched)
    often = stored(offered.groupBy("key").agg(F.count("*").alias("times")).where("times > 1"), "parts")
    common = offered.join(often, "key")
    # A document's own parts only, so groups are no larger than its set.
    most_shared = Window.partitionBy("doc_id", "band").orderBy(F.col("low").desc(), F.col("times").desc(), "key")
    kept = (
        common.withColumn("rank", F.row_number().over(most_shared))
        .where("NOT low OR rank > spare")
        .select("key", "doc_id")
        .distinct()
    )
    return stored(kept, "kept")


def _with_sketch(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    side = sketched.select("doc_id", "n", "fold")
    for name in ("a", "b"):
        pairs = pairs.join(side.select(F.col("doc_id").alias(name), F.col("n").alias(f"n_{name}"), F.col("fold").alias(f"fold_{name}")), name)
    return pairs


def _near(pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` (with their sketches) whose sketches differ little enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b, fold_a, fold_b = (batch.column(c).to_pylist() for c in range(6))
            near = [_may_link(p, q, _apart(x, y), percent) for p, q, x, y in zip(n_a, n_b, fold_a, fold_b, strict=True)]
            yield pa.RecordBatch.from_pydict(
                {"a": pa.array([v for v, k in zip(a, near, strict=True) if k], pa.int64()),
                 "b": pa.array([v for v, k in zip(b, near, strict=True) if k], pa.int64())}
            )

    return pairs.select("a", "b", "n_a", "n_b", "fold_a", "fold_b").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, docs: DataFrame, params: JaccardParams) -> DataFrame:
    """Those of the stored pairs ``a, b`` whose shingle sets are similar enough; stored."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    texts = stored(docs.select(F.col("doc_id").cast("bigint"), "text").join(small_side(ids), "doc_id", "left_semi"), "texts")
    joined = pairs
    for name in ("a", "b"):
        joined = joined.join(texts.select(F.col("doc_id").alias(name), F.col("text").alias(f"text_{name}")), name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sides = (shingle_sets(_bytes(batch.column(c)), params.width) for c in (2, 3))
                good = pa.array([_linked(x, y, params.percent) for x, y in zip(*sides, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(good)

    return stored(joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint"), "links")


def _crossing(block: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs of different components in one block of a part, or in two, whose sketches differ little enough."""
    folds = [np.frombuffer(v, np.uint64) for v in block["fold"]]
    size = min(map(len, folds))
    bits = np.stack([np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in folds])
    n, ids, component = (block[c].to_numpy() for c in ("n", "doc_id", "component"))
    first, second = (np.flatnonzero(block["side"].to_numpy() == side) for side in (0, 1))
    if block["i"].iloc[0] == block["j"].iloc[0]:
        second = first  # a block with itself is sent once
    found = [np.empty((2, 0), np.int64)]
    for i in first:
        apart = np.bitwise_count(bits[i] ^ bits[second]).sum(axis=1, dtype=np.int64)
        near = (apart * (100 + percent) <= (100 - percent) * (n[i] + n[second])) & (component[second] != component[i])
        if near.any():
            other = ids[second[near]]
            found.append(np.stack((np.maximum(ids[i], other), np.minimum(ids[i], other))))
    a, b = np.unique(np.concatenate(found, axis=1), axis=1)
    return pd.DataFrame({"a": a, "b": b})


def _left_over(kept: DataFrame, sketched: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """Pairs that share a part but are still in different components, sketches compared.

    Parts with up to FEW members are joined with themselves; larger ones are
    dealt into blocks and compared block by block, so no task holds a whole
    part.
    """
    labelled = stored(
        kept.join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .withColumn("component", F.coalesce("component", "doc_id")),
        "labelled",
    )
    mixed = stored(
        labelled.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"))
        .where("low != high")
        .select("key", "members"),
        "mixed",
    )
    open_rows = stored(labelled.join(mixed, "key"), "open")
    few = open_rows.where(F.col("members") <= FEW).select("key", "doc_id", "component")
    other = few.select("key", F.col("doc_id").alias("b"), F.col("component").alias("other"))
    pairs = (
        few.withColumnRenamed("doc_id", "a").join(other, "key").where("a > b AND component != other").select("a", "b").distinct()
    )
    near = _near(_with_sketch(pairs, sketched), percent)

    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = (
        open_rows.where(F.col("members") > FEW)
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
        .join(sketched.select("doc_id", "n", "fold"), "doc_id")
    )
    sides = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda j: F.struct(
            F.least("block", j).alias("i"), F.greatest("block", j).alias("j"), (j < F.col("block")).cast("int").alias("side")
        ),
    )
    many = (
        dealt.withColumn("s", F.explode(sides))
        .select("key", "s.i", "s.j", "s.side", "doc_id", "component", "n", "fold")
        .groupBy("key", "i", "j")
        .applyInPandas(lambda block: _crossing(block, percent), "a bigint, b bigint")
    )
    return near.union(many).distinct()


def jaccard_components(docs: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs`` (``doc_id``, ``text``).

    Documents link when the Jaccard similarity of their shingle sets reaches
    the limit; ``component_id`` is the smallest ``doc_id`` reachable by links. Words
    are runs other than ASCII white space, A-Z lower-cased; shingles are
    compared by 64-bit hashes.

    Equal sets are joined by fingerprint first and go on as one document.
    Each shared part links its members to the smallest one, verified; only
    members of different components are compared further, until no pair with a
    common part is left open. So the result is exact, while groups of copies
    cost their size and not its square.

    Null or empty texts have no shingles, link with nothing, and are their own
    component. Rows with a null ``doc_id`` come back with a null component. Rows that
    repeat a ``doc_id`` count as one node with the links of all of them, and come
    back once each. Columns other than ``doc_id`` and ``text`` are not read. An
    empty table gives no rows.
    """
    sketched = stored(sketches(docs, params), "sketches")
    prints = ["n", "print_a", "print_b"]
    known = sketched.where("doc_id IS NOT NULL AND n > 0")
    copies = stored(
        known.groupBy(prints).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("times")).where("times > 1").drop("times"),
        "copies",
    )
    rest = stored(known.select("doc_id", *prints).join(copies, prints).where("doc_id != first_id").select("doc_id", "first_id", *prints), "rest")
    # By fingerprint too: another row of that doc_id may hold another text.
    singles = known.join(small_side(rest.select("doc_id", *prints)), ["doc_id", *prints], "left_anti")

    kept = _shared_parts(singles)
    lowest = stored(kept.groupBy("key").agg(F.min("doc_id").alias("b"), F.count("*").alias("times")).where("times > 1"), "lowest")
    stars = kept.join(lowest, "key").where("doc_id != b").select(F.col("doc_id").alias("a"), "b").distinct()
    tried = stored(_near(_with_sketch(stars, sketched), params.percent), "stars")
    links = _verified(tried, docs, params)
    components = stored(connected_components(links), "components")
    more = stored(_left_over(kept, sketched, components, params.percent).join(tried, ["a", "b"], "left_anti"), "more")
    links = links.union(_verified(more, docs, params)).union(rest.select(F.col("doc_id").alias("a"), F.col("first_id").alias("b")))
    components = stored(connected_components(links), "components")
    return (
        sketched.select("doc_id", F.col("n").alias("n_shingles"))
        .join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )
