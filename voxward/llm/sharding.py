"""Sharding by Karmarkar-Karp differencing: groups of equal texts stay whole, bytes of the shards are nearly equal."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxward.llm.tables import stored


@dataclass(frozen=True)
class ShardParams:
    """``shards`` of equal bytes; a document counts its text and ``extra`` bytes.

    Groups below one part in ``shards * bundles`` of all bytes are joined to as many bundles by hash, so that the number
    of things to place is bounded: two times ``shards * bundles`` at most. Numbers in a shard are given in ``chunks`` at
    most, of ``chunk_rows`` rows at least.
    """

    shards: int = 24
    extra: int = 8
    bundles: int = 256
    chunk_rows: int = 1024
    chunks: int = 65_536

    def __post_init__(self) -> None:
        if min(self.shards, self.bundles, self.chunk_rows, self.chunks) < 1 or self.extra < 0:
            raise ValueError("shards, bundles, chunk_rows and chunks must be positive, extra not negative")


def difference(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item by differencing.

    Each item begins as a partial partition with itself in one shard. The two partial partitions of largest spread are
    combined, the fullest shard of one with the emptiest of the other, until one is left.
    """
    # A partition: what its shards hold, fullest first, and for each the tree of items that were put together.
    heap = [(-size, i, [size] + [0] * (shards - 1), [i] + [None] * (shards - 1)) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, sums, trees = heapq.heappop(heap)
        _, _, other_sums, other_trees = heapq.heappop(heap)
        joined = []
        for place, (a, b, x, y) in enumerate(zip(sums, reversed(other_sums), trees, reversed(other_trees), strict=True)):
            joined.append((-(a + b), place, y if x is None else x if y is None else (x, y)))
        joined.sort(key=lambda j: j[:2])
        sums, trees = [-j[0] for j in joined], [j[2] for j in joined]
        heapq.heappush(heap, (sums[-1] - sums[0], made, sums, trees))
        made += 1
    out = [0] * len(sizes)
    for shard, tree in enumerate(heap[0][3] if heap else ()):
        left = [] if tree is None else [tree]
        while left:
            node = left.pop()
            if isinstance(node, tuple):
                left += node
            else:
                out[node] = shard
    return out


def shard_documents(docs: DataFrame, params: ShardParams = ShardParams()) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` per row of ``docs`` (``doc_id``, ``text``).

    Law ``bytes``: documents with equal texts (null and empty texts are equal) share a shard, and the bytes of the shards
    are as equal as differencing makes them. ``slot`` numbers the rows of a shard from 0 without gaps; ``grown_shard``
    is NULL under this law. Rows that repeat a ``doc_id``, or have none, are rows like others; other columns are
    not read. With fewer groups than shards some shards stay empty; an empty table gives no rows.

    Texts are read once; digests, sizes and ids go on. What differencing places is bounded by the parameters, not by the
    documents: groups that are a noticeable part of all bytes, and bundles of the others. Both the list of large
    groups and the places of items are therefore small enough to broadcast.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + params.extra).cast("bigint").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
        ),
        "sizes",
    )
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("size").cast("decimal(38,0)")), F.lit(0))).first()
    bundles = params.shards * params.bundles
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    # Fewer than ``bundles`` groups can be larger than that part of all bytes.
    large = stored(groups.where(F.col("bytes") > F.lit(int(total) // bundles)).select("digest", F.hex("digest").alias("own")), "large-groups")
    bundle = F.pmod(F.xxhash64("digest"), F.lit(bundles)).cast("string")
    dealt = rows.join(F.broadcast(large), "digest", "left").withColumn("item", F.coalesce("own", bundle))
    items = stored(dealt.groupBy("item").agg(F.sum("size").alias("bytes")), "items")

    def place(group: pa.Table) -> pa.Table:
        pairs = sorted(zip(group["bytes"].to_pylist(), group["item"].to_pylist(), strict=True), reverse=True)
        shards = difference([b for b, _ in pairs], params.shards)
        return pa.table({"item": pa.array([i for _, i in pairs], pa.string()), "shard": pa.array(shards, pa.int32())})

    places = stored(items.withColumn("all", F.lit(True)).groupBy("all").applyInArrow(place, "item string, shard int"), "places")
    chunks = max(1, min(params.chunks, -(-count // params.chunk_rows)))
    sharded = (
        dealt.join(F.broadcast(places), "item")
        .select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(chunks)).alias("chunk"))
    )
    heads = sharded.groupBy("shard", "chunk").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    heads = stored(heads.select("shard", "chunk", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first")), "chunk-heads")
    inside = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "size", "text_crc32"))
    return (
        sharded.withColumn("inside", inside)
        .join(heads, ["shard", "chunk"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("first") + F.col("inside") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
