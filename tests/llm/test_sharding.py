"""Sharding: whole groups, near equal bytes, numbers without gaps, and differencing by itself."""

import itertools
import random
import zlib
from collections import defaultdict

import pytest

from voxward.llm.sharding import ShardParams, difference, shard_documents

COLUMNS = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def table(spark, rows, parts=3):
    schema = "doc_id bigint, text string, size string, shard string, item int, digest string, chunk int"
    return spark.createDataFrame([(i, t, "own", "s", 1, "d", 2) for i, t in rows], schema).repartition(parts)


def check(found, rows, params=ShardParams()):
    got = found.collect()
    assert found.columns == COLUMNS
    want = sorted((-1 if i is None else i, len((t or "").encode()) + params.extra, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, bytes_of, group = defaultdict(list), [0] * params.shards, defaultdict(set)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        bytes_of[r.shard] += r.size
        group[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in group.values())
    return bytes_of


def corpus(seed, n):
    rng = random.Random(seed)
    texts = ["x" * int(rng.paretovariate(1.1) * 20) + str(i) for i in range(n)]
    return [(i, rng.choice(texts)) for i in range(n)]


@pytest.mark.parametrize("params", [ShardParams(), ShardParams(shards=3, bundles=5, chunk_rows=7), ShardParams(shards=7, bundles=1, chunks=2)])
def test_whole_groups_and_near_equal_bytes(spark, params):
    rows = corpus(1, 900)
    sizes = check(shard_documents(table(spark, rows), params), rows, params)
    groups = defaultdict(int)
    for _, t in rows:
        groups[t] += len(t) + 8
    largest = max(groups.values())
    if largest < sum(sizes) / params.shards and params.bundles > 100:
        assert max(sizes) - min(sizes) <= 0.001 * max(sizes)


def test_bytes_are_nearly_equal(spark):
    rng = random.Random(2)
    rows = [(i, "y" * rng.randrange(2000)) for i in range(3000)]
    sizes = check(shard_documents(table(spark, rows)), rows)
    assert max(sizes) - min(sizes) <= 20


def test_a_large_group_is_balanced_by_the_others(spark):
    rows = [(i, "copy" * 50) for i in range(300)] + [(1000 + i, "z" * (i % 97) + str(i)) for i in range(4000)]
    sizes = check(shard_documents(table(spark, rows), ShardParams(shards=4)), rows, ShardParams(shards=4))
    assert max(sizes) - min(sizes) <= 20
    # A group larger than a fair share has its shard to itself, and the others are equal.
    rows = [(i, "copy" * 50) for i in range(3000)] + [(10_000 + i, "z" * (i % 97) + str(i)) for i in range(900)]
    sizes = sorted(check(shard_documents(table(spark, rows), ShardParams(shards=4)), rows, ShardParams(shards=4)))
    assert sizes[-1] == 3000 * 208 and sizes[2] - sizes[0] <= 20


def test_nulls_repeats_and_nothing(spark):
    rows = [(1, None), (2, ""), (3, ""), (4, "a"), (4, "a"), (4, "b"), (None, "c"), (None, None), (5, "é日本" * 9)]
    check(shard_documents(table(spark, rows)), rows)
    assert shard_documents(table(spark, [])).count() == 0
    assert shard_documents(table(spark, [(7, None)])).count() == 1


def test_differencing():
    assert difference([], 3) == [] and difference([5], 2) == [0]
    # The textbook case: 8 7 6 5 4 differ by 2 in the end, where filling greedily leaves 4.
    shards = difference([8, 7, 6, 5, 4], 2)
    sums = [sum(s for s, k in zip([8, 7, 6, 5, 4], shards, strict=True) if k == i) for i in (0, 1)]
    assert sorted(sums) == [14, 16]
    rng = random.Random(3)
    for _ in range(30):
        sizes = [rng.randrange(1, 100) for _ in range(9)]
        sums = [0, 0]
        for size, k in zip(sizes, difference(sizes, 2), strict=True):
            sums[k] += size
        best = min(abs(sum(sizes) - 2 * sum(c)) for r in range(10) for c in itertools.combinations(sizes, r))
        assert best <= abs(sums[0] - sums[1]) <= best + 40
