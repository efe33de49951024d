"""Embedding dedup against all pairs."""

import numpy as np
import pytest

from voxward.llm.embeddings import CellParams, near_duplicates

SCHEMA = "vec_id bigint, embedding array<float>, label int, rep string, cells string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, "own", None) for i, v, l in rows], SCHEMA).repartition(3)


def exact(rows, cosine):
    """Links and components by all pairs; rows are nodes by id."""
    good = [(i, np.asarray(v, np.float64), l) for i, v, l in rows if i is not None and l is not None and usable(v)]
    links = {i: 0 for i, _, _ in rows}
    root = {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a, l) in enumerate(good):
        for j, b, m in good[:k]:
            if l == m and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i in root}


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


def clustered(seed, n, dim=16, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, dim))
    rows = []
    for i in range(n):
        v = centres[i % 25] + rng.normal(size=dim) * 0.25
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(labels))))
    return rows + [(1000 + i, rows[5][1], rows[5][2]) for i in range(20)]


@pytest.mark.parametrize("block,probes", [(1024, 8), (7, 8), (1, 3)])
def test_recall_and_no_wrong_link(spark, block, probes):
    rows = clustered(block, 400 if block > 1 else 120)
    got = {r.vec_id: r for r in near_duplicates(table(spark, rows), CellParams(block=block, probes=probes)).collect()}
    want = exact(rows, 0.93)
    assert all(got[i].n_links <= want[i][0] and got[i].component_id >= want[i][1] for i in want)
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(n for n, _ in want.values())
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_without_a_sample_there_is_one_cell(spark):
    rows = clustered(2, 150, labels=2)
    got = near_duplicates(table(spark, rows), CellParams(sample=1)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == exact(rows, 0.93)


def test_rows_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, None, 0), (5, [0.0, 0.0], 0), (6, [1.0, None], 0), (7, [nan, 1.0], 0),
        (8, [inf, 1.0], 0), (9, [1.0, 0.0], None), (10, [1.0, 0.0, 0.0], 0), (11, [], 0), (None, [1.0, 0.0], 0), (2, [2.0, 0.0], 0),
    ]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(table(spark, rows)).collect()), key=str)
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, None)]
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), *alone], key=str)
    assert near_duplicates(table(spark, [])).count() == 0
