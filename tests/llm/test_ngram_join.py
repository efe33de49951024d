"""The Jaccard join against comparison of all pairs."""

import random

import pytest

from voxward.llm import ngram_join
from voxward.llm.components import connected_components
from voxward.llm.hashing import PIECE_BYTES, shingle_sets, word_hashes
from voxward.llm.ngram_join import JaccardParams, jaccard_components


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def components(rows, width, percent):
    """Smallest reachable id per id, by comparing all pairs."""
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in root}


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for i in range(n):
        size = rng.choice([1, 2, 3, 4, 5, 6, 8, 12, 40, 150, 400])
        text = " ".join(rng.choice(words) for _ in range(size))
        if rng.random() < 0.3:
            text = f"{text} {passage}"
        rows.append(text)
    for _ in range(n):  # near copies, from exact to far
        words_of = rng.choice(rows[:n]).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            words_of[rng.randrange(len(words_of))] = "X"
        rows.append(" ".join(words_of))
    return list(enumerate(rows, 100))


@pytest.mark.parametrize("width,percent,few,block", [(4, 85, 64, 8192), (5, 80, 2, 3), (1, 50, 1, 2), (3, 100, 64, 8192)])
def test_against_all_pairs(spark, documents, monkeypatch, width, percent, few, block):
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = corpus(width)
    rng = random.Random(9)
    base = " ".join(f"b{k}" for k in range(200)).split()
    for k in range(25):  # a group of near copies of which some are linked only through others
        base[rng.randrange(200)] = f"e{k}"
        rows.append((1000 + k, " ".join(base)))
    got = jaccard_components(documents(rows), JaccardParams(width, percent)).collect()
    want = components(rows, width, percent)
    assert {r.doc_id: r.component_id for r in got} == want
    sizes = {i: len(shingles(t, width)) for i, t in rows}
    assert {r.doc_id: r.n_shingles for r in got} == sizes


def test_nulls_empty_repeated_and_long(spark, documents):
    long = " ".join(f"w{k}" for k in range(300_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "oNE TWO"), (None, "one two"), (6, long), (7, long + " end"), (4, "One two"), (8, "one two three")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(documents(rows)).collect()), key=str)
    n = len(long.split()) - 4
    assert got == sorted(
        [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 4), (None, 1, None), (6, n, 6), (7, n + 1, 6), (8, 1, 8)], key=str
    )
    assert jaccard_components(documents(rows).limit(0)).count() == 0


def test_hashes_do_not_depend_on_the_batch():
    texts = [b"", b"a b", b" x", b"y" * (PIECE_BYTES + 5), b"z " * PIECE_BYTES]
    alone = [word_hashes([t])[0].tolist() for t in texts]
    assert [h.tolist() for h in word_hashes(texts)] == alone
    assert [len(h) for h in alone] == [0, 2, 1, 1, PIECE_BYTES]
    assert len(shingle_sets([b"a b c a b c a b"], 3)[0]) == 3


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(1, 60)] + [(500, k) for k in range(501, 700)] + [(900, 900), (None, 3)]
    rows = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert rows == {k: 1 for k in range(1, 61)} | {k: 500 for k in range(500, 700)}


def test_other_text_of_a_repeated_id_keeps_its_links(documents):
    one, two = (" ".join(f"{p}{k}" for k in range(60)) for p in "ab")
    rows = [(1, one), (2, one), (2, two), (3, two + " more"), (4, "quite another text than all of them")]
    got = {r.doc_id: r.component_id for r in jaccard_components(documents(rows), JaccardParams(4, 85)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}
