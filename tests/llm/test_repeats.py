"""Suffix arrays and substring dedup against plain search."""

import hashlib
import random

import numpy as np
import pytest

from voxward.llm.repeats import RepeatParams, remove_repeats
from voxward.llm.suffix_array import joined, permuted_lcp, repeats, suffix_array


def plain(rows, window):
    """Removed places by id: windows seen earlier, in order of id and place."""
    seen, gone = set(), {}
    for i, data in sorted(rows):
        gone.setdefault(i, set())
        for p in range(len(data) - window + 1):
            piece = data[p : p + window]
            if piece in seen:
                gone[i] |= set(range(p, p + window))
            seen.add(piece)
    return gone


def texts(seed):
    rng = random.Random(seed)
    rows = []
    passage = "".join(rng.choice("abcdé ") for _ in range(90))
    for i in range(40):
        text = "".join(rng.choice("abcdé \n") for _ in range(rng.choice([0, 5, 19, 20, 60, 400])))
        kind = rng.random()
        if kind < 0.3:
            text += passage + text[:30]
        elif kind < 0.4:
            text += "ab" * 70
        elif kind < 0.6 and rows:
            text = rows[-1][1][: rng.randrange(200)] + "#" + text
        rows.append((i * 3, text))
    return rows


def test_suffix_array_is_sorted():
    rng = random.Random(3)
    for alphabet in (b"a", b"ab", b"abc\x00\xff", bytes(range(256))):
        data = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(9)]
        text, _ = joined(data)
        array = suffix_array(text)
        assert array.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        before, common = permuted_lcp(text, array)
        for a, b in zip(array[1:].tolist(), array[:-1].tolist(), strict=True):
            n = next((k for k, (x, y) in enumerate(zip(text[a:].tolist(), text[b:].tolist())) if x != y or x <= 1), 0)
            assert (before[a], common[a]) == (b, n)
        # Stops as symbols of their own, in order of their places but for the last one, which stands before the end.
        array = suffix_array(text, stops_apart=True)
        before, common = permuted_lcp(text, array)
        prefix = [text[i : i + np.flatnonzero(text[i:] <= 1)[0]].tolist() for i in range(len(text))]
        assert [prefix[i] for i in array] == sorted(prefix)
        for a, b in zip(array[1:].tolist(), array[:-1].tolist(), strict=True):
            n = next((k for k, (x, y) in enumerate(zip(prefix[a], prefix[b])) if x != y), min(len(prefix[a]), len(prefix[b])))
            assert (before[a], common[a]) == (b, n)


@pytest.mark.parametrize("window", [3, 8, 20])
def test_repeats_of_strings(window):
    rng = random.Random(window)
    data = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(60))) for _ in range(20)] + [b"a" * 100]
    seen, want = set(), []
    for s in data:
        starts = []
        for i in range(len(s) - window + 1):
            if s[i : i + window] in seen:
                starts.append(i)
            seen.add(s[i : i + window])
        want.append(starts)
    assert [list(map(int, r)) for r in repeats(data, window)] == want


@pytest.mark.parametrize("gram,most", [(8, 10_000), (20, 10_000), (5, 1), (1, 3)])
def test_against_plain_search(documents, gram, most):
    rows = texts(gram)
    params = RepeatParams(window=20, gram=gram, shard_bytes=500, most_segments=most)
    got = remove_repeats(documents(rows), params).collect()
    gone = plain([(i, t.encode()) for i, t in rows], 20)
    assert len(got) == len(rows) and any(gone.values())
    for r in got:
        data = dict(rows)[r.doc_id].encode()
        keep = bytes(b for p, b in enumerate(data) if p not in gone[r.doc_id])
        cover = np.array([p in gone[r.doc_id] for p in range(len(data))], int)
        spans = int((np.diff(cover, prepend=0) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (
            len(data), len(gone[r.doc_id]), spans, hashlib.sha256(keep).hexdigest()
        )
        assert r.text == keep.decode(errors="ignore") and r.n_chars == len(r.text) and r.n_words == "own"


def test_nulls_empty_repeated_and_long(documents):
    long = "".join(random.Random(1).choices("abcdefgh ", k=1_200_000))
    rows = [(1, None), (2, ""), (None, "x" * 300), (3, long), (3, long), (4, "y" + long), (5, "x" * 101)]
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans, r.text is None) for r in remove_repeats(documents(rows)).collect()}
    n = len(long)
    assert got == {
        (1, 0): (0, 0, True), (2, 0): (0, 0, False), (None, 300): (0, 0, False), (3, n): (0, 0, False), (4, n + 1): (n, 1, False),
        (5, 101): (100, 1, False),
    }
    assert remove_repeats(documents(rows).limit(0)).count() == 0
