"""Segments that are trimmed before the suffix array keep all repeats, and lose most of what can't repeat."""

import random

import numpy as np
import pytest

from voxward.llm.repeats import _trimmed
from voxward.llm.suffix_array import repeats


def repeated(data, first, window):
    """Places of windows that occur at an earlier place, over segments at these places."""
    found = repeats(data, window, first)
    return {f + w for f, ws in zip(first.tolist(), found, strict=True) for w in ws.tolist()}


@pytest.mark.parametrize("window,gram", [(100, 40), (20, 8), (7, 7), (9, 1)])
def test_repeats_stay_and_others_go(window, gram):
    rng = random.Random(window)
    widest = window - gram
    data, at = [], []
    for _ in range(40):
        anchor = bytes(rng.choices(b"ACGT", k=gram))
        common = [bytes(rng.choices(b"xyz", k=widest)) for _ in "ab"]
        for _ in range(5):
            # Bytes of their own, then common ones, then the anchor, and the same behind it.
            left, right = (rng.choice([0, widest // 3, widest]) for _ in "ab")
            before = bytes(rng.choices(b"0123456789", k=widest))[: widest - left] + common[0][widest - left :]
            behind = common[1][:right] + bytes(rng.choices(b"0123456789", k=widest - right))
            data.append(before + anchor + behind)
            at.append(widest)
    sizes = np.array([len(d) for d in data])
    starts = np.cumsum(sizes) - sizes
    low, high = np.zeros(len(data), np.int64), np.full(len(data), widest)
    begin, end = _trimmed([starts, sizes, np.array(at), low, high], np.frombuffer(b"".join(data), np.uint8), window)
    assert ((end == 0) | (end - begin >= window)).all() and (end <= sizes).all() and (begin >= 0).all()
    kept = np.flatnonzero(end)
    short = [data[i][begin[i] : end[i]] for i in kept]
    want = repeated(data, starts, window)
    assert want and repeated(short, starts[kept] + begin[kept], window) == want
    if window == 100:
        assert sum(map(len, short)) < 0.7 * sizes.sum()


def test_distances_of_split_segments():
    """Only the distances from low to high are looked at, and segments without any repeat are dropped."""
    data = [b"0123456" + b"ab" + b"CDEFGHI", b"7654321" + b"ab" + b"CDEFGHI", b"XXXXXXX" + b"ab" + b"YYYYYYY"]
    sizes, at = np.full(3, 16), np.full(3, 7)
    raw, starts = np.frombuffer(b"".join(data), np.uint8), np.arange(3) * 16
    begin, end = _trimmed([starts, sizes, at, np.zeros(3, np.int64), np.full(3, 7)], raw, 9)
    assert (begin.tolist(), end.tolist()) == ([7, 7, 0], [16, 16, 0])
    begin, end = _trimmed([starts, sizes, at, np.full(3, 1), np.full(3, 7)], raw, 9)
    assert not end.any() and not begin.any()
