"""Texts scanned together have the segments they have alone."""

import random

import numpy as np

from voxward.llm.repeats import PIECE, RepeatParams, _joined, _segments


def test_texts_together_as_alone():
    rng = random.Random(4)
    words = [bytes(rng.choice(b"abc ") for _ in range(30)) for _ in range(40)]
    texts = [b"".join(rng.choices(words, k=rng.randrange(0, 40)))[: rng.randrange(0, 900)] for _ in range(300)]
    texts += [b"x" * 100, b"y" * 99, None, b"".join(rng.choices(words, k=(PIECE + 5000) // 30))]
    params = RepeatParams()
    groups = list(_joined(enumerate(texts), params.window))
    long = [(i, t) for i, t in enumerate(texts) if t and len(t) >= params.window]
    assert [x for some in groups for x in some] == long and len(groups) < len(long) / 4
    got = [_segments([t for _, t in some], params) for some in groups]
    want = [_segments([t], params) for _, t in long]
    for c in range(5):
        assert np.array_equal(np.concatenate([g[c] for g in got]), np.concatenate([w[c] for w in want]))
    numbers = [some[n][0] for some, g in zip(groups, got, strict=True) for n in g[5]]
    assert numbers == [i for (i, _), w in zip(long, want, strict=True) for _ in w[0]]
