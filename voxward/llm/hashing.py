"""64-bit hashes of words and word shingles, computed over whole batches of texts with NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are hashed in pieces of about this many bytes, cut at white space.
PIECE_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + 4096)
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers


def _pieces(data: bytes) -> Iterator[bytes]:
    """Pieces of about PIECE_BYTES that end at white space, so that no word is cut."""
    at = 0
    while len(data) - at > PIECE_BYTES:
        window = np.frombuffer(data, np.uint8, offset=at + PIECE_BYTES)
        end, step = None, 0
        while step < len(window):
            found = np.flatnonzero(_SPACE[window[step : step + 65536]])
            if len(found):
                end = at + PIECE_BYTES + step + int(found[0])
                break
            step += 65536
        if end is None:
            break
        yield data[at:end]
        at = end
    yield data[at:]


def _hash_piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _power_tables(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * power[: len(raw)])))
    return starts, mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the hashes of its words, the runs of bytes other than ASCII white space.

    Short texts are hashed together, long ones in pieces, so memory follows
    PIECE_BYTES and not the longest text.
    """
    out: list[np.ndarray | None] = [None] * len(texts)
    group: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            ends = np.cumsum([len(texts[i]) + 1 for i in group])
            starts, hashes = _hash_piece(b" ".join([texts[i] for i in group]))
            for i, part in zip(group, np.split(hashes, np.searchsorted(starts, ends[:-1])), strict=True):
                out[i] = part
            group.clear()
            size = 0

    for i, text in enumerate(texts):
        if len(text) > PIECE_BYTES:
            out[i] = np.concatenate([_hash_piece(p)[1] for p in _pieces(text)])
            continue
        if size + len(text) > PIECE_BYTES:
            flush()
        group.append(i)
        size += len(text) + 1
    flush()
    return out


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    A text with fewer words has its whole sequence as the only shingle, a text
    without words has none.
    """
    sets = []
    for words in word_hashes(texts):
        n = len(words)
        k = min(n, width)
        if n == 0:
            sets.append(words)
            continue
        folded = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            folded = mix(folded * _BASE + words[i : n - k + 1 + i])
        sets.append(np.unique(folded))
    return sets
