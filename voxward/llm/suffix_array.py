"""Suffix arrays by induced sorting, with NumPy.

Works on bytes with separators. Suffixes of type S are smaller than their right
neighbour, those of type L larger; a leftmost S suffix (LMS) follows an L. LMS
substrings are sorted by one induction and named; where names repeat, their
string is sorted in the same way, recursively; and from the sorted LMS suffixes
a second induction sorts all. An induction goes through the buckets of first
symbols once from each end and moves a whole bucket at a time, so names are
written as two digits each, which keeps the buckets few.
"""

from __future__ import annotations

import numpy as np

#: Symbols: 0 ends the whole text, 1 ends a string, a byte b is b + 2.
END, STOP, SHIFT = 0, 1, 2
#: Waves of fewer suffixes are dealt with as few calls as possible.
SMALL = 256


def joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The strings as one array of symbols, each followed by a stop; and where each begins."""
    raw = np.frombuffer(b"\0".join(strings) + b"\0\0", np.uint8)
    lengths = np.array([len(s) + 1 for s in strings], np.int64)
    starts = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))
    text = raw.astype(np.uint16) + SHIFT
    text[starts[1:] - 1] = STOP
    text[-1] = END
    return text, starts[:-1]


def _smaller_types(text: np.ndarray) -> np.ndarray:
    """True for suffixes that are smaller than the one that starts right after."""
    n = len(text)
    differs = np.flatnonzero(np.append(text[:-1] != text[1:], True))
    at = differs[np.searchsorted(differs, np.arange(n))]
    types = np.ones(n, bool)
    inner = at < n - 1
    types[inner] = text[at[inner]] < text[at[inner] + 1]
    return types


def _deal(array: np.ndarray, at: np.ndarray, suffixes: np.ndarray, text: np.ndarray, step: int) -> None:
    """Put suffixes, in their order, into the buckets of their first symbols from ``at`` on."""
    n = len(suffixes)
    if not n:
        return
    symbols = text[suffixes]
    order = symbols.argsort(kind="stable")
    symbols = symbols[order]
    # The first place of each run, less its offset in the wave. Most waves are small, and calls cost more than work there.
    if n < SMALL:
        places = symbols.searchsorted(symbols)
    else:
        begins = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
        places = begins.repeat(np.diff(begins, append=n))
    if step > 0:
        np.subtract(np.arange(n), places, out=places)
    else:
        places -= np.arange(n)
    places += at[symbols]
    array[places] = suffixes[order]
    places += step
    # The last of a run counts.
    at[symbols] = places


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that follows from LMS suffixes in the given order."""
    sizes = np.bincount(text)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    array = np.full(len(text), -1, np.int64)
    tails = ends - 1
    _deal(array, tails, lms[::-1], text, -1)

    # What comes before the first suffix is read as the end, which is of neither type here.
    large, small = ~small, small.copy()
    small[-1] = False
    used = np.flatnonzero(sizes).tolist()
    heads = begins.copy()
    bounds = list(zip(begins.tolist(), ends.tolist(), strict=True))
    for c in used:
        done, end = bounds[c]
        while done < heads[c]:
            before, done = array[done : heads[c]] - 1, heads[c]
            _deal(array, heads, before[large[before]], text, 1)
        if tails[c] + 1 < end:
            before = array[tails[c] + 1 : end] - 1
            _deal(array, heads, before[large[before]], text, 1)

    tails = ends - 1
    for c in reversed(used):
        begin, done = bounds[c][0], bounds[c][1] - 1
        while done > tails[c]:
            before, done = array[tails[c] + 1 : done + 1][::-1] - 1, tails[c]
            _deal(array, tails, before[small[before]], text, -1)
        if begin < heads[c]:
            before = array[begin : heads[c]][::-1] - 1
            _deal(array, tails, before[small[before]], text, -1)
    return array


def _names(text: np.ndarray, sorted_lms: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Ranks of the LMS substrings, in text order; equal substrings have one rank."""
    length = np.zeros(len(text), np.int64)
    length[lms] = np.append(np.diff(lms), 0) + 1
    a, b = sorted_lms[:-1], sorted_lms[1:]
    same = length[a] == length[b]
    active = np.flatnonzero(same)
    k = 0
    while len(active):
        differ = text[a[active] + k] != text[b[active] + k]
        same[active[differ]] = False
        k += 1
        active = active[~differ]
        active = active[length[a[active]] > k]
    rank = np.zeros(len(text), np.int64)
    rank[sorted_lms] = np.concatenate(([0], np.cumsum(~same)))
    return rank[lms]


def _order(names: np.ndarray, longest: int) -> np.ndarray:
    """The order of the suffixes of a string of names, which ends in its only 0, by induced sorting.

    A name that is there once tells its suffix from all others, so what follows
    it is left out, but for the starts of repeated names and the one name after them.
    """
    alone = np.bincount(names)[names] == 1
    if alone.all():
        return names.argsort()
    kept = ~alone
    kept[1:] |= ~alone[:-1]
    kept[-1] = True
    part = names[kept]
    used = np.zeros(names.max() + 1, np.int64)
    used[part] = 1
    part = (np.cumsum(used) - 1)[part]
    rank = np.empty(len(part), np.int64)
    rank[_order_of_all(part, longest)] = np.arange(len(part))
    keys = names * len(names)
    keys[kept] += rank
    return keys.argsort()


def _order_of_all(names: np.ndarray, longest: int) -> np.ndarray:
    """The order of all suffixes of a string of names.

    A string of two digits for each name has the order of the names' suffixes
    in its even places. It has few symbols. Where it would be as long as
    ``longest`` the names themselves, at most half as many as the symbols they
    stand for, are the string, so that each is shorter than the last.
    """
    base = int(np.ceil(np.sqrt(names.max() + 1)))
    if base <= 16 or 2 * len(names) >= longest:
        return suffix_array(names)
    digits = np.zeros(2 * len(names) + 1, np.uint16)  # which NumPy sorts by radix
    digits[:-1:2], digits[1::2] = names // base + 1, names % base + 1
    array = suffix_array(digits)
    return array[(array & 1 == 0) & (array < 2 * len(names))] >> 1


def suffix_array(text: np.ndarray, stops_apart: bool = False) -> np.ndarray:
    """Starts of all suffixes in ascending order; the last symbol must be the only END.

    With ``stops_apart`` a stop is smaller than a later one, as if each were a
    symbol of its own, so that no comparison goes on behind a string's end.
    """
    small = _smaller_types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(lms):  # the end alone
        return np.arange(len(text))[::-1].copy()
    first = _induce(text, small, lms)
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    names = _names(text, first[is_lms[first]], lms)
    if stops_apart and (stop := text[lms] == STOP).any():
        # The names of what begins with a stop come first after the end's.
        n = np.count_nonzero(stop)
        names[names > 0] += n - names[stop].max()
        names[stop] = np.arange(1, n + 1)
    return _induce(text, small, lms[_order(names, len(text) * 9 // 10)])


def permuted_lcp(text: np.ndarray, array: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, in text order, its predecessor in the array and how many symbols both begin with.

    Prefixes end at stops. Only where the predecessor is not the left
    neighbour's moved by one, symbols are compared; elsewhere the length is
    one less than there.
    """
    n = len(text)
    before = np.full(n, n - 1, np.int64)
    before[array[1:]] = array[:-1]
    stops = np.flatnonzero(text <= STOP)
    room = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)
    fresh = np.concatenate(([True], (before[1:] != before[:-1] + 1) | (text[:-1] <= STOP)))
    i = np.flatnonzero(fresh)
    j = before[i]
    most = np.minimum(room[i], room[j])
    length = np.zeros(len(i), np.int64)
    wide = np.zeros(n + 8, np.uint64)
    for k in range(4):
        wide[:n] |= np.concatenate((text[k:], np.zeros(k, np.uint16))).astype(np.uint64) << np.uint64(16 * k)
    active = np.flatnonzero(most > 0)
    while len(active):
        at = length[active]
        equal = wide[i[active] + at] == wide[j[active] + at]
        ended = active[~equal]
        for k in range(4):
            go = (length[ended] < most[ended]) & (text[np.minimum(i[ended] + length[ended], n - 1)] == text[np.minimum(j[ended] + length[ended], n - 1)])
            length[ended] += go
            ended = ended[go]
        active = active[equal]
        length[active] += 4
        active = active[length[active] < most[active]]
    length = np.minimum(length, most)
    source = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    full = np.zeros(n, np.int64)
    full[i] = length
    return before, np.maximum(full[source] - (np.arange(n) - source), 0)


def repeats(strings: list[bytes], window: int, places: np.ndarray | None = None) -> list[np.ndarray]:
    """For each string the starts of windows that also occur at an earlier place.

    ``places`` are the strings' own, ascending numbers, by which a window at an
    offset is at the sum of both; equal places are one. By default the strings
    follow each other.
    """
    text, starts = joined(strings)
    array = suffix_array(text, stops_apart=True)
    _, common = permuted_lcp(text, array)
    group = np.cumsum(common[array] < window)
    place = np.arange(len(text))
    if places is not None and len(places):
        place += np.repeat(places - starts, np.diff(np.append(starts, len(text))))
    first = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, group, place[array])
    again = np.zeros(len(text), bool)
    again[array] = first[group] < place[array]
    marked = np.flatnonzero(again)
    cut = np.searchsorted(marked, starts[1:])
    return [part - start for part, start in zip(np.split(marked, cut), starts, strict=True)]
