"""Phrase collocations: n-grams counted in burst tries, whole subtrees spilled as sorted runs, runs merged by ranges of phrases."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxward.llm.tables import stored

#: Bits of a word id; three ids make one code. Id 0 ends a piece.
BITS = 21
_MASK = (1 << BITS) - 1
_REST = (1 << 2 * BITS) - 1

_BREAKS = b".,;:!?\n\v\f\r"
_FOLD = bytes.maketrans(bytes(range(65, 91)) + _BREAKS, bytes(range(97, 123)) + b"." * len(_BREAKS))
_CUT = re.compile(rb"[ \t.,;:!?\n-\r]")


def _as_text(keys: pa.Array) -> pa.Array:
    """Bytes as strings; what isn't valid UTF-8 stays as it came."""
    return pc.cast(keys, options=pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True))


@dataclass(frozen=True)
class PhraseParams:
    """Phrases of 2 to ``max_words`` (2 or 3) words seen ``min_count`` times or more; the best ``top`` of each language.

    A phrase goes if a longer one that holds it has at least ``covered`` percent of its count. The others say how
    tasks work: entries of a container before it bursts, entries a task holds before it spills, words before their
    numbers start anew, bytes of text taken at once, bytes of text for each range of phrases and the most ranges, documents
    that the ranges are taken from, rows merged at once, rows that one task ranks.
    """

    min_count: int = 10
    covered: int = 50
    top: int = 2000
    max_words: int = 3
    burst: int = 4096
    held: int = 1 << 19
    words: int = 1 << 20
    piece_bytes: int = 1 << 20
    range_bytes: int = 12 << 20
    ranges: int = 50_000
    sample: int = 500
    merge_rows: int = 1 << 17
    ranked: int = 20_000

    def __post_init__(self) -> None:
        if self.max_words not in (2, 3):
            raise ValueError("max_words is 2 or 3")
        if min(self.min_count, self.top, self.burst, self.held, self.words, self.piece_bytes, self.range_bytes, self.ranges, self.sample, self.merge_rows) < 1 or self.words + self.piece_bytes // 2 > _MASK - 2:
            raise ValueError("counts and sizes must be positive, and words and half of piece_bytes together below 2 to the power of 21")
        if self.ranked < 4 * self.top:
            raise ValueError("ranked must be at least four times top")


class _Numbers(dict):
    """Words and their numbers, given in the order in which words come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _tokens(text: bytes) -> list[bytes]:
    """Words, with a point wherever a piece ends."""
    return text.translate(_FOLD).replace(b".", b" . ").split()


class BurstTrie:
    """Counts of word triples: a shallow trie of word numbers over hash containers.

    A first word leads to one container, keyed by codes of three words. A container with more than ``burst`` entries
    becomes a node with a container for each second word.
    """

    def __init__(self, burst: int):
        self.burst = burst
        self.root: dict[int, dict] = {}
        self.nodes: set[int] = set()
        self.sizes: dict[int, int] = {}

    def add(self, codes: np.ndarray, counts: np.ndarray) -> int:
        """Add sorted distinct codes; gives the number of new entries."""
        first = codes >> (2 * BITS)
        edges = np.flatnonzero(np.diff(first, prepend=-1))
        words, edges = first[edges].tolist(), [*edges.tolist(), len(codes)]
        codes, counts = codes.tolist(), counts.tolist()
        root, sizes, nodes, grown = self.root, self.sizes, self.nodes, 0
        for word, start, end in zip(words, edges, edges[1:], strict=False):
            box = root.get(word)
            if box is None:
                box = root[word] = dict(zip(codes[start:end], counts[start:end], strict=True))
                size = end - start
                grown += size
            elif word in nodes:
                size = sizes[word]
                for code, n in zip(codes[start:end], counts[start:end], strict=True):
                    leaf = box.setdefault(code >> BITS, {})
                    if code in leaf:
                        leaf[code] += n
                    else:
                        leaf[code] = n
                        size += 1
                grown += size - sizes[word]
            else:
                for code, n in zip(codes[start:end], counts[start:end], strict=True):
                    box[code] = box[code] + n if code in box else n
                size = len(box)
                grown += size - sizes[word]
            sizes[word] = size
            if size > self.burst and word not in nodes:
                self._split(word)
        return grown

    def _split(self, word: int) -> None:
        node: dict[int, dict[int, int]] = {}
        for code, n in self.root[word].items():
            node.setdefault(code >> BITS, {})[code] = n
        self.root[word] = node
        self.nodes.add(word)

    def take(self, words: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Codes and counts of whole subtrees, which leave the trie."""
        codes: list[int] = []
        counts: list[int] = []
        for word in words:
            box = self.root.pop(word)
            del self.sizes[word]
            if word in self.nodes:
                self.nodes.remove(word)
                for leaf in box.values():
                    codes.extend(leaf)
                    counts.extend(leaf.values())
            else:
                codes.extend(box)
                counts.extend(box.values())
        return np.array(codes, np.int64), np.array(counts, np.int64)


class _Counter:
    """Counts of one task: numbers of words, a trie for each language, and the runs it spills into ``ranges``."""

    def __init__(self, params: PhraseParams, ranges: list[tuple[bytes, ...]]):
        self.params, self.ranges = params, ranges
        self.tries: dict[str, BurstTrie] = {}
        self.pending: dict[str, list[np.ndarray]] = {}
        self.waiting = self.held = 0
        self._forget()

    def _forget(self) -> None:
        self.ids = _Numbers({b".": 0})

    def text(self, lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
        """Count a text. Long ones go in parts; the last two words of a part begin the next."""
        at, tail = 0, np.zeros(0, np.int64)
        while at < len(text) or not at:
            end = len(text)
            if end - at > self.params.piece_bytes:
                cut = _CUT.search(text, at + self.params.piece_bytes)
                end = cut.start() if cut else end
            tokens = _tokens(text[at:end])
            found = np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens))
            last = end >= len(text)
            run = np.concatenate((tail, found, np.zeros(2 if last else 0, np.int64)))
            if len(run) > 2:
                self.pending.setdefault(lang, []).append(run)
                self.waiting += len(run)
            tail = run[-2:]
            if self.waiting >= self.params.held or len(self.ids) > self.params.words:
                yield from self.count()
                if len(self.ids) > self.params.words:
                    words = list(self.ids)
                    yield from self.spill(0)
                    self._forget()
                    tail = np.array([self.ids[words[w]] for w in tail], np.int64)
            if last:
                break
            at = end

    def count(self) -> Iterator[pa.RecordBatch]:
        """Move what waits into the tries; spill if they hold too much."""
        for lang, runs in self.pending.items():
            codes = []
            for run in runs:
                first, second, third = run[:-2], run[1:-1], run[2:]
                third = np.where(second == 0, 0, third) if self.params.max_words == 3 else np.zeros_like(third)
                codes.append((first << (2 * BITS) | second << BITS | third)[first != 0])
            found = np.unique(np.concatenate(codes), return_counts=True)
            trie = self.tries.setdefault(lang, BurstTrie(self.params.burst))
            if len(found[0]):
                self.held += trie.add(*found)
        self.pending, self.waiting = {}, 0
        if self.held > self.params.held:
            yield from self.spill(self.params.held // 4)

    def spill(self, keep: int) -> Iterator[pa.RecordBatch]:
        """Runs of the largest subtrees, each run sorted, until no more than ``keep`` entries are held."""
        words = [b"", *list(self.ids)[1:]]
        column = pa.array(words, pa.binary())
        rank = np.empty(len(words), np.int64)
        rank[pc.sort_indices(column).to_numpy()] = np.arange(len(words))
        largest = sorted(((size, lang, word) for lang, t in self.tries.items() for word, size in t.sizes.items()), reverse=True)
        gone: dict[str, list[int]] = {}
        for size, lang, word in largest:
            if self.held <= keep:
                break
            gone.setdefault(lang, []).append(word)
            self.held -= size
        for lang, chosen in gone.items():
            codes, counts = self.tries[lang].take(chosen)
            three = [codes >> (2 * BITS), codes >> BITS & _MASK, codes & _MASK]
            # Ranks are below 2 to the power of 21 as well, so one number orders a path.
            order = np.argsort(rank[three[0]] << (2 * BITS) | rank[three[1]] << BITS | rank[three[2]])
            three, counts = [w[order] for w in three], counts[order]
            name = lang.encode()
            bounds = [bisect_left(range(len(codes)), r, key=lambda i: (name, *(words[w[i]] for w in three))) for r in self.ranges]
            part = np.searchsorted(bounds, np.arange(len(codes)), side="right")
            tag = pa.array([name], pa.binary())
            for at in range(0, len(codes), 1 << 16):
                here = slice(at, at + (1 << 16))
                columns = [column.take(pa.array(w[here])) for w in three]
                path = pc.binary_join_element_wise(tag.take(pa.array(np.zeros(len(columns[0]), np.int64))), *columns, b" ")
                yield pa.record_batch({"part": pa.array(part[here], pa.int32()), "path": _as_text(path), "n": counts[here]})


def _ranges(docs: DataFrame, params: PhraseParams) -> list[tuple[bytes, ...]]:
    """Paths that cut the sorted paths in ranges of about equal numbers, from a sample; they decide the balance of tasks only."""
    count, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    wanted = min(params.ranges, -(-(size or 0) // params.range_bytes))
    if wanted < 2:
        return []

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
                words = _tokens(text.as_py()) + [b".", b"."]
                found = []
                # Of a long text evenly spaced ones.
                for i in range(0, len(words) - 2, 1 + len(words) // 4096):
                    a, b, c = words[i : i + 3]
                    if a != b".":
                        found.append(b" ".join((lang.encode(), a, b"" if b == b"." else b, b"" if b"." in (b, c) else c)))
                yield pa.record_batch({"path": pa.array(found, pa.binary())})

    def cut(group: pa.Table) -> pa.Table:
        ordered = sorted(group["path"].to_pylist(), key=lambda p: p.split(b" "))
        chosen = [ordered[len(ordered) * i // wanted] for i in range(1, wanted)] if ordered else []
        return pa.table({"path": pa.array(sorted(set(chosen)), pa.binary())})

    some = docs.sample(fraction=min(1.0, params.sample / count), seed=1).mapInArrow(paths, "path binary")
    found = some.withColumn("all", F.lit(True)).groupBy("all").applyInArrow(cut, "path binary").collect()
    return sorted(tuple(bytes(r.path).split(b" ")) for r in found)


def _runs(docs: DataFrame, ranges: list[tuple[bytes, ...]], params: PhraseParams) -> DataFrame:
    """``part, path, n``: counts of paths, a language and three words, or fewer and the end of their piece, from each task."""
    shared = docs.sparkSession.sparkContext.broadcast(ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(params, shared.value)
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
                yield from counter.text(lang, text.as_py())
        yield from counter.count()
        yield from counter.spill(0)

    return docs.mapInArrow(run, "part int, path string, n bigint")


def _prefixes(keys: pa.Array, ends: np.ndarray) -> pa.Array:
    """The first ``ends`` bytes of each key."""
    starts, data = _layout(keys)
    offsets = np.concatenate(([0], np.cumsum(ends))).astype(np.int32)
    bytes_ = data[np.repeat(starts[:-1] - offsets[:-1], ends) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(bytes_)])


def _layout(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where keys begin and end in their bytes, and the bytes."""
    _, offsets, data = keys.buffers()
    starts = np.frombuffer(offsets, np.int32)[keys.offset : keys.offset + len(keys) + 1]
    return starts, np.frombuffer(data or b"", np.uint8)


def _summed(keys: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and sums of runs of equal keys."""
    fresh = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
    heads = np.concatenate(([0], np.flatnonzero(fresh) + 1))
    return heads, np.add.reduceat(counts, heads)


def _merged(runs: DataFrame, ranges: list[tuple[bytes, ...]], params: PhraseParams) -> DataFrame:
    """``lang, phrase, n`` of all phrases, single words too, that occur often enough; the empty phrase counts all words.

    A range holds every pair of first words whole, but for the pairs it is cut at. The counts of pairs and words are sums
    over their subtrees, runs in the sorted paths; rare triples and pairs go at once, and only pairs at a cut, words and
    totals are added up afterwards.
    """
    least = params.min_count
    shared = runs.sparkSession.sparkContext.broadcast(sorted({b" ".join(r[:3]) for r in ranges}))

    def settle(paths: pa.Array, counts: np.ndarray, cuts: pa.Array) -> Iterator[pa.RecordBatch]:
        """All counts from sorted paths whose pairs are whole."""

        def give(keys: pa.Array, n: np.ndarray, some: np.ndarray | slice = slice(None)) -> pa.RecordBatch:
            keys = keys if isinstance(some, slice) else keys.filter(pa.array(some))
            return pa.record_batch({"key": _as_text(keys), "n": n[some]})

        heads, n = _summed(paths, counts)
        paths = paths.take(pa.array(heads))
        starts, data = _layout(paths)
        # Three blanks in each path: behind the language, the first and the second word.
        blanks = (np.flatnonzero(data[starts[0] : starts[-1]] == 0x20) + starts[0]).reshape(-1, 3) - starts[:-1, None]
        length = np.diff(starts)
        yield give(paths, n, (n >= least) & (length > blanks[:, 2] + 1))

        pairs = _prefixes(paths, blanks[:, 2])
        heads, n = _summed(pairs, n)
        pairs, blanks = pairs.take(pa.array(heads)), blanks[heads]
        cut = pc.is_in(pairs, cuts).to_numpy(zero_copy_only=False)
        yield give(pairs, n, ((n >= least) | cut) & (blanks[:, 2] > blanks[:, 1] + 1))
        ones = _prefixes(pairs, blanks[:, 1])
        heads, n = _summed(ones, n)
        ones, blanks = ones.take(pa.array(heads)), blanks[heads]
        yield give(ones, n)
        langs = _prefixes(ones, blanks[:, 0])
        heads, n = _summed(langs, n)
        yield give(langs.take(pa.array(heads)), n)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = pa.array(shared.value, pa.binary())
        waiting: list[pa.RecordBatch] = []
        size = 0

        def taken() -> tuple[pa.Array, np.ndarray]:
            rows = pa.Table.from_batches(waiting).combine_chunks()
            return rows["path"].chunk(0).cast(pa.binary()), rows["n"].chunk(0).to_numpy()

        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size < params.merge_rows:
                continue
            paths, counts = taken()
            # The last pair may go on in the next rows; summed, it stays small.
            last = paths[-1].as_py().rsplit(b" ", 1)[0] + b" "
            at = bisect_left(range(len(paths)), True, key=lambda i: paths[i].as_py() >= last)
            heads, n = _summed(paths[at:], counts[at:])
            waiting = [pa.record_batch({"path": _as_text(paths[at:].take(pa.array(heads))), "n": n})]
            size = len(heads)
            if at:
                yield from settle(paths[:at], counts[:at], cuts)
        if waiting and size:
            yield from settle(*taken(), cuts)

    parts = runs.repartitionById(len(ranges) + 1, "part").select("path", "n").sortWithinPartitions("path")
    counted = parts.mapInArrow(merge, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    lang = F.substring_index("key", " ", 1)
    phrase = F.expr("substring(key, length(substring_index(key, ' ', 1)) + 2)")
    return counted.select(F.url_decode(lang).alias("lang"), phrase.alias("phrase"), "n")


def _scored(counts: DataFrame) -> DataFrame:
    """Candidates with the count of both parts of their lowest-scoring cut."""
    words = F.split("phrase", " ", -1)
    named = counts.where("phrase != ''").withColumn("words", words).withColumn("size", F.size("words"))
    found = named.where("size > 1")
    cuts = found.select(
        "lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"), "words", "size"
    )
    ends = F.array(
        F.struct(F.lit("l").alias("side"), F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("part")),
        F.struct(F.lit("r").alias("side"), F.array_join(F.slice("words", F.col("cut") + 1, F.col("size") - F.col("cut")), " ").alias("part")),
    )
    parts = cuts.select("lang", "phrase", "a", "cut", F.inline(ends))
    known = counts.select("lang", F.col("phrase").alias("part"), F.col("n").alias("count"))
    sides = parts.join(known, ["lang", "part"]).groupBy("lang", "phrase", "a", "cut").agg(
        F.max(F.when(F.col("side") == "l", F.col("count"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("count"))).alias("r")
    )
    exact = "decimal(19,0)"
    score = F.expr(f"(cast(1000000 as decimal(7,0)) * cast(a as {exact}) * cast(a as {exact})) div (cast(l as {exact}) * cast(r as {exact}))")
    return sides.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("low")
    ).select("lang", "phrase", "a", "low.l", "low.r", "low.score")


def _covered(candidates: DataFrame, params: PhraseParams) -> DataFrame:
    """Candidates that lie in a longer one with nearly as many occurrences."""
    words = candidates.select("lang", F.split("phrase", " ", -1).alias("words"), "a").where(F.size("words") > 2)
    size = F.size("words")
    inner = F.flatten(F.transform(
        F.sequence(F.lit(2), size - 1),
        lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.array_join(F.slice("words", i, k), " ")),
    ))
    longest = words.select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return candidates.join(longest, ["lang", "phrase"], "left").where(
        f"longer IS NULL OR 100 * cast(longer as decimal(19,0)) < {params.covered} * cast(a as decimal(19,0))"
    ).drop("longer")


def _best(rows: DataFrame, keys: list[str], order: list[Column], params: PhraseParams) -> DataFrame:
    """The first ``top`` rows of each key with their rank. Larger keys are first cut in shares that keep their own first rows."""
    rows = stored(rows, "candidates")
    while True:
        most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        shares = -(-most // params.ranked)
        if shares <= 1:
            break
        share = Window.partitionBy(*keys, "_share").orderBy(*order)
        dealt = rows.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(shares))).withColumn("_rank", F.row_number().over(share))
        rows = stored(dealt.where(F.col("_rank") <= params.top).drop("_share", "_rank"), "candidates")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("rank") <= params.top)


def collocations(docs: DataFrame, params: PhraseParams = PhraseParams()) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of each language of ``docs`` (``text``, ``lang``).

    Letters A to Z are lower-cased; ``[.,;:!?]`` and line ends split a text into pieces, blanks and tabs a piece into words.
    ``a`` counts a phrase inside pieces, ``n`` all words of its language. The score is the lowest of
    floor(1000000 a a / (l r)) over its cuts in two, ``l`` and ``r`` being the counts of the parts (of equal scores the first
    cut). Phrases that mostly occur inside a longer one go. Arithmetic is exact up to counts of 10 to the power of 15.

    Each task counts in tries of bounded size and spills whole subtrees as sorted runs, which Spark sorts together by
    ranges of phrases; a frequent first word, or pair, is cut by the words behind it. The ranges come from a sample, which
    decides no result. A null language is ``und``; null and empty texts, and texts without words, count nothing; repeated
    rows count as often as they are there; long texts go in parts; other columns are not read. Without candidates, or
    on an empty table, there are no rows.
    """
    # Without blanks a language can stand in a path.
    rows = docs.select(F.url_encode(F.coalesce("lang", F.lit("und"))).alias("lang"), "text").where("text != ''")
    ranges = _ranges(rows, params)
    counts = stored(_merged(_runs(rows, ranges, params), ranges, params), "phrase-counts")
    total = counts.where("phrase = ''").select("lang", "n")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = _best(_covered(_scored(counts), params), ["lang"], order, params)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
