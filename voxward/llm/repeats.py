"""Exact substring dedup: removes bytes covered by a window that also starts earlier in the corpus.

The windows of a document (100 bytes) are cut into segments: neighbouring windows
that have the same smallest k-gram in common, their anchor. Equal windows have
equal anchors, so only segments whose anchor occurs more than once can hold a
repeat, and all occurrences of a window meet under one anchor. Equal segments are
combined first: all but the first occurrence are repeats as a whole. The
remaining different segments of an anchor go, with the other anchors of their
shard, into a suffix array built by induced sorting, where neighbours with a
common prefix of a window's length are the repeats. Before that a segment loses
the windows at its ends whose bytes around the anchor no other segment has.

An anchor with more different segments than fit into a shard is split by the
bytes around it: windows that begin far before the anchor have more bytes in
front of it in common, the others more bytes behind it. Both halves get a longer
anchor of these bytes and are treated in the same way, up to an anchor that is
the window itself, whose segments are all equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxward.llm import hashing
from voxward.llm.hashing import mix
from voxward.llm.suffix_array import repeats
from voxward.llm.tables import fresh_name, small_side, stored


@dataclass(frozen=True)
class RepeatParams:
    """``window`` bytes; anchors of ``gram`` bytes; suffix arrays of about ``shard_bytes``.

    Anchors with more than ``most_segments`` different segments are split by the
    bytes around them until no more are left, as no shard may grow with the corpus.
    """

    window: int = 100
    gram: int = 40
    shard_bytes: int = 1 << 19
    most_segments: int = 2_000

    def __post_init__(self) -> None:
        if not 0 < self.gram <= self.window:
            raise ValueError("gram must be between 1 and window")


#: Windows are scanned in pieces of this many; their places fit into POSITION_BITS.
PIECE = 1 << 19
#: Short texts are scanned together up to this many bytes, few enough for the arrays to stay in the cache.
TOGETHER = 1 << 15
POSITION_BITS = np.uint64(20)
_PLACE = np.uint64((1 << 20) - 1)
#: Ranges of distances from the anchor for which a shard's segments are looked through before they are sorted.
RANGES = 8


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all runs of ``gram`` bytes, put together from runs of powers of two."""
    table, power, size = hashing._BYTES[raw], hashing._BASE, 1
    out, taken, left = None, 0, gram
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if out is None:
                    out = table
                else:
                    n = len(raw) - taken - size + 1
                    out = out[:n] * power + table[taken : taken + n]
                taken += size
            left >>= 1
            if left:
                table = table[:-size] * power + table[size:]
                power, size = power * power, size * 2
    return mix(out)


def _joined(texts: Iterator[tuple[int, bytes]], window: int) -> Iterator[list[tuple[int, bytes]]]:
    """Texts of at least a window's length, short ones several at a time, as alone they cost more in calls than in work."""
    held, size = [], 0
    for doc_id, text in texts:
        if not text or len(text) < window:
            continue
        if held and size + len(text) > TOGETHER:
            yield held
            held, size = [], 0
        held.append((doc_id, text))
        size += len(text)
    if held:
        yield held


def _segments(texts: list[bytes], params: RepeatParams, anchors_only: bool = False) -> tuple[np.ndarray, ...]:
    """Anchor key, content hash, first byte, number of bytes and the anchor's place inside of each segment, and the number of its text.

    With ``anchors_only`` the key alone. Several texts must fit into a piece together.
    """
    raw = np.frombuffer(b"".join(texts), np.uint8)
    begins = np.cumsum([0, *map(len, texts)])
    width = params.window - params.gram + 1
    parts = []
    for at in range(0, len(raw) - params.window + 1, PIECE):
        piece = raw[at : at + PIECE + params.window - 1]
        grams = _gram_hashes(piece, params.gram)
        # The place breaks ties: the leftmost of the smallest.
        least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: span - width], least[width - span :])
        anchor = (least & _PLACE).astype(np.int64)
        # Windows that lie in one text; its first one begins a segment.
        inside = np.ones(len(anchor), bool)
        fresh = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        for b in begins[1:-1]:
            inside[b - params.window + 1 : b] = False
            fresh[b] = True
        starts = np.flatnonzero(inside)
        runs = np.flatnonzero(fresh[starts])
        first = starts[runs]
        if anchors_only:
            parts.append((grams[anchor[first]].view(np.int64),))
            continue
        size = np.diff(np.append(runs, len(starts))) + params.window - 1
        power, inverse = hashing._power_tables(len(piece) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashing._BYTES[piece] * power[: len(piece)])))
        content = mix((sums[first + size] - sums[first]) * inverse[first] + size.astype(np.uint64))
        text = np.searchsorted(begins, first + at, "right") - 1
        parts.append((grams[anchor[first]].view(np.int64), content.view(np.int64), first + at - begins[text], size, anchor[first] - first, text))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    for start in range(0, batch.num_rows, 256):
        part = batch.slice(start, 256)
        yield from zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True)


def _anchor_counts(docs: DataFrame, params: RepeatParams) -> DataFrame:
    """Anchors that occur more than once; occurrences are counted per batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_segments([t for _, t in some], params, anchors_only=True)[0] for some in _joined(_texts(batch), params.window)]
            if keys:
                found, times = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_pydict({"anchor": found, "times": times})

    counts = docs.mapInArrow(run, "anchor bigint, times bigint")
    return counts.groupBy("anchor").agg(F.sum("times").alias("times")).where("times > 1").select("anchor")


_ROW = "anchor bigint, content bigint, doc_id bigint, first bigint, size int, at int, again boolean"


def _segment_rows(docs: DataFrame, params: RepeatParams) -> DataFrame:
    """All segments, with the place of their anchor inside; ``again`` marks those that repeat an earlier one of their document."""

    def rows(some: list[tuple[int, bytes]]) -> pa.RecordBatch:
        anchor, content, first, size, at, text = _segments([t for _, t in some], params)
        order = np.lexsort((content, anchor, text))
        again = np.zeros(len(anchor), bool)
        again[order[1:]] = np.logical_and.reduce([np.diff(c[order]) == 0 for c in (text, anchor, content)])
        return pa.RecordBatch.from_pydict(
            {"anchor": anchor, "content": content, "doc_id": np.array([d for d, _ in some], np.int64)[text], "first": first,
             "size": size.astype(np.int32), "at": at.astype(np.int32), "again": again}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = ((doc_id, text) for doc_id, text in _texts(batch) if doc_id is not None)
            kept = []
            for some in _joined(known, params.window):
                kept.append(rows(some))
                if len(kept) == 16:
                    yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
                    kept = []
            if kept:
                yield from pa.Table.from_batches(kept).combine_chunks().to_batches()

    return docs.mapInArrow(run, _ROW)


_SPANS = "doc_id bigint, first bigint, size int"


def _span_frame(found: list[tuple[int, int, np.ndarray]], window: int) -> pd.DataFrame:
    """Windows (document, start of their segment, offsets) as rows of adjoining runs."""
    doc, first, size = [], [], []
    for doc_id, begin, starts in found:
        if len(starts):
            edge = np.flatnonzero(np.diff(starts) != 1)
            low, high = starts[np.concatenate(([0], edge + 1))], starts[np.append(edge, len(starts) - 1)]
            doc += [doc_id] * len(low)
            first += (begin + low).tolist()
            size += (high - low + window).tolist()
    return pd.DataFrame({"doc_id": np.array(doc, np.int64), "first": np.array(first, np.int64), "size": np.array(size, np.int32)})


_CUT = "anchor bigint, segments bigint, doc_id bigint, first bigint, at int, low int, high int, data binary"


def _rows_of(columns: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*columns, strict=True), schema, strict=True)], schema=schema)


def _open_cuts(docs: DataFrame, params: RepeatParams) -> tuple[DataFrame, DataFrame]:
    """Spans of whole segments that repeat, and the different segments of anchors that have several, with their bytes."""
    anchors = stored(_anchor_counts(docs, params), "anchors")
    common = stored(_segment_rows(docs, params).join(anchors, "anchor"), "segments")
    firsts = stored(common.groupBy("anchor", "content").agg(F.min("doc_id").alias("first_doc")), "firsts")
    # Anchors whose segments are not all the same.
    varied = stored(firsts.groupBy("anchor").agg(F.count("*").alias("segments")).where("segments > 1"), "varied")
    marked = common.join(firsts, ["anchor", "content"]).withColumn("copy", F.expr("again OR doc_id != first_doc"))
    open_segments = stored(
        marked.where("NOT copy").join(varied, "anchor").select("anchor", "segments", "doc_id", "first", "size", "at").distinct(), "open"
    )
    ids = stored(open_segments.select("doc_id").distinct(), "ids")
    lists = open_segments.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "segments", "first", "size", "at")).alias("cuts"))
    lined_up = docs.join(small_side(ids), "doc_id", "left_semi").join(lists, "doc_id").select("doc_id", "text", "cuts")
    widest = params.window - params.gram

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for doc_id, text, cuts in zip(
                    part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True
                ):
                    for c in cuts:
                        data = text[c["first"] : c["first"] + c["size"]]
                        rows.append((c["anchor"], c["segments"], doc_id, c["first"], c["at"], 0, widest, data))
                yield _rows_of(rows, cut_schema)

    cut_schema = _cut_schema()
    whole = marked.where("copy").select("doc_id", "first", "size")
    return whole, stored(lined_up.mapInArrow(cut, _CUT), "cuts")


def _cut_schema() -> pa.Schema:
    long, short = pa.int64(), pa.int32()
    return pa.schema([("anchor", long), ("segments", long), ("doc_id", long), ("first", long), ("at", short), ("low", short), ("high", short), ("data", pa.binary())])


def _halves(at: int, low: int, high: int, data: bytes, window: int) -> Iterator[tuple[bytes, int, int, int, int]]:
    """The two parts of a segment by how far before the anchor (at ``at``) a window begins: ``low`` to ``high`` bytes.

    Gives the bytes that all windows of the part have in common, their range of
    distances, and the part's first and last byte.
    """
    middle = (low + high) // 2
    for near, far in ((low, middle), (middle + 1, high)):
        begin, last = max(at - far, 0), min(at - near, len(data) - window)
        if begin <= last:
            yield data[at - near : at - far + window], near, far, begin, last + window


def _split(cuts: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Segments of large anchors cut in two by distance from the anchor, under longer anchors.

    Gives, as ``_open_cuts``, the spans of parts that repeat as a whole, and the
    different parts of new anchors that have several. What repeats within a
    batch is told there, so a common part leaves each batch once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                seen: dict[tuple[bytes, bytes], tuple[int, int]] = {}
                rows = []
                columns = (whole.slice(start, 1000).column(c).to_pylist() for c in ("doc_id", "first", "at", "low", "high", "data"))
                for doc_id, first, at, low, high, data in sorted(zip(*columns, strict=True)):
                    for core, near, far, begin, end in _halves(at, low, high, data, window):
                        part = data[begin:end]
                        anchor = hashlib.blake2b(core, digest_size=8, salt=b"%d" % near).digest()
                        content = hashlib.blake2b(part, digest_size=8).digest()
                        place = doc_id, first + begin
                        again = seen.setdefault((anchor, content), place) != place
                        numbers = (int.from_bytes(h, "little", signed=True) for h in (anchor, content))
                        rows.append((*numbers, *place, at - begin, near, far, len(part), None if again else part, again))
                yield _rows_of(rows, schema)

    long, short = pa.int64(), pa.int32()
    fields = [("anchor", long), ("content", long), ("doc_id", long), ("first", long), ("at", short), ("low", short), ("high", short), ("size", short)]
    schema = pa.schema([*fields, ("data", pa.binary()), ("again", pa.bool_())])
    shape = "anchor bigint, content bigint, doc_id bigint, first bigint, at int, low int, high int, size int, data binary, again boolean"
    parts = stored(cuts.mapInArrow(run, shape), "parts")
    place = F.struct(F.col("doc_id").alias("doc"), F.col("first").alias("byte"))
    left = parts.where("NOT again")
    firsts = stored(left.groupBy("anchor", "content").agg(F.min(place).alias("earliest"), F.count("*").alias("times")), "firsts")
    varied = stored(firsts.groupBy("anchor").agg(F.count("*").alias("segments")).where("segments > 1"), "varied")
    later = F.expr("doc_id != earliest.doc OR first != earliest.byte")
    copies = left.join(firsts.where("times > 1"), ["anchor", "content"]).where(later)
    spans = parts.where("again").select("doc_id", "first", "size").union(copies.select("doc_id", "first", "size"))
    kept = left.join(varied, "anchor").join(firsts, ["anchor", "content"]).where(~later)
    return spans, stored(kept.select("anchor", "segments", "doc_id", "first", "at", "low", "high", "data"), "cuts")


def _trimmed(columns: list[np.ndarray], raw: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of what the segments of a shard, one after the other in ``raw``, hold of windows that may repeat.

    ``columns`` are each segment's first place in ``raw``, its number of bytes, its anchor's place inside, and the least and
    the greatest distance by which a window begins before the anchor. The distances are cut into ``RANGES`` ranges. Equal
    windows are in one range, and there all windows of a segment have the bytes around the anchor in common: where no
    other segment has the same ones, none of them repeats. From the first range to the last one that may repeat all is kept.
    Both numbers are 0 for segments without any.
    """
    starts, sizes, at, low, high = columns
    power, inverse = hashing._power_tables(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashing._BYTES[raw] * power[: len(raw)])))
    first, end = sizes.copy(), np.zeros(len(sizes), np.int64)
    width = high - low + 1
    for i in range(RANGES):
        near, far = low + width * i // RANGES, low + width * (i + 1) // RANGES - 1
        begin, last = np.maximum(at - far, 0), np.minimum(at - near, sizes - window)
        some = np.flatnonzero((near <= far) & (begin <= last))
        lower, upper = (starts + at - near)[some], (starts + at - far)[some] + window
        core = mix((sums[upper] - sums[lower]) * inverse[lower] + near[some].astype(np.uint64))
        _, same, times = np.unique(core, return_inverse=True, return_counts=True)
        kept = some[times[same] > 1]
        first[kept] = np.minimum(first[kept], begin[kept])
        end[kept] = np.maximum(end[kept], last[kept] + window)
    first[end == 0] = 0
    return first, end


def repeated_spans(docs: DataFrame, params: RepeatParams = RepeatParams()) -> DataFrame:
    """``doc_id, first, size``: byte spans whose every byte lies in a repeated window; they may overlap. Stored."""
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    window = params.window
    spans, cuts = _open_cuts(docs, params)
    fit = cuts.where(F.col("segments") <= params.most_segments)
    # Each round halves the distances, so that there are log2(window) of them at most.
    while not (cuts := cuts.where(F.col("segments") > params.most_segments)).isEmpty():
        more, cuts = _split(cuts, window)
        spans, fit = spans.union(more), fit.union(cuts.where(F.col("segments") <= params.most_segments))
    shards = (fit.agg(F.sum(F.octet_length("data").cast("bigint"))).first()[0] or 0) // params.shard_bytes + 1

    def in_shard(shard: pa.Table) -> pa.Table:
        data = shard.column("data").to_pylist()
        sizes = np.array([len(d) for d in data], np.int64)
        at, low, high = (shard.column(c).to_numpy().astype(np.int64) for c in ("at", "low", "high"))
        begin, end = _trimmed([np.cumsum(sizes) - sizes, sizes, at, low, high], np.frombuffer(b"".join(data), np.uint8), window)
        kept = np.flatnonzero(end)
        if not len(kept):
            return span_schema.empty_table()
        doc_ids, firsts = shard.column("doc_id").to_numpy()[kept], shard.column("first").to_numpy()[kept] + begin[kept]
        order = np.lexsort((firsts, doc_ids))
        kept, doc_ids, firsts = kept[order], doc_ids[order], firsts[order]
        data = [data[i][b:e] for i, b, e in zip(kept.tolist(), begin[kept].tolist(), end[kept].tolist(), strict=True)]
        # Documents one after the other, with more room than any has bytes.
        number = np.unique(doc_ids, return_inverse=True)[1]
        places = number * (int(firsts.max()) + max(map(len, data)) + 1) + firsts
        found = list(zip(doc_ids.tolist(), firsts.tolist(), repeats(data, window, places), strict=True))
        return pa.Table.from_pandas(_span_frame(found, window), schema=span_schema, preserve_index=False)

    span_schema = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("size", pa.int32())])
    sharded = (
        fit.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
        .select("shard", "doc_id", "first", "at", "low", "high", "data")
        .groupBy("shard")
        .applyInArrow(in_shard, _SPANS)
    )
    return stored(spans.union(sharded), "spans")


def _covered(n: int, spans: list[dict]) -> np.ndarray:
    """The bytes of a text of n bytes that lie in a span."""
    change = np.zeros(n + 1, np.int32)
    first = np.array([s["first"] for s in spans], np.int64)
    np.add.at(change, first[first < n], 1)
    end = np.minimum(first + np.array([s["size"] for s in spans], np.int64), n)
    np.add.at(change, end[first < n], -1)
    return np.cumsum(change[:n]) > 0


def remove_repeats(docs: DataFrame, params: RepeatParams = RepeatParams(), keep_text: bool = True) -> DataFrame:
    """``docs`` without repeated passages, plus what was removed.

    Of every window of ``params.window`` bytes that occurs more than once, the
    occurrence with the smallest (``doc_id``, place) stays; bytes covered by any
    other occurrence go. All is judged on the texts as they come in, whole, as
    UTF-8 bytes; windows do not cross documents.

    Adds ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and
    ``kept_sha256`` (of the remaining bytes). With ``keep_text`` ``text`` becomes the
    remaining bytes, less parts of characters that were cut, and ``n_chars``, if
    there, its length; without it ``text`` is left out. Columns of these names in
    ``docs`` are replaced, all others kept. Null texts count as empty and stay
    null. Rows that repeat a ``doc_id`` count as one document: a place repeated in
    one of them goes from all. Rows with a null ``doc_id`` stay whole and make no
    others repeat. Short texts stay as they are; an empty table gives no rows.
    """
    key, spans_of = fresh_name(docs, "doc"), fresh_name(docs, "spans")
    spans = repeated_spans(docs, params).groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("first", "size")).alias(spans_of))
    added = {"n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    rest = [c for c in docs.columns if c not in added and c != "text"]
    wide = docs.select(*rest, "text").join(spans, F.col("doc_id").cast("bigint") == F.col(key), "left")
    wide = wide.select(*rest, "text", spans_of)
    shape = {**{c: docs.schema[c].dataType.simpleString() for c in rest}, **({"text": "string"} if keep_text else {}), **added}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                out = []
                texts = batch.column(len(rest)).cast(pa.binary()).to_pylist()
                for text, cuts in zip(texts, batch.column(len(rest) + 1).to_pylist(), strict=True):
                    data, kept, gone, runs = text or b"", text or b"", 0, 0
                    if cuts:
                        raw = np.frombuffer(data, np.uint8)
                        cover = _covered(len(raw), cuts)
                        gone = int(cover.sum())
                        runs = int((np.diff(cover.astype(np.int8), prepend=0) == 1).sum())
                        kept = raw[~cover].tobytes()
                    new = None if text is None else kept.decode(errors="ignore")
                    out.append((new, len(data), gone, runs, hashlib.sha256(kept).hexdigest()))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                arrays = [batch.column(i) for i in range(len(rest))] + columns[0 if keep_text else 1 :]
                yield pa.RecordBatch.from_arrays(arrays, list(shape))

    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    result = wide.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in shape.items()))
    if keep_text and "n_chars" in rest:
        result = result.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return result
