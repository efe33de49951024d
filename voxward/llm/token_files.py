"""Token-id files: every document compressed by itself with one shared zstandard dictionary.

The dictionary is trained on serialized id arrays, so that short documents
compress well alone. A file holds documents in ascending ``doc_id`` order:

    magic (8 bytes), bytes per id (1), SHA-256 of the dictionary (32)
    one zstandard frame per document
    doc_id (int64), known (uint8, 0 for a null doc_id), frame offset (uint64, one more than documents), ids (uint64), each as an array
    number of documents (uint64), place of the arrays (uint64), magic

The arrays give any document by one seek and one frame. Integers are
little-endian. ``dictionary-<hash>`` beside the files holds the dictionary.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxward.llm.encoding import WORDS_KEPT, encoder, public_path
from voxward.llm.tables import stored

MAGIC = b"TOKENS01"
_HEAD = struct.Struct("<8sB32s")
_TAIL = struct.Struct("<QQ8s")


@dataclass(frozen=True)
class TokenFileParams:
    """End id and vocabulary of the documents; the dictionary's size in bytes, and the sample it is trained on.

    The sample is the ``sample`` documents of smallest id hash among those of up
    to ``sample_bytes`` bytes. It decides the compression only. ``words_kept`` trades a
    worker's memory for speed (400 bytes a word).
    """

    end_id: int = 2
    vocabulary: str = "byte_bpe_50k.json"
    id_bytes: int = 2
    level: int = 1
    dictionary_bytes: int = 65536
    sample: int = 1000
    sample_bytes: int = 16384
    words_kept: int = WORDS_KEPT

    def __post_init__(self) -> None:
        if self.id_bytes not in (2, 4):
            raise ValueError("id_bytes must be 2 or 4")

    def path(self) -> str:
        return self.vocabulary if "/" in self.vocabulary else public_path(self.vocabulary)


def _serialized(ids: np.ndarray, id_bytes: int) -> bytes:
    if len(ids) and int(ids.max()) >= 1 << (8 * id_bytes):
        raise ValueError(f"an id needs more than {id_bytes} bytes")
    return ids.astype(f"<u{id_bytes}").tobytes()


def _ids(text: str | None, path: str, params: TokenFileParams) -> np.ndarray:
    return np.frombuffer(encoder(path, params.words_kept, added=True).encode(text) + params.end_id.to_bytes(4, "little"), "<u4")


def train_dictionary(docs: DataFrame, params: TokenFileParams = TokenFileParams()) -> bytes:
    """A dictionary for the documents' id arrays, at most ``dictionary_bytes`` long; made in one task."""
    sample = docs.where(F.octet_length("text") <= params.sample_bytes).select("doc_id", "text")
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(params.sample).coalesce(1)
    path = params.path()

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        samples = [_serialized(_ids(t, path, params), params.id_bytes) for batch in batches for t in batch["text"]]
        try:
            made = zstandard.train_dictionary(params.dictionary_bytes, samples).as_bytes()
        except zstandard.ZstdError:  # too little to train on: the samples themselves serve
            made = b"".join(samples)[-params.dictionary_bytes :]
        yield pd.DataFrame({"dictionary": [made]})

    rows = sample.mapInPandas(train, "dictionary binary").collect()
    return bytes(rows[0][0]) if rows else b""


def _loaded(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def _write(file: pa.NativeFile, rows: Iterator[tuple[int | None, np.ndarray]], dictionary: bytes, params: TokenFileParams) -> tuple[int, int]:
    """Write one file as the documents come; returns the numbers of documents and ids."""
    loaded = _loaded(dictionary)
    if loaded:
        loaded.precompute_compress(level=params.level)  # once for all documents
    packer = zstandard.ZstdCompressor(level=params.level, dict_data=loaded)
    file.write(_HEAD.pack(MAGIC, params.id_bytes, hashlib.sha256(dictionary).digest()))
    doc_ids, known, offsets, sizes = [], [], [_HEAD.size], []
    for doc_id, ids in rows:
        frame = packer.compress(_serialized(ids, params.id_bytes))
        file.write(frame)
        doc_ids.append(doc_id or 0)
        known.append(doc_id is not None)
        offsets.append(offsets[-1] + len(frame))
        sizes.append(len(ids))
    for values, kind in ((doc_ids, "<i8"), (known, "u1"), (offsets, "<u8"), (sizes, "<u8")):
        file.write(np.array(values, kind).tobytes())
    file.write(_TAIL.pack(len(doc_ids), offsets[-1], MAGIC))
    return len(doc_ids), sum(sizes)


def write_tokens(docs: DataFrame, folder: str, params: TokenFileParams = TokenFileParams()) -> DataFrame:
    """Write the token ids of all documents; returns the stored manifest of the files.

    ``folder`` must be reachable by all executors. Documents are sorted by
    ``doc_id`` (nulls first; rows that repeat one by their text) over the
    cluster, each task writes its range under a name of its own attempt, and
    the manifest (``shard, path, dictionary, documents, ids``) lists those that
    counted, so a lost or repeated task leaves no wrong file in it. Null texts
    are empty, with the end id alone. An empty table gives an empty manifest.
    """
    path, dictionary = params.path(), train_dictionary(docs, params)
    fs, base = FileSystem.from_uri(folder)
    fs.create_dir(base)
    name = f"dictionary-{hashlib.sha256(dictionary).hexdigest()}"
    with fs.open_output_stream(f"{base}/{name}") as file:
        file.write(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        yield doc_id, _ids(text, path, params)

        shard = TaskContext.get().partitionId()
        own = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.tokens"
        own_fs, place = FileSystem.from_uri(own)
        own_fs.create_dir(place.rsplit("/", 1)[0])
        with own_fs.open_output_stream(place) as file:
            n, ids = _write(file, rows(), dictionary, params)
        if n:
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [own], "dictionary": [f"{folder}/{name}"], "documents": [n], "ids": [ids]})
        else:
            own_fs.delete_file(place)

    ordered = docs.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return stored(ordered.mapInArrow(run, "shard bigint, path string, dictionary string, documents bigint, ids bigint"), "manifest")


class TokenFile:
    """One file, opened for single documents: only the arrays at its end are read at once."""

    def __init__(self, path: str, dictionary: bytes) -> None:
        fs, place = FileSystem.from_uri(path)
        self._file = fs.open_input_file(place)
        magic, self._id_bytes, digest = _HEAD.unpack(self._file.read_at(_HEAD.size, 0))
        n, at, end = _TAIL.unpack(self._file.read_at(_TAIL.size, self._file.size() - _TAIL.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"{path} is no complete token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        data = self._file.read_at(25 * n + 8, at)
        self.doc_ids = np.frombuffer(data, "<i8", n)
        self.known = np.frombuffer(data, "u1", n, 8 * n).astype(bool)
        self._offsets = np.frombuffer(data, "<u8", n + 1, 9 * n)
        self.sizes = np.frombuffer(data, "<u8", n, 17 * n + 8)
        self._unpacker = zstandard.ZstdDecompressor(dict_data=_loaded(dictionary))

    def __len__(self) -> int:
        return len(self.doc_ids)

    def read(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        first, end = int(self._offsets[k]), int(self._offsets[k + 1])
        frame = self._file.read_at(end - first, first)
        data = self._unpacker.decompress(frame, max_output_size=int(self.sizes[k]) * self._id_bytes)
        return np.frombuffer(data, f"<u{self._id_bytes}").astype("<u4")

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of all rows with this doc_id, by binary search."""
        nulls = int((~self.known).sum())
        low, high = (nulls + np.searchsorted(self.doc_ids[nulls:], doc_id, side) for side in ("left", "right"))
        return [self.read(k) for k in range(low, high)]

    def close(self) -> None:
        self._file.close()


def read_bytes(path: str) -> bytes:
    fs, place = FileSystem.from_uri(path)
    with fs.open_input_file(place) as file:
        return file.read()


def read_tokens(manifest: DataFrame, keep_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of every document in the files of a manifest.

    ``start`` counts the ids of all documents before. Each task opens whole
    files; documents are read one by one.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row a file.
    files = manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionaries: dict[str, bytes] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] not in dictionaries:
                    dictionaries = {row["dictionary"]: read_bytes(row["dictionary"])}
                file = TokenFile(row["path"], dictionaries[row["dictionary"]])
                starts = row["start"] + np.cumsum(file.sizes, dtype=np.int64) - file.sizes.astype(np.int64)
                for at in range(0, len(file), 256):
                    span = slice(at, at + 256)
                    ids = [file.read(k).tobytes() for k in range(at, min(at + 256, len(file)))]
                    columns = [
                        pa.array(file.doc_ids[span], pa.int64(), mask=~file.known[span]),
                        pa.array(starts[span]),
                        pa.array(file.sizes[span].astype(np.int64)),
                        pa.array([zlib.crc32(v) for v in ids], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * keep_ids, names)
                file.close()

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids
    shape = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * keep_ids
    spread = files.repartition(max(1, manifest.count()))
    return spread.mapInArrow(run, shape)
