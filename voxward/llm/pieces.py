"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The transducer is the composition of a normaliser (white space to its mark, a
leading mark), the pieces of the vocabulary, and byte fallback for characters
without a piece. Its states are the last piece read: an arc that follows a piece
with another has weight one, or infinity where the merges of the vocabulary would
have joined or split the two differently. Composed with an input it is a lattice
over places in the text, and the shortest path by (min, +) is the encoding. A
sequence of pieces is what the merges make if and only if that holds for every
two neighbours, so there is one path of finite weight and it is the library's.

No piece has a mark behind another character, so the lattice falls apart at
marks, and the path of each word is found once per task.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxward.llm.encoding import Memory, public_path

#: White space in pieces, and the kinds of pieces in a model file (fixed values).
MARK = "▁"
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
#: Words, and neighbours of pieces, remembered by a worker in each of two generations.
WORDS_KEPT, NEIGHBOURS_KEPT = 400_000, 300_000
#: Longer runs without a mark are not remembered.
LONG_WORD = 200


@dataclass(frozen=True)
class PieceParams:
    """The model file (a path, or a public name); BPE with byte fallback and an identity normaliser."""

    model: str = "piece_bpe_32k.model"

    def path(self) -> str:
        return self.model if "/" in self.model else public_path(self.model)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialized message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Neighbours(Memory):
    """Whether the arc from one piece to the next has a finite weight.

    It has if no merge across their border would have come before the merges
    that made them. Undoing the latest of these merges, step by step, shows each
    pair of symbols that ever met at the border.
    """

    def __init__(self, ids: dict[str, int], score: list[float]) -> None:
        super().__init__(NEIGHBOURS_KEPT)
        # Merges come in order of rank; single characters are not merged.
        self._rank = {p: -score[i] for p, i in ids.items() if len(p) > 1}
        self._halves: dict[str, tuple[str, str] | None] = {}

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two symbols whose merge makes a piece of its own characters, None if none does."""
        if piece not in self._halves:
            symbols, last = list(piece), None
            while len(symbols) > 1:
                ranks = [self._rank.get(x + y, np.inf) for x, y in zip(symbols, symbols[1:], strict=False)]
                at = ranks.index(min(ranks))
                if ranks[at] == np.inf:
                    break
                last = symbols[at], symbols[at + 1]
                symbols[at : at + 2] = ["".join(last)]
            self._halves[piece] = last if len(symbols) == 1 else None
        return self._halves[piece]

    def make(self, pair: tuple[str, str]) -> bool:
        left, right = pair
        rank, limit = self._rank, np.inf
        if (left in rank and not self.halves(left)) or (right in rank and not self.halves(right)):
            return False
        while left:
            if rank.get(left + right, np.inf) < limit:
                return False
            of_left, of_right = rank.get(left, -1.0), rank.get(right, -1.0)
            if of_left > of_right:
                limit, left = of_left, self.halves(left)[1]
            elif of_right >= 0:
                # Of equal merges the left one comes first.
                limit, right = np.nextafter(of_right, np.inf), self.halves(right)[0]
            else:
                break
        return True


class Transducer(Memory):
    """Compiled from a model file; maps each word met to the ids of its shortest path, as 32-bit numbers."""

    def __init__(self, path: str) -> None:
        super().__init__(WORDS_KEPT)
        with open(path, "rb") as file:
            model = list(_fields(file.read()))
        rule = dict(_fields(next(v for k, v in model if k == 3)))
        trainer = dict(_fields(next(v for k, v in model if k == 2)))
        if rule.get(2) or rule.get(4, 1) or trainer.get(3) != 2 or not trainer.get(35):
            raise ValueError("only BPE with byte fallback, identity normaliser and kept spaces is compiled")
        self._prefix = bool(rule.get(3, 1))
        entries = [dict(_fields(v)) for k, v in model if k == 1]
        self.pieces = [e[1].decode() for e in entries]
        kinds = [e.get(3, NORMAL) for e in entries]
        self._bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == BYTE}
        self._ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k in (NORMAL, USER)}
        self._score = [struct.unpack("<f", e.get(2, b"\0\0\0\0"))[0] for e in entries]
        self._tree: dict = {}
        for piece in self._ids:
            node = self._tree
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = {}
        self._inside = {p[k : k + 2] for p in self._ids for k in range(len(p) - 1)}
        if any(regex.fullmatch(f"{MARK}*[^{MARK}]*", p) is None for p in self._ids):
            raise ValueError("a piece has a mark behind another character")
        self._may_follow = Neighbours(self._ids, self._score)
        self._words = regex.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self._text = [self._written(i, k) for i, k in enumerate(kinds)]

    def _written(self, i: int, kind: int) -> bytes:
        """What a piece becomes when it is decoded."""
        if kind == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return self.pieces[i].replace(MARK, " ").encode() if kind in (NORMAL, USER) else b""

    def _shortest_path(self, word: str) -> list[str]:
        """The pieces of the path of least weight through the lattice of a word.

        One path only has a finite weight, so the first one found is it, looked
        for along the longest arcs. States (place and last piece) without a way
        on are visited once. A character without a piece stands for its bytes.
        """
        path, arcs, place, n = [], [], 0, len(word)
        tree, dead, may_follow = self._tree, set(), self._may_follow
        forward = True
        while place < n:
            if forward:
                node, ends, k = tree, [place + 1], place
                while k < n and (node := node.get(word[k])):
                    k += 1
                    if "" in node and k > place + 1:
                        ends.append(k)
                arcs.append(ends)
            last, ends = path[-1] if path else "", arcs[-1]
            forward = False
            while ends:
                end = ends.pop()
                piece = word[place:end]
                if may_follow[last, piece] and not (dead and (end, piece) in dead):
                    path.append(piece)
                    place, forward = end, True
                    break
            if not forward:
                arcs.pop()
                dead.add((place, last))
                place -= len(path.pop())
        return path

    def _made(self, word: str) -> bytes:
        ids: list[int] = []
        for piece in self._shortest_path(word):
            i = self._ids.get(piece)
            ids += [i] if i is not None else [self._bytes[b] for b in piece.encode()]
        return np.array(ids, "<u4").tobytes()

    def make(self, word: str) -> bytes:
        if len(word) > 1 and word[-2:] not in self._inside:
            # No piece holds these two characters side by side, so no arc crosses here.
            return self[word[:-1]] + self[word[-1]]
        return self._made(word)

    def __missing__(self, word: str) -> bytes:
        return super().__missing__(word) if len(word) <= LONG_WORD else self._made(word)

    def normalized(self, text: str) -> str:
        return (MARK if self._prefix and text else "") + text.replace(" ", MARK)

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, null as empty, as little-endian 32-bit numbers."""
        return b"".join(map(self.__getitem__, self._words(self.normalized(text or ""))))

    def decode(self, ids: bytes) -> str:
        """The text of ids; broken byte sequences become U+FFFD."""
        written = b"".join([self._text[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return written.decode(errors="replace").removeprefix(" " if self._prefix else "")


_transducers: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """This worker's transducer for a file; kept between tasks."""
    if path not in _transducers:
        _transducers[path] = Transducer(path)
    return _transducers[path]


def encode_pieces(docs: DataFrame, params: PieceParams = PieceParams(), keep_ids: bool = True) -> DataFrame:
    """``doc_id, n_pieces, ids_crc32, decoded_sha256, round_trip`` (and ``ids``) per row of ``docs``.

    ``ids`` are little-endian 32-bit numbers; ``decoded_sha256`` is of the text
    decoded from them, ``round_trip`` whether it is the text that came in. Null
    and empty texts have no pieces. No row looks at another one.
    """
    path = params.path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                ids = [machine.encode(t) for t in texts]
                decoded = [machine.decode(i) for i in ids]
                columns = [
                    batch.column(0),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
                    pa.array([d == t for d, t in zip(decoded, texts, strict=True)]),
                ]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * keep_ids, names)

    names = ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "round_trip"] + ["ids"] * keep_ids
    shape = "doc_id bigint, n_pieces bigint, ids_crc32 bigint, decoded_sha256 string, round_trip boolean" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, shape)


def decode_pieces(rows: DataFrame, params: PieceParams = PieceParams()) -> DataFrame:
    """``doc_id, text`` from rows with ``ids`` as ``encode_pieces`` gives them; null ids give a null text."""
    path = params.path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            texts = [None if i is None else machine.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("bigint"), "ids").mapInArrow(run, "doc_id bigint, text string")
