"""Whole texts to token ids with the tokenizers library, words encoded once per task."""

from __future__ import annotations

import os
import sys
from array import array

import numpy as np
import regex

#: The word pattern of the public byte-level BPE vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on whose class all Unicode versions agree: texts with others are encoded whole by the library.
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7e¡-ÿĀ-ſα-ωА-я‐-‧]*")
#: A space beside other white space of plain texts; without it every space begins a word of the pattern.
_WIDE = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")
#: Words that a worker remembers in each of two generations, and half as many parts of words; some 60 MB.
WORDS_KEPT = 150_000


def _byte_letters() -> dict[int, str]:
    """The printable letter by which a byte-level vocabulary writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


def _little(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


class Memory(dict):
    """What has been made of each word met, in bounded memory.

    When one generation is full it becomes the older one and the oldest goes;
    words met again move to the young one, so frequent words stay.
    """

    def __init__(self, kept: int) -> None:
        super().__init__()
        self._kept, self._older = kept, {}

    def make(self, word):
        raise NotImplementedError

    def __missing__(self, word):
        made = self._older.get(word)
        if made is None:
            made = self.make(word)
        if len(self) >= self._kept:
            self._older = dict(self)
            self.clear()
        self[word] = made
        return made


class Parts(Memory):
    """The ids of the parts into which the pattern cuts a text."""

    def __init__(self, model, kept: int) -> None:
        super().__init__(kept)
        self._model = model
        self._letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self._cut = regex.compile(PATTERN).findall

    def make(self, part: str) -> bytes:
        letters = part.encode().decode("latin-1").translate(self._letters)
        return _little(array("I", [token.id for token in self._model.tokenize(letters)]))

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self._cut(text)))


class Encoder(Memory):
    """Encodes texts by a byte-level BPE file; maps each word met to the ids of a space and the word.

    Ids are little-endian 32-bit numbers, equal to the library's
    ``encode(text, add_special_tokens=False)``. With ``added`` the file is taken
    as it is, and texts that hold an added token, such as ``<|endoftext|>``, are
    encoded whole; without, such tokens are ordinary text. Merges are the library's, made once for each part met.
    """

    def __init__(self, path: str, kept: int, added: bool = False) -> None:
        super().__init__(kept)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        self._whole.encode_special_tokens = not added
        self._added = tuple(token.content for token in self._whole.get_added_tokens_decoder().values()) if added else ()
        self._parts = Parts(self._whole.model, kept // 2)

    def make(self, word: str) -> bytes:
        # A space and letters are one part of the pattern, a mark behind them the next.
        if word.isalpha():
            return self._parts.make(f" {word}")
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            return self._parts.make(f" {word[:-1]}") + self._parts[word[-1]]
        return self._parts.encode(f" {word}")

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, null as empty."""
        if not text:
            return b""
        if not _PLAIN.fullmatch(text) or any(token in text for token in self._added):
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if any(pair in text for pair in _WIDE):
            return self._parts.encode(text)
        first, *words = text.split(" ")
        return self._parts.encode(first) + b"".join(map(self.__getitem__, words))


_encoders: dict[tuple[str, int, bool], Encoder] = {}


def encoder(path: str, kept: int = WORDS_KEPT, added: bool = False) -> Encoder:
    """This worker's encoder for a file; kept between tasks."""
    if (path, kept, added) not in _encoders:
        _encoders.clear()
        _encoders[path, kept, added] = Encoder(path, kept, added)
    return _encoders[path, kept, added]


def public_path(name: str) -> str:
    """Where a public vocabulary file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
