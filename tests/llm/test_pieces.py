"""The transducer against the library."""

import random
import zlib

import numpy as np
import pytest

from voxward.llm.pieces import PieceParams, Transducer, decode_pieces, encode_pieces

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PieceParams().path())


def texts(n):
    rng = random.Random(2)
    parts = ["a", "the", " ", "   ", "\n", "\t", "é", "ß", "中文", "🎉", "‍", "▁", "-", "==", "(", "01", "ing", "hello", "Straße", "\x00"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_paths_are_the_librarys(library):
    machine = Transducer(PieceParams().path())
    for text in texts(1200) + ["", " ", "x" * 3000, "word " * 2000]:
        ids = np.frombuffer(machine.encode(text), "<u4").tolist()
        assert ids == library.encode(text), repr(text[:60])
        assert machine.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_one_path_has_a_finite_weight():
    """Of all ways to cut a word into pieces exactly one has only arcs of finite weight."""
    machine = Transducer(PieceParams().path())

    def ways(word):
        if not word:
            return [[]]
        return [
            [word[:k], *rest] for k in range(1, len(word) + 1) if k == 1 or word[:k] in machine._ids for rest in ways(word[k:])
        ]

    for word in ("▁there", "▁istion", "nding", "▁▁▁x", "aaaa"):
        finite = [
            w for w in ways(word)
            if all(machine._may_follow[pair] for pair in zip(["", *w], w)) and (len(w[0]) == 1 or machine._may_follow["", w[0]])
        ]
        assert finite == [machine._shortest_path(word)]


def test_rows(spark, documents, library):
    data = [*enumerate(texts(50)), (90, None), (91, ""), (92, "long text " * 20_000), (None, "x"), (3, "again")]
    got = encode_pieces(documents(data)).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(i) for i, _ in data)
    for r in got:
        ids = library.encode(next(t for i, t in data if i == r.doc_id) or "") if r.doc_id != 3 else None
        if ids is not None:
            assert r.n_pieces == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    back = {r.doc_id: r.text for r in decode_pieces(encode_pieces(documents(data))).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in data if i not in (3,))
    assert encode_pieces(documents([])).count() == 0
