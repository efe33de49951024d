"""Encoding, packing and token files against the library and by round trip."""

import random
import zlib

import numpy as np
import pytest

from voxward.llm import packing
from voxward.llm.encoding import encoder, public_path
from voxward.llm.packing import PackParams, pack, pack_documents, plan, slots
from voxward.llm.token_files import TokenFile, TokenFileParams, read_bytes, read_tokens, write_tokens

tokenizers = pytest.importorskip("tokenizers")
PATH = public_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    whole = tokenizers.Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    return lambda text: whole.encode(text or "", add_special_tokens=False).ids


def strange_texts(n):
    rng = random.Random(4)
    parts = ["a", "The", " ", "  ", "\n", "\t ", "é", "ß", "9", "'s", "'ll", ".", ", ", "中", "🎉", " ", "\x1c", "\x85", "​", "-", "<|endoftext|>", "Ж", "ω", "́", "…"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_ids_are_the_librarys(library):
    for text in strange_texts(1500) + ["word " * 5000, "x" * 100_000]:
        assert np.frombuffer(encoder(PATH).encode(text), "<u4").tolist() == library(text), repr(text[:80])


def rows(n=40):
    rng = random.Random(8)
    made = [(i, " ".join(rng.choice(["alpha", "beta", "gamma,", "x"]) for _ in range(rng.choice([0, 1, 5, 30, 90])))) for i in range(n)]
    return made + [(100, None), (101, ""), (102, "long text " * 3000), (103, strange_texts(1)[0]), (7, made[7][1]), (None, "no id")]


@pytest.mark.parametrize("capacity", [1, 7, 64, 1024])
def test_documents_are_packed_whole(documents, library, capacity):
    data = rows()
    got = pack_documents(documents(data), PackParams(capacity), keep_ids=True).collect()
    sequences = {}
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    by_id = {i: library(t) + [2] for i, t in data}
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, {})[r.piece] = r
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == by_id[r.doc_id][r.start : r.start + r.length]
    for i, parts in pieces.items():
        lengths = [parts[k].length for k in range(len(parts))]
        assert sum(lengths) == len(by_id[i]) and all(n == capacity for n in lengths[1:])
    assert sum(r.length for r in got) == sum(len(library(t)) + 1 for _, t in data)


def test_plans_use_every_piece_once():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([1, 2, 7, 16, 64])
        counts = {n: rng.choice([0, 1, 2, 5, 100]) for n in range(1, capacity + 1)}
        kinds = plan(counts, capacity)
        used = {}
        for content, size in kinds:
            assert size > 0 and sum(n * times for n, times in content) <= capacity
            for n, times in content:
                used[n] = used.get(n, 0) + times * size
        assert used == {n: c for n, c in counts.items() if c}
        assert {n: max(r[2] for r in slots(kinds) if r[0] == n) for n in used} == used


def test_exact_complements_fill_whole_sequences():
    counts = {600: 50, 424: 50, 500: 30, 300: 30, 224: 30, 1000: 9, 10: 9, 8: 9, 6: 9}
    kinds = plan(counts, 1024)
    assert all(sum(n * t for n, t in content) == 1024 for content, _ in kinds) and sum(s for _, s in kinds) == 89
    rng = np.random.default_rng(1)
    lengths = np.unique(np.clip(rng.lognormal(6, 1, 200_000).astype(int), 1, 1024), return_counts=True)
    counts = dict(zip(*(x.tolist() for x in lengths), strict=True))
    kinds = plan(counts, 1024)
    least = -(-sum(n * c for n, c in counts.items()) // 1024)
    assert sum(s for _, s in kinds) <= 1.002 * least and len(kinds) < 4000


def test_a_length_that_all_share_is_ranked_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 20)
    items = spark.range(500).selectExpr("id AS item", "CAST(CASE WHEN id < 400 THEN 3 ELSE id % 5 END AS BIGINT) AS length")
    got = pack(items, 7).collect()
    placed = [(r.sequence_id, r.offset) for r in got if r.sequence_id is not None]
    assert len(set(placed)) == len(placed) == 480 and {r.length for r in got if r.sequence_id is None} == {0}


def test_packing_of_nothing(documents):
    assert pack_documents(documents([])).count() == 0


def test_token_files_round_trip(spark, documents, library, tmp_path):
    data = rows()
    manifest = write_tokens(documents(data), str(tmp_path / "tokens"), TokenFileParams())
    got = read_tokens(manifest).orderBy("start").collect()
    want = sorted(((i, library(t) + [2]) for i, t in data), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in want]
    start = 0
    for r, (_, ids) in zip(got, want, strict=True):
        read = np.frombuffer(bytes(r.ids), "<u4")
        assert (r.start, r.n_tokens, read.tolist()) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    files = manifest.collect()
    dictionary = read_bytes(files[0].dictionary)
    found = [TokenFile(f.path, dictionary).find(102) for f in files]
    assert [x.tolist() for hits in found for x in hits] == [library(dict(data)[102]) + [2]]
    assert sum(len(TokenFile(f.path, dictionary).find(7)) for f in files) == 2
    with pytest.raises(ValueError):
        TokenFile(files[0].path, dictionary + b"x")


def test_token_files_of_nothing(documents, tmp_path):
    manifest = write_tokens(documents([]), str(tmp_path / "none"))
    assert manifest.count() == 0 and read_tokens(manifest).count() == 0


def test_ids_that_do_not_fit_are_refused(documents, tmp_path):
    with pytest.raises(ValueError):
        TokenFileParams(id_bytes=3)
    wide = write_tokens(documents([(1, "text")]), str(tmp_path / "wide"), TokenFileParams(end_id=70_000, id_bytes=4))
    assert read_tokens(wide).first().n_tokens == 2


def test_added_tokens_are_the_librarys(documents, tmp_path):
    unchanged = tokenizers.Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "plain text.<|endoftext|>\nπ <|endoftext|>", "日本 <|endoftext|>", "no <|endoftext| here"]
    want = [unchanged.encode(text, add_special_tokens=False).ids for text in texts]
    assert [50256 in ids for ids in want] == [True] * 4 + [False]
    for text, ids in zip(texts, want, strict=True):
        assert np.frombuffer(encoder(PATH, added=True).encode(text), "<u4").tolist() == ids
    table = documents(list(enumerate(texts)))
    crcs = {i: zlib.crc32(np.array([*ids, 2], "<u4").tobytes()) for i, ids in enumerate(want)}
    manifest = write_tokens(table, str(tmp_path / "tokens"), TokenFileParams(end_id=2))
    assert {r.doc_id: r.ids_crc32 for r in read_tokens(manifest, keep_ids=False).collect()} == crcs
    assert {r.doc_id: r.ids_crc32 for r in pack_documents(table, PackParams(capacity=1024, end_id=2)).collect()} == crcs
