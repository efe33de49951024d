"""The registered queries: with SQL in tests/test_queries.py, here the others against brute force on the smallest data."""

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from test_ngram_join import components
from voxward.llm.encoding import encoder, public_path
from voxward.llm.pii import find_entities
from voxward.llm.quality import MEASURES
from voxward.llm.quality import judge

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_there_is_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5


def test_op9(spark, docs):
    seen = set()
    got = {r.doc_id: r for r in entry.queries()["op9_suffix_array"](spark, SF).collect()}
    assert len(got) == len(docs)
    for i, text in sorted(docs):
        data = text.encode()
        cover = np.zeros(len(data) + 1, int)
        for p in range(len(data) - 99):
            window = data[p : p + 100]
            if window in seen:
                cover[p] += 1
                cover[p + 100] -= 1
            seen.add(window)
        gone = np.cumsum(cover[:-1]) > 0
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_op4_and_op8(spark, docs):
    encode = encoder(public_path("byte_bpe_50k.json")).encode
    ids = {i: encode(t) + b"\2\0\0\0" for i, t in docs}
    got = sorted(entry.queries()["op8_token_files"](spark, SF).collect(), key=lambda r: r.doc_id)
    start = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]) // 4, zlib.crc32(ids[r.doc_id]))
        start += r.n_tokens
    assert len(got) == len(docs)
    packed = entry.queries()["op4_best_fit_packing"](spark, SF).collect()
    assert sum(r.length for r in packed) == start
    assert all(zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for r in packed)
    assert len({r.sequence_id for r in packed}) <= 1.02 * -(-start // 1024)


def test_op10_finds_nearly_all_links(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    got = entry.queries()["op10_embedding_dedup"](spark, SF).toPandas().set_index("vec_id")
    links = 0
    for _, part in rows.groupby("label"):
        unit = np.stack(part.embedding).astype(float)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        n = (unit @ unit.T >= 0.93).sum(axis=1) - 1
        links += n.sum()
        assert (got.n_links[part.vec_id].to_numpy() <= n).all()
    assert len(got) == len(rows) and got.n_links.sum() >= 0.95 * links


def test_op12(spark):
    from test_whitening import check

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    check(entry.queries()["op12_embedding_whitening"](spark, SF), list(zip(rows["vec_id"], rows["embedding"], strict=True)))


def test_op13(spark, docs):
    from test_sharding import check

    sizes = check(entry.queries()["op13_sharding"](spark, SF), docs)
    whole = {}
    for _, t in docs:
        whole[t] = whole.get(t, 0) + len(t.encode()) + 8
    # A few hundred texts are too few for more, and what exceeds an equal share can't be balanced.
    assert max(sizes) - min(sizes) <= 0.02 * max(sizes) or max(sizes) == max(whole.values())


def test_pipeline_stages_against_brute_force(spark, docs):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in judge(raw).where("kept").collect()}
    table, columns = raw, raw.columns
    before = dict(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, SF)
        rows = table.collect()
        after = {r.doc_id: r.text for r in rows}
        assert table.columns == columns and len(after) == len(rows) and all(r.n_chars == len(r.text) for r in rows), name
        if name == "quality rules":
            assert set(after) == kept and all(after[i] == before[i] for i in after)
        elif name == "n-gram Jaccard join":
            root = components(sorted(before.items()), 5, 80)
            assert set(after) == set(root.values()) and all(after[i] == before[i] for i in after)
        elif name == "suffix-array dedup":
            seen = set()
            for i, text in sorted(before.items()):
                data = text.encode()
                gone = np.zeros(len(data), bool)
                for p in range(len(data) - 99):
                    if data[p : p + 100] in seen:
                        gone[p : p + 100] = True
                    seen.add(data[p : p + 100])
                assert after[i] == np.frombuffer(data, np.uint8)[~gone].tobytes().decode(errors="ignore")
        else:
            real = {before[i][a:b] for i in before for a, b, _ in find_entities(before[i])}
            assert real and not any(v in after[i] for i in after for v in random.Random(1).sample(sorted(real), min(len(real), 20)))
            assert all(after[i] == before[i] for i in after if not find_entities(before[i]))
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, table, SF).collect()
    encode = encoder(public_path("byte_bpe_50k.json")).encode
    assert sum(r.length for r in packed) == sum(len(encode(t)) // 4 + 1 for t in before.values())
    assert corpus_pipeline.run(spark, SF).count() == len(packed)


def test_measures_are_columns_of_the_query(spark):
    got = entry.queries()["op3_host_rules"](spark, SF)
    assert set(MEASURES) - {"n_lines"} <= set(got.columns)
