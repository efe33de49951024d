"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter

import pytest

from voxward.llm.collocations import PhraseParams, collocations

SCHEMA = "doc_id bigint, text string, lang string, path string, n string, phrase int, rank int"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, l, "own", None, 1, 2) for i, (t, l) in enumerate(rows)], SCHEMA).repartition(parts)


def plain(rows, least=10, covered=50, top=2000, widths=(2, 3)):
    counts, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, *widths):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows, longer = [], Counter()
        for q, a in found.items():
            for k in range(2, len(q)):
                for i in range(len(q) - k + 1):
                    longer[q[i : i + k]] = max(longer[q[i : i + k]], a)
        for p, a in found.items():
            if p in longer and 100 * longer[p] >= covered * a:
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def rows_of(found):
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert [f for f in found.columns] == columns
    return sorted(tuple(r) for r in found.collect())


def corpus(seed, docs=120, words=18):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "é", "x\x01", "ÀB", "\x00", "日本", "new", "york", "a" * 90, " ", "I'm", "<b>", "of-the"][:words]
    glue = [" ", " ", " ", " ", " ", "\t", "  ", ". ", ", ", "\n", "\r\n", "!", " ; ", "\x0b", "\x1f"]
    rows = []
    for _ in range(docs):
        text = "".join(rng.choice(vocabulary) + rng.choice(glue) for _ in range(rng.randrange(120)))
        rows.append((text + "New York City Hall" * (rng.random() < 0.3), rng.choice(["en", "fr", None, "und", "", "a b"])))
    return rows


@pytest.mark.parametrize(
    "seed,params",
    [
        (1, PhraseParams()),
        (2, PhraseParams(burst=3, held=40, words=9, piece_bytes=50, range_bytes=500)),
        (3, PhraseParams(burst=1, held=1, words=1, piece_bytes=1, range_bytes=100, sample=20, top=7, ranked=28)),
        (4, PhraseParams(min_count=3, covered=80, max_words=2, held=500, range_bytes=3000, ranges=4)),
    ],
)
def test_same_as_plain_counting(spark, seed, params):
    rows = corpus(seed)
    widths = (2, 3) if params.max_words == 3 else (2,)
    want = plain(rows, params.min_count, params.covered, params.top, widths)
    assert want and rows_of(collocations(table(spark, rows), params)) == want


def test_ranks_in_shares(spark):
    rng = random.Random(5)
    rows = [(" ".join(f"w{rng.randrange(300)}" for _ in range(60)), "en") for _ in range(600)]
    params = PhraseParams(min_count=1, top=5, ranked=20, covered=101)
    assert rows_of(collocations(table(spark, rows), params)) == plain(rows, 1, 101, 5)


def test_hot_phrases_and_repeated_rows(spark):
    rows = [("one two three four", "en")] * 200 + [("one two. three", None)] * 30 + [("one one one one", "en")] * 12
    want = plain(rows)
    got = rows_of(collocations(table(spark, rows, 7)))
    assert got == want and ("en", 1, "two three four", 200, 200, 200, 848, 1_000_000) in got


def test_nothing_to_find(spark):
    for rows in ([], [(None, None), ("", "en"), (" \t.", "fr")], [("a b " * 9 + ".", "en")]):
        assert rows_of(collocations(table(spark, rows))) == [] == plain(rows)


def test_a_long_text_in_one_piece(spark):
    rng = random.Random(6)
    rows = [(" ".join(rng.choice("abcdefgh") for _ in range(60_000)), "en"), ("z" * 300_000, "en")]
    assert rows_of(collocations(table(spark, rows), PhraseParams(piece_bytes=777, held=300, range_bytes=9000))) == plain(rows)


def test_pairs_over_many_batches(spark):
    rows = corpus(7, docs=60) + [("one two " + w, "en") for w in "abc" for _ in range(30)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = rows_of(collocations(table(spark, rows), PhraseParams(merge_rows=20, range_bytes=2000)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == plain(rows)
