"""Measures against plain Python, and host verdicts."""

import random
import re

from voxward.llm.quality import MEASURES, QualityParams, judge, keep_good, with_measures

WORDS = re.compile("[^\x20\x09-\x0d]+")


def measures(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {i for i, w in enumerate(windows) if windows.count(w) > 1}
    return (
        len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)),
        len({i + k for i in again for k in range(3)}),
    )


def test_measures(documents):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["a ", "bé ", "c\n", "\n", "#|", "\x0b", " ", "d\te ", "a b c "]) for _ in range(rng.randrange(60)))) for i in range(60)]
    rows += [(900, None), (901, ""), (902, "x"), (903, "a b c " * 20_000), (None, "a b")]
    got = {(r.doc_id, r.lang): tuple(r[m] for m in MEASURES) for r in with_measures(documents(rows)).collect()}
    assert got == {(i, "en"): measures(t) for i, t in rows if i != 903} | {(903, "en"): (60_000, 60_000, 0, 1, 0, 60_000)}


def good(i):
    return " ".join(f"word{i}x{k}" for k in range(60))


def test_a_bad_host_loses_its_good_documents(documents):
    bad = [(i, "bad " * 60, "bad") for i in range(40)] + [(100, good(100), "bad")]
    fine = [(200 + i, good(i), f"h{i % 5}") for i in range(200)]
    # One failed document says little about a host with one document.
    small = [(900, "short text", "small"), (901, good(901), None)]
    got = {r.doc_id: r for r in judge(documents(bad + fine + small)).collect()}
    assert not got[100].base_failed and got[100].host_rejected and not got[100].kept
    assert all(got[200 + i].kept for i in range(200)) and got[901].kept
    assert got[900].base_failed and not got[900].host_rejected
    kept = keep_good(documents(bad + fine + small))
    assert {r.doc_id for r in kept.collect()} == {200 + i for i in range(200)} | {901}
    assert kept.columns == documents([]).columns


def test_the_limit_is_a_parameter(documents):
    rows = [(i, good(i) if i % 4 else "short", "h") for i in range(80)]
    params = QualityParams(host_limit=0.2)
    assert not any(r.kept for r in judge(documents(rows), params).collect())
    assert sum(r.kept for r in judge(documents(rows)).collect()) == 60


def test_repeated_rows_and_an_empty_table(documents):
    rows = [(1, good(1)), (1, good(1)), (1, "short"), (None, good(2)), (None, None)]
    assert sorted(str(r.doc_id) for r in keep_good(documents(rows)).collect()) == ["1", "1", "None"]
    assert judge(documents([])).count() == 0 and keep_good(documents([])).count() == 0
