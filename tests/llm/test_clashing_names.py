"""Columns of a caller that are named like those the operators work with."""

import pytest
from pyspark.sql import functions as F

from voxward.llm.pii import replace_pii
from voxward.llm.quality import judge, keep_good
from voxward.llm.repeats import RepeatParams, remove_repeats

NAMES = ("_host", "_id", "_text", "_text_", "_doc", "_spans", "_changed")


@pytest.fixture
def clashing(documents):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{words} {i}") for i in range(10, 20)]  # so that the host's rates stay low
    rows += [(1, words), (2, words + " Mr John Smith"), (3, "short"), (4, None), (5, "a@b.com a@c.com"), (5, "a@b.com a@c.com")]
    return documents(rows).withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in NAMES})


def test_columns_stay(clashing):
    kept = keep_good(clashing)
    assert kept.columns == clashing.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, *range(10, 20)]
    for made in (judge(clashing), replace_pii(clashing), remove_repeats(clashing, RepeatParams(window=20, gram=8))):
        rows = made.collect()
        assert len(rows) == 16 and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in NAMES)
