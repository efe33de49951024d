"""Every registered query against its SQL, also with chunks of a few rows."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry
from compare import connect, differences
from voxward.operators import timeline

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
ORDERED = (
    "hysteresis_latch loose_latch call_edges call_sessions frames_in_calls fixed_frames align_scores"
    " decision_engine buffer_scores call_rollup alerts call_report"
).split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert len(got) and differences(got, con.execute(SQL[name]).df()) is None


@pytest.mark.parametrize("name", ORDERED)
def test_same_in_small_chunks(spark, con, name, monkeypatch):
    monkeypatch.setattr(timeline, "WIDTHS", {"time": 600.0, "number": 3.0})
    got = entry.queries()[name](spark, SF).toPandas()
    assert differences(got, con.execute(SQL[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL)))
def test_without_sql(spark, name, monkeypatch):
    from voxward.plans import adapters

    monkeypatch.setattr(adapters.pcm_tones, "__defaults__", (750, 16_000))
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
