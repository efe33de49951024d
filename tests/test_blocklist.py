import random
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest

from voxward.operators import caller, skew
from voxward.sources.blocklist import Blocklist
from voxward.sources.commits import CommitLog
from voxward.streaming.blocklist import apply_calls

D = datetime(2024, 1, 1)
FLAGGED = "phone_hash string, strike_count int, last_flagged_at timestamp"
CALLS = "call_id string, start_ts timestamp, end_ts timestamp, call_was_ai boolean, caller_hash string"


def day(n):
    return D + timedelta(days=n)


def content(df):
    return {r.phone_hash: (r.strike_count, r.last_flagged_at) for r in df.collect()}


def test_upsert_golden(spark):
    before = spark.createDataFrame([("a", 3, day(0)), ("b", 0, day(1)), ("n", None, day(2)), ("m", None, None)], FLAGGED)
    flags = spark.createDataFrame(
        [("a", day(5)), ("a", day(7)), ("c", day(6)), ("n", day(8))], "phone_hash string, end_ts timestamp"
    )
    assert content(caller.upsert_flags(before, flags)) == {
        "a": (5, day(7)), "b": (0, day(1)), "c": (1, day(6)), "n": (1, day(8)), "m": (None, None),
    }


def test_only_closed_ai_calls_with_a_caller_count(spark):
    rows = [
        ("1", day(0), day(1), True, "x"), ("2", day(0), None, True, "x"),
        ("3", day(0), day(1), False, "x"), ("4", day(0), day(1), True, None),
    ]
    assert caller.calls_to_flag(spark.createDataFrame(rows, CALLS)).count() == 1


def test_lookup_under_skew(spark):
    rng = random.Random(4)
    calls = [(str(i), rng.choice(["hot", "hot", None, f"h{rng.randrange(200)}"])) for i in range(2000)]
    listed = {"hot"} | {f"h{i}" for i in range(0, 200, 3)}
    right = spark.createDataFrame([(h, True) for h in listed], "caller_hash string, found boolean")
    left = spark.createDataFrame(calls, "call_id string, caller_hash string")
    got = skew.lookup(left, right, "caller_hash", "call_id").collect()
    assert len(got) == len(calls)
    assert all(bool(r.found) == (r.caller_hash in listed) for r in got)


def test_lookup_counts(spark):
    flagged = spark.createDataFrame([("x", 1, None), ("y", 0, None), ("z", None, None)], FLAGGED)
    calls = spark.createDataFrame([(h or "none", h) for h in ("x", "y", "z", "w", None)], "call_id string, caller_hash string")
    got = {r.call_id for r in caller.lookup_blocklist(calls, flagged).collect() if r.is_caller_flagged}
    assert got == {"x"}


def test_strikes_are_counted_once(spark, tmp_path):
    store = Blocklist(str(tmp_path / "list"))
    with pytest.raises(ValueError):  # neither created nor begun: perhaps a wrong path
        store.read(spark)
    store.create(spark.createDataFrame([("a", 3, day(0)), ("b", 0, day(1))], FLAGGED))
    flags = "phone_hash string, end_ts timestamp"
    store.add(spark.createDataFrame([("a", day(2)), ("c", day(3))], flags), "live", 0)
    for _ in range(2):  # the second batch runs twice
        store.add(spark.createDataFrame([("a", day(4)), ("a", day(5))], flags), "live", 1)
    store.add(spark.createDataFrame([("b", day(6))], flags), "other", 0)
    want = {"a": (6, day(5)), "b": (1, day(6)), "c": (1, day(3))}
    assert content(store.read(spark)) == want
    store.compact(spark, "live", 0)
    assert content(store.read(spark)) == want
    store.compact(spark, "live", 1)
    store.compact(spark, "other", 0)
    assert content(store.read(spark)) == want
    store.add(spark.createDataFrame([("c", day(9))], flags), "live", 2)
    assert content(store.read(spark))["c"] == (2, day(9))
    assert content(store.read(spark, "live", 2)) == want


def test_repeated_micro_batch_changes_nothing(spark, tmp_path):
    store = Blocklist(str(tmp_path / "list"))
    store.create(spark.createDataFrame([("x", 1, day(0))], FLAGGED))
    rows = [
        ("1", day(1), None, False, "x"), ("2", day(1), None, False, "q"),
        ("0", day(0), day(1), True, "q"), ("3", day(0), day(1), True, "x"),
    ]
    batch = spark.createDataFrame(rows, CALLS)
    for _ in range(2):
        apply_calls(batch, store, str(tmp_path / "alerts"), "live", 7)
    alerts = spark.read.parquet(str(tmp_path / "alerts"))
    assert [r.call_id for r in alerts.collect()] == ["1"]
    assert content(store.read(spark)) == {"x": (2, day(1)), "q": (1, day(1))}


def test_compactors_that_meet_lose_no_strike(spark, tmp_path, monkeypatch):
    """Each time one is about to log its version, another gets there first, and once two run in threads."""
    flags = "phone_hash string, end_ts timestamp"
    store = Blocklist(str(tmp_path / "list"))
    store.create(spark.createDataFrame([("a", 1, day(0))], FLAGGED))
    for job, number in (("one", "a"), ("two", "b"), ("three", "c")):
        for epoch in (0, 1):
            store.add(spark.createDataFrame([(number, day(epoch + 1))], flags), job, epoch)
    want = {"a": (3, day(2)), "b": (2, day(2)), "c": (2, day(2))}
    put, others = CommitLog.put, ["two", "three"]

    def overtaken(log, session, number, entry):
        if others:
            store.compact(session, others.pop(), 0)
        return put(log, session, number, entry)

    monkeypatch.setattr(CommitLog, "put", overtaken)
    store.compact(spark, "one", 0)
    monkeypatch.setattr(CommitLog, "put", put)
    log = CommitLog(str(tmp_path / "list" / "commits"))
    assert log.newest(spark)[0] == 4 and log.newest(spark)[1]["done"] == {"one": 0, "two": 0, "three": 0}
    assert content(store.read(spark)) == want
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda job: store.compact(spark, job, 1), ("one", "two", "three")))
    assert log.newest(spark)[1]["done"] == {"one": 1, "two": 1, "three": 1}
    assert content(store.read(spark)) == want
    store.compact(spark, "one", 0)  # folded already
    assert log.newest(spark)[0] == 7
    lost = len(list((tmp_path / "list" / "base").iterdir())) - 7
    assert lost >= 2 and store.clean(spark) == 0 and store.clean(spark, older_s=0) == lost
    assert content(store.read(spark)) == want


def test_a_half_written_version_is_never_read(spark, tmp_path):
    flags = "phone_hash string, end_ts timestamp"
    store = Blocklist(str(tmp_path / "list"))
    store.create(spark.createDataFrame([("a", 1, day(0))], FLAGGED))
    with pytest.raises(ValueError):
        store.create(spark.createDataFrame([("b", 1, day(0))], FLAGGED))
    store.add(spark.createDataFrame([("a", day(1))], flags), "one", 0)
    half = tmp_path / "list" / "base" / "00000002-lost"
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"PAR1")
    (tmp_path / "list" / "commits" / "_draft").write_text("{")
    store.compact(spark, "one", 0)
    assert content(store.read(spark)) == {"a": (2, day(1))}


def test_a_number_is_given_once(spark, tmp_path):
    log = CommitLog(f"file://{tmp_path}/log")
    assert log.newest(spark) == (0, None) and log.entries(spark) == {}
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: log.put(spark, 1, {"by": i}), range(16)))
    assert sum(won) == 1 and log.entries(spark) == {1: {"by": won.index(True)}}
