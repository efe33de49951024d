import random
from datetime import datetime, timedelta

import pytest

from voxward.operators import calls
from voxward.operators.timeline import Timeline

T0 = datetime(2024, 3, 1)
POLLS = "host_id string, poll_ts timestamp, has_voip_audio boolean, mic_active boolean"
GOLDEN = [(1, 0), (1, 1), (1, 0), (0, 0), (1, 0), (0, 1), (1, 1), (0, 0)]


def at(s):
    return T0 + timedelta(seconds=s)


def polls(spark, rows):
    return spark.createDataFrame([(h, at(s), bool(a), bool(m)) for h, s, a, m in rows], POLLS)


def fold(rows, require_mic=True):
    """State after each poll, call edges and sessions, one poll at a time."""
    state, number, active, edges, sessions = {}, {}, {}, {}, {}
    for h, s, a, m in sorted(rows):
        was = state.get(h, False)
        if not a:
            now = False
        elif not require_mic or m:
            now = True
        else:
            now = was
        state[h], active[h, at(s)] = now, now
        if now and not was:
            number[h] = number.get(h, 0) + 1
            edges[h, at(s)] = "start"
            sessions[f"{h}#{number[h]}"] = [at(s), None]
        elif was and not now:
            edges[h, at(s)] = "end"
            sessions[f"{h}#{number[h]}"][1] = at(s)
    return active, edges, sessions


def random_polls(seed, hosts=5, hot=400):
    rng = random.Random(seed)
    rows = []
    for h in range(hosts):
        s = 0
        for _ in range(hot if h == 0 else 60):
            s += rng.randint(1, 5)
            rows.append((f"h{h}", s, rng.random() < 0.75, rng.random() < 0.3))
    return rows


def test_golden_latch(spark):
    rows = [("h", i, a, m) for i, (a, m) in enumerate(GOLDEN)]
    got = calls.call_edges(calls.latch(polls(spark, rows))).orderBy("poll_ts").collect()
    assert [r.active for r in got] == [False, True, True, False, False, False, True, False]
    assert [r.edge for r in got] == [None, "start", None, "end", None, None, "start", "end"]


@pytest.mark.parametrize("require_mic", [True, False])
@pytest.mark.parametrize("width", [None, 1, 7, 60, 3600])
def test_latch_edges_and_sessions_equal_fold(spark, width, require_mic):
    rows = random_polls(width or 0)
    line = Timeline(("host_id",), ("poll_ts",), width)
    latched = calls.call_edges(calls.latch(polls(spark, rows), require_mic, line))
    active, edges, sessions = fold(rows, require_mic)
    got = latched.collect()
    assert {(r.host_id, r.poll_ts): r.active for r in got} == active
    assert {(r.host_id, r.poll_ts): r.edge for r in got if r.edge} == edges
    found = calls.call_sessions(latched, line).collect()
    assert {r.call_id: [r.start_ts, r.end_ts] for r in found} == sessions
    for r in found:
        want = (r.end_ts - r.start_ts).total_seconds() if r.end_ts else None
        assert r.duration_s == want


@pytest.mark.parametrize("width", [None, 2, 45])
def test_frames_belong_to_the_running_call(spark, width):
    rows = random_polls(3)
    _, _, sessions = fold(rows)
    rng = random.Random(8)
    frames = [(f"h{rng.randrange(5)}", at(rng.randrange(1300)), i) for i in range(500)]
    frames += [(c.split("#")[0], s[0], 1000 + i) for i, (c, s) in enumerate(sessions.items())]
    frame_df = spark.createDataFrame(frames, "host_id string, captured_at timestamp, frame_seq int")
    call_df = spark.createDataFrame(
        [(c, c.split("#")[0], s, e) for c, (s, e) in sessions.items()],
        "call_id string, host_id string, start_ts timestamp, end_ts timestamp",
    )
    got = calls.assign_calls(frame_df, call_df, tie=("frame_seq",), width=width)
    want = {
        (i, c) for h, t, i in frames for c, (s, e) in sessions.items()
        if c.split("#")[0] == h and s <= t and (e is None or t < e)
    }
    assert {(r.frame_seq, r.call_id) for r in got.collect()} == want
