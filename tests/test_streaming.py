"""Streams give what the batch operators give, over several shuffled micro-batches."""

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from test_calls import fold
from test_decision import replay
from voxward.operators.calls import assign_calls, call_edges, call_sessions, latch
from voxward.operators.decision import align_scores, buffer_scores, current_state, decision_engine
from voxward.operators.framing import latest_n
from voxward.operators.rollup import call_rollup, complete_calls, voice_alerts
from voxward.operators.timeline import Timeline
from voxward.params import MIC_CONSENT_ROOT, DecisionParams
from voxward.schemas import TELEMETRY
from voxward.sources.alerts import AlertSink
from voxward.sources.blocklist import Blocklist
from voxward.streaming.alerts import voice_alert_stream
from voxward.streaming.align import align_stream
from voxward.streaming.blocklist import blocklist_stream
from voxward.sources.warnings import WarningLog
from voxward.streaming.caller import caller_id_stream, caller_warning_stream
from voxward.streaming.decisions import decision_history, decision_stream, running_state
from voxward.session import closed
from voxward.sources.telemetry import read_telemetry
from voxward.streaming.frames import frames_in_calls_stream
from voxward.streaming.monitor import call_monitor_stream, poll_status_stream
from voxward.streaming.recent import latest_n_stream, newest_frames
from voxward.streaming.rollup import rollup_stream

T0 = datetime(2024, 3, 1)
LATER = T0 + timedelta(days=2)
EDGES = "call_id string, host_id string, edge string, start_ts timestamp, end_ts timestamp"
POLLS = "host_id string, poll_ts timestamp, has_voip_audio boolean, mic_active boolean"


def files(spark, rows, schema, path, parts, late=20):
    """Rows as files of neighbouring rows, each up to ``late`` rows out of order, then a far-off row."""
    rng = random.Random(2)
    order = sorted(range(len(rows)), key=lambda i: i + rng.uniform(0, late))
    rows = [rows[i] for i in order]
    size = -(-len(rows) // parts)
    for p in range(parts):
        part = rows[p * size : (p + 1) * size]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)


def run(spark, stream, name, tmp_path):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(300)
    return spark.table(name)


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("require_mic", [True, False])
def test_monitor(spark, tmp_path, require_mic):
    rng, rows = random.Random(6), []
    for s in range(150):
        for h in ("a", "b", "c"):
            rows.append((h, s, rng.random() < 0.75, rng.random() < 0.3))
    _, _, sessions = fold(rows, require_mic)
    schema = "host_id string, poll_ts timestamp, has_voip_audio boolean, mic_active boolean"
    stored = [(h, T0 + timedelta(seconds=s), a, m) for h, s, a, m in rows]
    path = str(tmp_path / "in")
    files(spark, stored, schema, path, 3)
    spark.createDataFrame([("z", LATER, False, False)], schema).coalesce(1).write.mode("append").parquet(path)
    events = call_monitor_stream(source(spark, path, schema), require_mic)
    got = run(spark, events, f"mon_{require_mic}".lower(), tmp_path).collect()
    starts = {r.call_id: r.start_ts for r in got if r.edge == "start"}
    ends = {r.call_id: r.end_ts for r in got if r.edge == "end"}
    assert starts == {c: s for c, (s, _) in sessions.items()}
    assert ends == {c: e for c, (_, e) in sessions.items() if e}


def test_monitor_from_raw_telemetry(spark, tmp_path):
    rng, sessions, mic, rows, running = random.Random(4), [], [], [], []
    for s in range(60):
        audio, used = rng.random() < 0.7, rng.random() < 0.4
        rows.append(("h", s, audio, audio and used))
        at = T0 + timedelta(seconds=s)
        sessions.append(("h", at, "render", 0, int(audio), 5, "zoom.exe", ["zoom.exe"]))
        mic.append(("h", at, MIC_CONSENT_ROOT + "\\App", 2, 1 if used else 3))
        running.append(("h", at, 1, "explorer.exe", ["explorer.exe"]))
    _, _, want = fold(rows)
    for end in (LATER, LATER + timedelta(days=1), LATER + timedelta(days=2)):
        sessions.append(("z", end, "render", 0, 0, 5, "x", ["x"]))
        mic.append(("z", end, MIC_CONSENT_ROOT + "\\App", 2, 3))
        running.append(("z", end, 1, "explorer.exe", ["explorer.exe"]))
    tables = []
    for name, data in (("audio_session_poll", sessions), ("process_poll", running), ("mic_usage_poll", mic)):
        path, schema = str(tmp_path / name), TELEMETRY[name]
        for part in (data[:30], data[30:60], *([r] for r in data[60:])):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        tables.append(read_telemetry(spark, name, path, streaming=True, files_per_batch=1))
    events = call_monitor_stream(poll_status_stream(*tables), delay=None)
    got = run(spark, events, "raw", tmp_path).collect()
    assert {r.call_id: r.start_ts for r in got if r.edge == "start"} == {c: s for c, (s, _) in want.items()}
    assert {r.call_id: r.end_ts for r in got if r.edge == "end"} == {c: e for c, (_, e) in want.items() if e}


def test_decisions(spark, tmp_path):
    rng, rows = random.Random(9), []
    p = DecisionParams()
    for i in range(1, 121):
        for c in ("a", "b"):
            cnn, gmm = (None if rng.random() < 0.2 else rng.random() ** 0.4 for _ in "ab")
            rows.append((c, i, cnn, gmm))
    want = replay(rows, p)
    schema = "call_id string, update_seq bigint, update_ts timestamp, cnn double, gmm double"
    stored = [(c, i, T0 + timedelta(seconds=i), a, b) for c, i, a, b in rows]
    path = str(tmp_path / "in")
    files(spark, stored, schema, path, 3)
    spark.createDataFrame([("z", 1, LATER, 0.0, 0.0)], schema).coalesce(1).write.mode("append").parquet(path)
    got = run(spark, decision_stream(source(spark, path, schema), p), "dec", tmp_path).collect()
    assert len(got) == len(rows)
    seen = {
        (r.call_id, r.update_seq): (round(r.average_score, 9), r.label, r.should_notify, r.buffer_full, r.frames_buffered)
        for r in got
    }
    assert seen == want and any(v[2] for v in want.values())
    ever = {c: any(v[1] == "AI Generated" for (k, _), v in want.items() if k == c) for c in "ab"}
    last = {r.call_id: r.call_was_ai for r in sorted(got, key=lambda r: r.update_seq)}
    assert last == ever


def test_decisions_with_carried_scores(spark, tmp_path):
    rng = random.Random(12)
    results = [
        ("a", i, T0 + timedelta(seconds=i), rng.choice(["cnn", "gmm"]), rng.uniform(0, 100)) for i in range(1, 61)
    ]
    batch = spark.createDataFrame(
        results, "call_id string, tick bigint, result_ts timestamp, model string, confidence_pct double"
    )
    aligned = align_scores(batch).withColumnRenamed("tick", "update_seq")
    want = {r.update_seq: (round(r.average_score, 9), r.label) for r in decision_engine(aligned).collect()}
    schema = "call_id string, update_seq bigint, update_ts timestamp, cnn double, gmm double"
    stored = [
        (c, i, ts, v / 100 if m == "cnn" else None, v / 100 if m == "gmm" else None) for c, i, ts, m, v in results
    ] + [("z", 1, LATER, None, None)]
    path = str(tmp_path / "in")
    spark.createDataFrame(stored[:-1], schema).repartition(1).write.mode("append").parquet(path)
    spark.createDataFrame(stored[-1:], schema).coalesce(1).write.mode("append").parquet(path)
    stream = decision_stream(source(spark, path, schema), fill=True)
    got = run(spark, stream, "filled", tmp_path).collect()
    assert {r.update_seq: (round(r.average_score, 9), r.label) for r in got} == want


def test_idle_calls_are_forgotten(spark, tmp_path):
    """Only a long pause resets a call, however many timers fire together."""
    schema = "call_id string, update_seq bigint, update_ts timestamp, cnn double, gmm double"
    path = str(tmp_path / "in")
    bursts = [range(0, 4), range(10, 14), range(20, 23), range(2000, 2003)]
    files_ = [[("a", s, T0 + timedelta(seconds=s), 0.9, 0.9) for s in burst] for burst in bursts]
    ends = [[("z", n, LATER + timedelta(days=n), 0.0, 0.0)] for n in range(3)]
    for rows in files_ + ends:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = decision_stream(source(spark, path, schema), delay="5 minutes", idle_s=600)
    got = run(spark, stream, "idle", tmp_path).filter("call_id = 'a'").collect()
    seqs = [r.update_seq for r in sorted(got, key=lambda r: r.update_ts)]
    assert seqs == [*range(1, 12), 1, 2, 3]
    assert [r.ts.second for r in voice_alerts(spark.createDataFrame(got)).collect()] == [10]


def test_blocklist_job(spark, tmp_path):
    store = Blocklist(str(tmp_path / "list"))
    store.create(spark.createDataFrame([("x", 1, T0)], "phone_hash string, strike_count int, last_flagged_at timestamp"))
    schema = "call_id string, start_ts timestamp, end_ts timestamp, call_was_ai boolean, caller_hash string"
    path = str(tmp_path / "in")
    batches = [
        [("1", T0, None, False, "x"), ("2", T0, None, False, "y")],
        [("1", T0, T0, True, "x"), ("2", T0, T0, True, "y")],
        [("3", T0, None, False, "y")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    query = blocklist_stream(
        source(spark, path, schema), store, str(tmp_path / "alerts"), str(tmp_path / "cp"), "live"
    )
    query.awaitTermination(300)
    assert query.exception() is None
    alerts = sorted(r.call_id for r in spark.read.parquet(str(tmp_path / "alerts")).collect())
    assert alerts == ["1", "3"]
    counts = {r.phone_hash: r.strike_count for r in store.read(spark).collect()}
    assert counts == {"x": 2, "y": 1}


def test_nan_and_null_are_told_apart_as_in_batch(spark, tmp_path):
    schema = "call_id string, update_ts timestamp, update_seq int, cnn double, gmm double"
    values = [float("nan")] * 6 + [None] * 6 + [0.5] * 6
    rows = [(c, T0 + timedelta(seconds=i), i, v, None) for c in ("a", "b") for i, v in enumerate(values)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    stream = decision_stream(closed(source(spark, path, schema), "update_ts", "call_id"))
    fields = ("label", "should_notify", "buffer_full", "frames_buffered")
    got = {(r.call_id, r.update_seq): [r[f] for f in fields] for r in run(spark, stream, "nan", tmp_path).collect()}
    batch = decision_engine(spark.createDataFrame(rows, schema)).collect()
    assert got == {(r.call_id, r.update_seq + 1): [r[f] for f in fields] for r in batch}
    assert any(label == "AI Generated" for label, *_ in got.values())


@pytest.mark.parametrize("require_mic", [True, False])
def test_unknown_audio_keeps_the_state_as_in_batch(spark, tmp_path, require_mic):
    schema = "host_id string, poll_ts timestamp, has_voip_audio boolean, mic_active boolean"
    told = [(None, True), (True, True), (None, None), (True, None), (False, True), (None, True), (True, None), (None, None)]
    rows = [("h", T0 + timedelta(seconds=s), a, m) for s, (a, m) in enumerate(told)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    events = call_monitor_stream(closed(source(spark, path, schema), "poll_ts", "host_id"), require_mic)
    got = {(r.edge, r.end_ts or r.start_ts) for r in run(spark, events, f"unknown_{require_mic}".lower(), tmp_path).collect()}
    edges = call_edges(latch(spark.createDataFrame(rows, schema), require_mic)).where("edge IS NOT NULL").collect()
    assert got == {(r.edge, r.poll_ts) for r in edges}


def rows_left(spark, checkpoint, operator=0, name="state"):
    """Keys that still have state in a checkpoint."""
    return spark.read.format("statestore").option("operatorId", operator).option("stateVarName", name).load(checkpoint)


def test_frames_in_live_calls(spark, tmp_path):
    rng, polls, frames = random.Random(16), [], []
    for s in range(120):
        for h in ("a", "b", "c"):
            polls.append((h, T0 + timedelta(seconds=s), rng.random() < 0.8, rng.random() < 0.4))
            frames += [(h, T0 + timedelta(seconds=s, milliseconds=m), len(frames), "path") for m in (0, rng.randrange(1000))]
    polls += [("z", LATER, None, None)]
    frames += [("z", LATER, -1, None)]
    found = call_sessions(call_edges(latch(spark.createDataFrame(polls[:-1], POLLS))))
    edges = found.select("call_id", "host_id", F.lit("start").alias("edge"), "start_ts", F.lit(None).cast("timestamp").alias("end_ts"))
    ends = found.where("end_ts IS NOT NULL").select("call_id", "host_id", F.lit("end"), "start_ts", "end_ts")
    far = (None, "z", None, LATER, None)
    rows = [tuple(r) for r in edges.union(ends).collect()] + [far]
    kinds = "host_id string, captured_at timestamp, frame_seq bigint, audio string"
    files(spark, rows[:-1], EDGES, str(tmp_path / "edges"), 3, late=5)
    files(spark, rows[-1:], EDGES, str(tmp_path / "edges"), 1)
    files(spark, frames[:-1], kinds, str(tmp_path / "frames"), 4)
    files(spark, frames[-1:], kinds, str(tmp_path / "frames"), 1)
    stream = frames_in_calls_stream(
        source(spark, str(tmp_path / "frames"), kinds), source(spark, str(tmp_path / "edges"), EDGES), tie="frame_seq", delay="10 minutes"
    )
    got = run(spark, stream, "live_frames", tmp_path).select("call_id", "host_id", "captured_at", "frame_seq", "audio").collect()
    want = assign_calls(spark.createDataFrame(frames[:-1], kinds), found).select("call_id", "host_id", "captured_at", "frame_seq", "audio")
    assert sorted(got) == sorted(want.collect()) and got
    # State is left for hosts whose call is still on, and for the far-off row.
    open_hosts = {r.host_id for r in found.where("end_ts IS NULL").collect()}
    assert {r.key.host_id for r in rows_left(spark, str(tmp_path / "cp")).collect()} == open_hosts | {"z"}


def test_live_rollup_clears_ended_calls(spark, tmp_path):
    rng, rows, ends = random.Random(17), [], []
    for c in range(12):
        n = rng.randrange(0, 40)
        for i in range(n):
            cnn, gmm = (None if rng.random() < 0.2 else rng.random() ** 0.5 for _ in "ab")
            rows.append((f"c{c}", T0 + timedelta(seconds=i), i, cnn, gmm, [True, False, False, None][rng.randrange(4)]))
        if c % 4:
            ends.append((f"c{c}", T0 + timedelta(seconds=max(0, n - 1))))
    kinds = "call_id string, ts timestamp, frame_seq bigint, cnn double, gmm double, is_silent boolean"
    rng.shuffle(rows)
    files(spark, rows, kinds, str(tmp_path / "rows"), 3, late=200)
    files(spark, [("z", LATER, 0, None, None, None)], kinds, str(tmp_path / "rows"), 1)
    files(spark, ends, "call_id string, end_ts timestamp", str(tmp_path / "ends"), 2)
    files(spark, [("z", LATER)], "call_id string, end_ts timestamp", str(tmp_path / "ends"), 1)
    stream = rollup_stream(
        source(spark, str(tmp_path / "rows"), kinds), source(spark, str(tmp_path / "ends"), "call_id string, end_ts timestamp"), delay="1 hour"
    )
    columns = ["call_id", "call_was_ai", "frames_processed", "last_label", "last_confidence"]
    got = sorted(run(spark, stream, "live_rollups", tmp_path).select(columns).collect())
    frames = spark.createDataFrame(rows, kinds)
    decided = decision_engine(frames.where("NOT is_silent"), order=("ts", "frame_seq"))
    rolled = call_rollup(decided, frames, order=("ts", "frame_seq"))
    ended = spark.createDataFrame(ends, "call_id string, end_ts timestamp")
    want = sorted(complete_calls(ended, rolled).select(columns).collect())
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert [r[4] for r in got] == pytest.approx([r[4] for r in want], nan_ok=True)
    left = {r.key.call_id for r in rows_left(spark, str(tmp_path / "cp")).collect()}
    assert left == {"z"} | {r[0] for r in rows if int(r[0][1:]) % 4 == 0}


@pytest.mark.parametrize("mode,tick", [("per_result", 100), ("per_result", 7000), ("per_frame", 1000)])
def test_live_align(spark, tmp_path, mode, tick):
    rng, rows = random.Random(18), []
    for i in range(400):
        at = T0 + timedelta(milliseconds=rng.randrange(0, 60_000, 50))
        rows.append((f"c{i % 3}", at, i, rng.choice(["cnn", "gmm", "other"]), None if rng.random() < 0.2 else rng.random() * 100))
    kinds = "call_id string, result_ts timestamp, seq bigint, model string, confidence_pct double"
    files(spark, rows, kinds, str(tmp_path / "in"), 4, late=300)
    files(spark, [("z", LATER, 0, None, None)], kinds, str(tmp_path / "in"), 1)
    stream = align_stream(source(spark, str(tmp_path / "in"), kinds), tick, mode, tie="seq", delay="1 hour", idle_s=None)
    got = run(spark, stream, f"live_align_{mode}_{tick}", tmp_path).collect()
    known, want = {}, []
    for key in sorted({(c, int(t.timestamp() * 1000) // tick) for c, t, *_ in rows}):
        here = [r for r in rows if (r[0], int(r[1].timestamp() * 1000) // tick) == key]
        news = {}
        for _, t, i, model, value in sorted(here, key=lambda r: r[1:3]):
            news[model] = None if value is None else value / 100
        if mode == "per_result":
            known.setdefault(key[0], {}).update({m: v for m, v in news.items() if v is not None})
            news = known[key[0]]
        want.append((*key, max(r[1] for r in here), news.get("cnn"), news.get("gmm")))
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == want
    assert rows_left(spark, str(tmp_path / "cp"), name="slots").where("key.call_id != 'z'").count() == 0


def test_voice_alerts_are_delivered_once(spark, tmp_path):
    """A replay with a new checkpoint, and another job over the same calls, add nothing."""
    rng = random.Random(19)
    rows = [(f"c{c}", T0 + timedelta(seconds=i), i, 1.0 if i // 9 % 2 else 0.1, None) for c in range(3) for i in range(60)]
    kinds = "call_id string, update_ts timestamp, update_seq bigint, cnn double, gmm double"
    rng.shuffle(rows)
    files(spark, rows, kinds, str(tmp_path / "in"), 2, late=50)
    files(spark, [("z", LATER, 0, None, None)], kinds, str(tmp_path / "in"), 1)
    sink = AlertSink(str(tmp_path / "alerts"))
    with pytest.raises(ValueError):
        sink.read(spark)
    for job, checkpoint in (("voices", "a"), ("voices", "b"), ("others", "c")):
        decisions = decision_stream(source(spark, str(tmp_path / "in"), kinds), delay="1 hour")
        query = voice_alert_stream(decisions, sink, str(tmp_path / checkpoint), job)
        query.awaitTermination(300)
        assert query.exception() is None
        got = sorted((r.call_id, r.ts, r.update_seq) for r in sink.read(spark).collect())
        assert got == [(f"c{c}", T0 + timedelta(seconds=s - 1), s) for c in range(3) for s in (13, 31, 49)]
        assert spark.read.parquet(sink.path).count() == len(got)


def test_alerts_of_jobs_do_not_replace_each_other(spark, tmp_path):
    kinds = "call_id string, ts timestamp, kind string, update_seq bigint"
    sink = AlertSink(str(tmp_path / "alerts"))
    one = spark.createDataFrame([("a", T0, "call_ended", None), ("a", T0, "ai_voice", 3), ("a", T0, "ai_voice", 3)], kinds)
    two = spark.createDataFrame([("a", T0, "call_ended", 0), ("a", T0, "ai_voice", 4), ("b", LATER, "ai_voice", 3)], kinds)
    for _ in range(2):  # both batches run twice
        sink.deliver(one, "1", 0)
        sink.deliver(two, "2", 0)
    sink.deliver(one.limit(0), "1", 1)
    want = [("a", "ai_voice", 3), ("a", "ai_voice", 4), ("a", "call_ended", 0), ("b", "ai_voice", 3)]
    assert sorted((r.call_id, r.kind, r.update_seq) for r in sink.read(spark).collect()) == want
    assert spark.read.parquet(sink.path).count() == 4


TEXTS = "call_id string, seen_ts timestamp, window_name string, walk_ordinal int, depth int, text string"


def test_caller_at_call_start(spark, tmp_path):
    def at(s):
        return T0 + timedelta(seconds=s)

    voice, video = "Voice call", "Video call"
    texts = [
        # The first window counts, even where only the second one shows a number.
        ("a", at(5), video, 0, 1, "+1 555 000 1111"), ("a", at(5), voice, 1, 1, "Mute"),
        ("a", at(9), voice, 2, 1, "+49 170 1234567"), ("a", at(9), voice, 1, 16, "+49 170 7654321"), ("a", at(9), voice, 3, 1, "+49 170 0000000"),
        ("a", at(12), voice, 1, 1, "+49 170 9999999"),
        # Shown before the start, after the limit and after the end.
        ("b", at(0), voice, 1, 1, "+49 170 1111111"), ("b", at(60), voice, 1, 1, "+49 170 1111111"),
        ("c", at(30), video, 1, 1, "+49 170 2222222"), ("c", at(30), "Chat", 1, 1, "+49 170 3333333"),
        ("d", at(40), voice, 1, 1, "+49 170 4444444"),
        ("e", at(3), voice, 1, 1, None), ("e", at(3), None, 1, 1, "+49 170 5555555"), ("e", None, voice, 1, 1, "+49 170 5555555"),
        (None, at(3), voice, 1, 1, "+49 170 6666666"),
        ("z", LATER, None, None, None, None),
    ]
    spans = {"a": (5, 90), "b": (10, 70), "c": (30, 31), "d": (20, 39), "e": (3, None)}
    edges = [(c, "h", "start", at(s), None) for c, (s, _) in spans.items()]
    edges += [(c, "h", "end", at(s), at(e)) for c, (s, e) in spans.items() if e] + [("x", "h", "end", None, at(50))]
    for name, rows, kind in (("texts", texts[:-1], TEXTS), ("edges", edges, EDGES)):
        files(spark, rows, kind, str(tmp_path / name), 3, late=4)
    files(spark, texts[-1:], TEXTS, str(tmp_path / "texts"), 1)
    files(spark, [(None, "z", None, LATER, None)], EDGES, str(tmp_path / "edges"), 1)
    stream = caller_id_stream(
        source(spark, str(tmp_path / "texts"), TEXTS), source(spark, str(tmp_path / "edges"), EDGES), wait_s=30, delay="10 minutes"
    )
    got = {(r.call_id, r.end_ts): (r.start_ts, r.caller_hash) for r in run(spark, stream, "callers", tmp_path).collect()}
    number = {"a": "+491701234567", "c": "+491702222222"}
    want = {}
    for c, (s, e) in spans.items():
        hashed = hashlib.sha256(number[c].encode()).hexdigest() if c in number else None
        want |= {(c, t): (at(s), hashed) for t in {None, e and at(e)}}
    assert got == want
    # A call that is on and what waits at the far end are all that is left.
    assert {r.key.call_id for r in rows_left(spark, str(tmp_path / "cp")).collect()} - {None} == {"e", "z"}


def test_caller_warnings_from_start_to_end(spark, tmp_path):
    listed, other = (hashlib.sha256(n.encode()).hexdigest() for n in ("+491701234567", "+491707654321"))
    store, log = Blocklist(str(tmp_path / "list")), WarningLog(str(tmp_path / "warnings"))
    store.create(spark.createDataFrame([(listed, 2, T0), (other, 0, T0)], "phone_hash string, strike_count int, last_flagged_at timestamp"))
    kind = "call_id string, start_ts timestamp, end_ts timestamp, caller_hash string"
    first = [("a", T0, None, listed), ("b", T0, None, other), ("c", T0, None, None), ("d", T0, None, listed)]
    for i, rows in enumerate((first, [("a", T0, LATER, listed), ("c", T0, LATER, None)])):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "calls"))
        calls = source(spark, str(tmp_path / "calls"), kind)
        caller_warning_stream(calls, store, log, str(tmp_path / "cp"), "w").awaitTermination()
        want = [("a", T0, LATER if i else None), ("d", T0, None)]
        assert sorted(map(tuple, log.read(spark).collect())) == want
    # A second job over the same calls shows nothing twice.
    caller_warning_stream(source(spark, str(tmp_path / "calls"), kind), store, log, str(tmp_path / "cp2"), "v").awaitTermination()
    assert sorted(map(tuple, log.read(spark).collect())) == want


@pytest.mark.parametrize("fill", [False, True])
def test_decisions_resumed_from_history(spark, tmp_path, fill):
    rng, rows = random.Random(21), []
    for i in range(60):
        for c in ("a", "b", "late") if i > 40 else ("a", "b"):
            cnn, gmm = (None if rng.random() < 0.4 else rng.random() ** 0.4 for _ in "ab")
            rows.append((c, T0 + timedelta(seconds=i), i, cnn, gmm))
    rows += [("gone", T0, 0, 0.9, None)]
    kinds = "call_id string, update_ts timestamp, update_seq bigint, cnn double, gmm double"
    order = ("update_ts", "update_seq")
    everything = spark.createDataFrame(rows, kinds)
    line = Timeline(("call_id",), order)
    filled = everything
    if fill:
        filled = line.last_known(everything, _c="cnn", _g="gmm").select("call_id", *order, F.col("_c").alias("cnn"), F.col("_g").alias("gmm"))
    cut = T0 + timedelta(seconds=30)
    history = decision_history(buffer_scores(filled.where(F.col("update_ts") < cut), order=order), order, fill)
    files(spark, [r for r in rows if r[1] >= cut], kinds, str(tmp_path / "in"), 3)
    files(spark, [("z", LATER, 0, None, None)], kinds, str(tmp_path / "in"), 1)
    stream = decision_stream(source(spark, str(tmp_path / "in"), kinds), fill=fill, idle_s=None, history=history)
    got = run(spark, stream, f"resumed_{fill}".lower(), tmp_path).collect()
    whole = line.number(decision_engine(filled, order=order), "n").where(F.col("update_ts") >= cut).collect()
    want = {(r.call_id, r.n): (r.label, r.should_notify, r.frames_buffered, round(r.average_score, 9)) for r in whole}
    assert {(r.call_id, r.update_seq): (r.label, r.should_notify, r.frames_buffered, round(r.average_score, 9)) for r in got} == want
    # The state of the job is the state of all calls, those without new updates too.
    state = running_state(spark, str(tmp_path / "cp"), calls=spark.createDataFrame([("a",), ("b",), ("late",), ("gone",), ("none",)], "call_id string"))
    known = current_state(decision_engine(filled, order=order), spark.createDataFrame([("none",)], "call_id string").union(everything.select("call_id").distinct()), order=order)
    found = [sorted((r.call_id, round(r.average_score, 9), r.label, r.frames_buffered) for r in df.collect()) for df in (state, known)]
    assert found[0] == found[1]


def test_calls_with_history_of_polls(spark, tmp_path):
    on = T0 - timedelta(minutes=5)
    history = spark.createDataFrame([("h", True, 4, on, on), ("i", False, 0, None, on)], "host_id string, active boolean, ordinal bigint, s timestamp, t timestamp")
    history = history.select("host_id", "active", "ordinal", F.unix_micros("s").alias("start_us"), F.unix_micros("t").alias("seen"))
    polls = [("h", T0, True, None), ("h", T0 + timedelta(seconds=1), False, None), ("h", T0 + timedelta(seconds=2), True, True)]
    polls += [("i", T0, True, True), ("z", LATER, None, None)]
    for p in polls:
        files(spark, [p], POLLS, str(tmp_path / "polls"), 1)
    events = call_monitor_stream(source(spark, str(tmp_path / "polls"), POLLS), history=history)
    got = sorted(map(tuple, run(spark, events, "resumed_calls", tmp_path).select("call_id", "edge", "start_ts", "end_ts").collect()))
    at = T0 + timedelta(seconds=2)
    assert got == [("h#4", "end", on, T0 + timedelta(seconds=1)), ("h#5", "start", at, None), ("i#1", "start", T0, None)]


def test_newest_frames_stay_in_a_ring(spark, tmp_path):
    rng, rows = random.Random(22), []
    for i in range(90):
        rows.append((["a", "b", "c"][0 if i < 70 else i % 3], T0 + timedelta(seconds=rng.randrange(40)), i, rng.choice([None, i]), f"wav{i}"))
    rows += [(None, T0, 200, 1, "no host"), ("c", None, 201, (1 << 60) + 1, None)]
    kinds = "host_id string, captured_at timestamp, frame_seq bigint, place bigint, audio string"
    files(spark, rows, kinds, str(tmp_path / "in"), 4, late=60)
    stream = latest_n_stream(source(spark, str(tmp_path / "in"), kinds), n=7)
    dropped = {tuple(r) for r in run(spark, stream, "ring", tmp_path).collect()}
    kept = {tuple(r) for r in newest_frames(spark, str(tmp_path / "cp")).collect()}
    frames = spark.createDataFrame(rows, kinds).where("host_id IS NOT NULL")
    assert kept == {tuple(r) for r in latest_n(frames, 7, order=("captured_at", "frame_seq")).collect()}
    assert kept | dropped == {tuple(r) for r in frames.collect()} and not kept & dropped


def test_whole_numbers_carried_with_frames_stay_exact(spark, tmp_path):
    kinds = "host_id string, captured_at timestamp, frame_seq bigint, place bigint"
    frames = [("h", T0 + timedelta(seconds=i), i, None if i == 2 else (1 << 60) + i) for i in range(1, 5)]
    files(spark, frames + [("z", LATER, 0, None)], kinds, str(tmp_path / "frames"), 1)
    files(spark, [("h#1", "h", "start", T0, None), (None, "z", None, LATER, None)], EDGES, str(tmp_path / "edges"), 1)
    stream = frames_in_calls_stream(source(spark, str(tmp_path / "frames"), kinds), source(spark, str(tmp_path / "edges"), EDGES))
    got = run(spark, stream, "exact_places", tmp_path).select("frame_seq", "place").collect()
    assert sorted(map(tuple, got)) == [(f[2], f[3]) for f in frames]


def test_open_ticks_of_a_call_are_one_value(spark, tmp_path):
    """However many ticks are open, the store is asked once per call and micro-batch."""
    kinds = "call_id string, result_ts timestamp, seq bigint, model string, confidence_pct double"
    rows = [(c, T0 + timedelta(seconds=i), i, "cnn", 50.0) for c in ("a", "b") for i in range(40)]
    files(spark, rows, kinds, str(tmp_path / "in"), 2)
    stream = align_stream(source(spark, str(tmp_path / "in"), kinds), 1000, tie="seq", delay="1 hour", idle_s=None)
    assert run(spark, stream, "open_ticks", tmp_path).count() == 0
    assert sorted(r.key.call_id for r in rows_left(spark, str(tmp_path / "cp"), name="slots").collect()) == ["a", "b"]


def test_ties_stay_exact_beside_rows_without_one(spark, tmp_path):
    kinds = "host_id string, captured_at timestamp, frame_seq bigint"
    frames = [("h", T0 + timedelta(seconds=1), None if i == 2 else (1 << 60) + i) for i in range(5)]
    files(spark, frames + [("z", LATER, 0)], kinds, str(tmp_path / "frames"), 1)
    files(spark, [("h#1", "h", "start", T0, None), (None, "z", None, LATER, None)], EDGES, str(tmp_path / "edges"), 1)
    stream = frames_in_calls_stream(
        source(spark, str(tmp_path / "frames"), kinds), source(spark, str(tmp_path / "edges"), EDGES), tie="frame_seq"
    )
    got = run(spark, stream, "exact_ties", tmp_path).collect()
    assert sorted(r.frame_seq for r in got) == sorted(-1 if f[2] is None else f[2] for f in frames)


def test_waiting_rows_are_one_value(spark, tmp_path):
    """Rows behind the watermark go to the store and back without a conversion of each of their values."""
    kinds = "call_id string, update_seq bigint, update_ts timestamp, cnn double, gmm double"
    rows = [("a", i, T0 + timedelta(seconds=i), 0.5, None) for i in range(20)]
    files(spark, rows, kinds, str(tmp_path / "in"), 1)
    assert run(spark, decision_stream(source(spark, str(tmp_path / "in"), kinds)), "waiting", tmp_path).count() == 0
    held = rows_left(spark, str(tmp_path / "cp")).select("value.waiting")
    assert held.schema["waiting"].dataType.simpleString() == "binary" and held.count() == 1
