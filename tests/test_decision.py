import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from voxward.functions import labels
from voxward.operators import decision
from voxward.operators.timeline import Timeline
from voxward.params import DecisionParams

A, S, H = "AI Generated", "Suspicious", "Human"
GOLDEN = [
    (0.9, 0.9, 0.9, 0.9, A, False, False, 1),
    (0.9, 0.8, 0.87, 0.885, A, False, False, 2),
    (0.9, None, 0.9, 0.89, A, False, False, 3),
    (0.9, 0.9, 0.9, 0.8925, A, False, False, 4),
    (0.9, 0.9, 0.9, 0.894, A, True, True, 5),
    (0.95, 0.9, 0.935, 0.901, A, False, True, 5),
    (0.1, 0.1, 0.1, 0.747, A, False, True, 5),
    (0.1, None, 0.1, 0.587, S, False, True, 5),
    (None, 0.2, 0.2, 0.447, S, False, True, 5),
    (0.99, 0.99, 0.99, 0.465, S, False, True, 5),
    (0.99, 0.99, 0.99, 0.476, S, False, True, 5),
    (0.99, 0.99, 0.99, 0.654, S, False, True, 5),
    (0.99, 0.99, 0.99, 0.832, A, True, True, 5),
    (0.99, 0.99, 0.99, 0.99, A, False, True, 5),
    (None, None, 0.0, 0.792, A, False, True, 5),
]
FIELDS = "call_id string, update_seq int, cnn double, gmm double"


def updates(spark, rows):
    return spark.createDataFrame(rows, FIELDS)


def test_golden_vector(spark):
    rows = [("c", i + 1, g[0], g[1]) for i, g in enumerate(GOLDEN)]
    got = decision.decision_engine(updates(spark, rows)).orderBy("update_seq").collect()
    for row, (_, _, score, average, label, notify, full, held) in zip(got, GOLDEN, strict=True):
        assert row.ensemble_score == pytest.approx(score)
        assert row.label == label
        assert (row.should_notify, row.buffer_full, row.frames_buffered) == (notify, full, held)
        assert row.average_score == pytest.approx(average)


def replay(rows, p):
    """The rules again, one update at a time."""
    out, held, before = {}, {}, {}
    for call, seq, cnn, gmm in sorted(rows, key=lambda r: (r[0], r[1])):
        if cnn is not None and gmm is not None:
            score = p.cnn_weight * cnn + p.gmm_weight * gmm
        else:
            score = next((v for v in (cnn, gmm) if v is not None), 0.0)
        buffer = held.setdefault(call, deque(maxlen=p.buffer_size))
        buffer.append(score)
        mean = sum(buffer) / len(buffer)
        label = H if mean < p.human_threshold else S if mean < p.ai_threshold else A
        full = len(buffer) == p.buffer_size
        out[call, seq] = (round(mean, 9), label, full and label == A and before.get(call, H) != A, full, len(buffer))
        if full:
            before[call] = label
    return out


def random_updates(seed, calls=12, hot=300):
    rng = random.Random(seed)
    rows = []
    for c in range(calls):
        level = rng.random()
        for i in range(hot if c == 0 else rng.randint(1, 40)):
            level = min(1, max(0, level + rng.uniform(-0.25, 0.25)))
            cnn, gmm = (None if rng.random() < 0.2 else min(1.0, level + rng.random() / 9) for _ in "ab")
            rows.append((f"c{c}", i * rng.choice([1, 1, 1]) + 1, cnn, gmm))
    return rows


@pytest.mark.parametrize("size", [1, 2, 5, 9])
@pytest.mark.parametrize("width", [None, 1, 3, 7, 64])
def test_same_as_replay_for_any_chunk_width(spark, size, width):
    p = DecisionParams(buffer_size=size)
    rows = random_updates(size * 31)
    line = Timeline(("call_id",), ("update_seq",), width)
    got = decision.decision_engine(updates(spark, rows), p, line=line).collect()
    want = replay(rows, p)
    assert len(got) == len(want)
    for r in got:
        mine = (round(r.average_score, 9), r.label, r.should_notify, r.buffer_full, r.frames_buffered)
        assert mine == want[r.call_id, r.update_seq]


def test_chunk_width_changes_no_bit(spark):
    rows = updates(spark, random_updates(5))
    seen = []
    for width in (None, 2, 50):
        line = Timeline(("call_id",), ("update_seq",), width)
        out = decision.decision_engine(rows, line=line)
        seen.append({(r.call_id, r.update_seq): r.average_score for r in out.collect()})
    assert seen[0] == seen[1] == seen[2]


@pytest.mark.parametrize("width", [None, 3])
def test_buffer_scores_and_labels(spark, width):
    rows = [("c", i + 1, v, v) for i, v in enumerate([0.1, 0.5, 0.9, 0.2, 0.3, 0.8])]
    line = Timeline(("call_id",), ("update_seq",), width)
    last = decision.buffer_scores(updates(spark, rows), line=line).orderBy("update_seq").collect()[-1]
    assert last.buffer_scores == pytest.approx([0.5, 0.9, 0.2, 0.3, 0.8])
    assert last.buffer_labels == [S, A, H, H, A]


@pytest.mark.parametrize("width", [None, 2])
def test_align_per_result_carries_forward(spark, width):
    rows = [
        ("c", 1, 10, "cnn", 40.0),
        ("c", 1, 11, "cnn", 50.0),
        ("c", 3, 30, "gmm", 80.0),
        ("c", 4, 40, "cnn", 60.0),
        ("d", 4, 41, "gmm", 10.0),
    ]
    results = spark.createDataFrame(rows, "call_id string, tick int, result_ts int, model string, confidence_pct double")
    line = Timeline(("call_id",), ("tick",), width)
    got = decision.align_scores(results, line=line).orderBy("call_id", "tick").collect()
    assert [(r.call_id, r.tick, r.cnn, r.gmm) for r in got] == [
        ("c", 1, 0.5, None), ("c", 3, 0.5, 0.8), ("c", 4, 0.6, 0.8), ("d", 4, None, 0.1),
    ]
    frames = decision.align_scores(results, "per_frame").orderBy("call_id", "tick").collect()
    assert [(r.cnn, r.gmm) for r in frames] == [(0.5, None), (None, 0.8), (0.6, None), (None, 0.1)]
    with pytest.raises(ValueError):
        decision.align_scores(results, "other")


def test_latest_per_tick(spark):
    rows = [("c", "cnn", 1, 10, 1.0), ("c", "cnn", 1, 12, 2.0), ("c", "cnn", 2, 20, 3.0)]
    results = spark.createDataFrame(rows, "call_id string, model string, tick int, result_ts int, confidence_pct double")
    got = {(r.tick, r.confidence_pct, r.n_results) for r in decision.latest_per_tick(results).collect()}
    assert got == {(1, 2.0, 2), (2, 3.0, 1)}


def test_current_state_of_a_call_without_updates(spark):
    done = decision.decision_engine(updates(spark, [("c", 1, 0.9, 0.9), ("c", 2, 0.5, 0.5)]))
    everyone = spark.createDataFrame([("c",), ("empty",)], "call_id string")
    got = {r.call_id: (round(r.average_score, 6), r.label, r.frames_buffered) for r in decision.current_state(done, everyone).collect()}
    assert got == {"c": (0.7, A, 2), "empty": (0.0, H, 0)}


def test_threshold_edges(spark):
    rows = spark.createDataFrame([(0.39999,), (0.4,), (0.7,), (float("nan"),), (None,)], "s double")
    got = [r[0] for r in rows.select(labels.classify(F.col("s"))).collect()]
    assert got == [H, S, A, A, None]
    cuts = spark.createDataFrame([(49.99,), (50.0,), (70.0,)], "s double")
    assert [r[0] for r in cuts.select(labels.model_label(F.col("s"))).collect()] == ["HUMAN", "SUSPICIOUS", "AI"]


@pytest.mark.parametrize("bad", [{"buffer_size": 0}, {"cnn_weight": 1.1}, {"gmm_weight": -0.1}])
def test_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        DecisionParams(**bad)
    assert DecisionParams(cnn_weight=1.0, gmm_weight=1.0)


def test_plan_has_one_shuffle_and_one_sort(spark):
    rows = updates(spark, random_updates(1))
    plan = decision.decision_engine(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1 and plan.count("Window [") == 1


def test_chunks_need_no_job_and_split_a_hot_key(spark):
    rows = spark.range(5000).select(F.lit("hot").alias("k"), F.col("id").alias("n"))
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup())
    usual = Timeline.chunked(rows, ("k",), ("n",))
    assert usual.width == 65_536 and set(tracker.getJobIdsForGroup()) == before
    line = Timeline(("k",), ("n",), 100)
    assert line.cut(rows).groupBy(*line.group).count().agg(F.max("count")).first()[0] <= 100
    assert line.number(rows, "seq").filter("seq <> n + 1").count() == 0


@pytest.mark.parametrize("width", [None, 86_400.0, 2.0, 0.25, 1e-6])
def test_null_keys_and_order_are_the_same_for_every_width(spark, width):
    rows = [(k, t, i, v) for k in ("a", None) for i, (t, v) in enumerate([(None, 5), (None, None), (0.0, None), (0.3, 7), (0.6, None), (90_000.5, None)])]
    df = spark.createDataFrame(rows, "k string, s double, i int, v int").selectExpr("k", "timestamp_micros(CAST(s * 1000000 AS BIGINT)) AS t", "i", "v")
    line = Timeline(("k",), ("t", "i"), width)
    filled = {(r.k, r.i): r.f for r in line.last_known(df, f="v").collect()}
    assert filled == {(k, i): v for k in ("a", None) for i, v in enumerate([5, 5, 5, 7, 7, 7])}
    assert {(r.k, r.i): r.n for r in line.number(df, "n").collect()} == {(k, i): i + 1 for k in ("a", None) for i in range(6)}
