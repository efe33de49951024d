"""State of many keys kept together gives what the state of each key gives."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from voxward.session import closed, drain
from voxward.streaming.decisions import decision_stream, running_state
from voxward.streaming.frames import frames_in_calls_stream
from voxward.streaming.monitor import call_monitor_stream

T0 = datetime(2024, 5, 1, tzinfo=timezone.utc)
LATER = T0 + timedelta(days=400)
KINDS = "call_id string, update_ts timestamp, update_seq bigint, cnn double, gmm double"


@pytest.fixture(scope="module")
def updates(spark, tmp_path_factory):
    """Forty calls and one that is NULL, with a pause of an hour, in three files whose times overlap, and the closing rows."""
    rng, rows = random.Random(5), []
    for c in [*(f"c{i}" for i in range(40)), None]:
        for i in range(20):
            at = T0 + timedelta(seconds=rng.randrange(600), hours=i >= 12)
            rows.append((c, at, i, *(None if rng.random() < 0.3 else rng.random() ** 0.3 for _ in "ab")))
    rng.shuffle(rows)
    path = str(tmp_path_factory.mktemp("updates") / "in")
    for part in (rows[::3], rows[1::3], rows[2::3], [("z", LATER, 0, None, None)], [("z", LATER + timedelta(days=1), 1, None, None)]):
        spark.createDataFrame(part, KINDS).coalesce(1).write.mode("append").parquet(path)
    return path


def source(spark, path, kinds):
    return spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(path)


def plain(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("idle_s", [None, 1800])
def test_decisions_in_buckets(spark, updates, idle_s):
    known = [("c0", [0.9] * 5, 5, "AI", 0.9, 0.9, True, T0 - timedelta(minutes=1)), ("old", [0.1], 1, "HUMAN", 0.1, None, False, T0)]
    kinds = "call_id string, scores array<double>, seq bigint, label string, cnn double, gmm double, was_ai boolean, t timestamp"
    history = spark.createDataFrame(known, kinds).withColumn("seen", F.unix_micros("t"))
    found = []
    for buckets in (None, 7):
        stream = decision_stream(source(spark, updates, KINDS), fill=True, delay="2 hours", idle_s=idle_s, history=history, buckets=buckets)
        made, checkpoint = drain(stream, "decisions", keep_state=True)
        state = running_state(spark, checkpoint, bucketed="string" if buckets else None)
        found.append((plain(made), plain(state)))
    assert found[0] == found[1] and len(found[0][0]) >= 800
    # However many calls there are, a row per bucket is read and written.
    left = spark.read.format("statestore").option("stateVarName", "memories").load(checkpoint).count()
    assert left <= 7


def test_calls_and_frames_in_buckets(spark, updates):
    polls = source(spark, updates, KINDS).select(
        F.col("call_id").alias("host_id"), F.col("update_ts").alias("poll_ts"), "update_seq",
        (F.col("cnn") > 0.4).alias("has_voip_audio"), (F.col("gmm") > 0.6).alias("mic_active"),
    )
    found = []
    for buckets in (None, 5):
        edges = drain(call_monitor_stream(polls, delay="2 hours", tie="update_seq", buckets=buckets), "edges")
        frames = polls.select("host_id", F.col("poll_ts").alias("captured_at"), "update_seq", F.col("poll_ts").alias("shown_at"), "mic_active")
        written = spark.readStream.schema(edges.schema).parquet(edges.inputFiles()[0].rsplit("/", 1)[0])
        sides = closed(frames, "captured_at", "host_id"), closed(written, "start_ts", "host_id")
        inside = drain(frames_in_calls_stream(*sides, tie="update_seq", delay="2 hours", buckets=buckets), "inside")
        found.append((plain(edges), plain(inside)))
    assert found[0] == found[1] and found[0][0] and found[0][1]

