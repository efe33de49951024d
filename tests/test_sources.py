import io
import os
import wave
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxward import schemas
from voxward.operators import framing
from voxward.sources.alerts import write_alerts
from voxward.sources.telemetry import read_telemetry
from voxward.sources.wav import read_frames, read_wav, wav_bytes, wav_files, write_wav_frames

RATE = 8000


def store(path, samples, rate=RATE, channels=1):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as wav:
        wav.setnchannels(channels)
        wav.setsampwidth(2)
        wav.setframerate(rate)
        wav.writeframes(np.asarray(samples, "<i2").tobytes())


@pytest.mark.parametrize("split_bytes", [1 << 26, 10_000, 777])
def test_wav_is_read_in_ranges(spark, tmp_path, split_bytes):
    pcm = np.random.default_rng(1).integers(-32768, 32767, RATE * 4 + 123)
    store(tmp_path / "pc1" / "a.wav", pcm)
    chunks = read_wav(spark, str(tmp_path / "pc1"), chunk_s=0.5, split_bytes=split_bytes)
    rows = chunks.orderBy("chunk_seq").collect()
    assert [r.chunk_seq for r in rows] == list(range(9))
    assert {r.host_id for r in rows} == {"pc1"} and {r.sample_rate for r in rows} == {RATE}
    got = np.concatenate([r.samples for r in rows])
    assert got == pytest.approx(pcm / 32768)
    assert [r.first_sample for r in rows] == [i * 4000 for i in range(9)]


def test_wav_as_bytes(spark, tmp_path):
    pcm = np.random.default_rng(2).integers(-32768, 32767, RATE * 2)
    store(tmp_path / "pc1" / "a.wav", pcm)
    chunks = read_wav(spark, str(tmp_path / "pc1"), chunk_s=0.5, pcm=True)
    frames = framing.to_frames(chunks, "path", n=3000).orderBy("frame_seq").collect()
    got = np.concatenate([np.frombuffer(r.samples, "<i2") for r in frames])
    assert got.tolist() == pcm[:15_000].tolist()
    assert wav_bytes(bytes(frames[0].samples), RATE)[44:] == frames[0].samples


def test_stereo_becomes_its_mean(spark, tmp_path):
    store(tmp_path / "h" / "s.wav", [100, 300, -200, 200, 0, 10], channels=2)
    row = read_wav(spark, str(tmp_path / "h")).first()
    assert np.array(row.samples) * 32768 == pytest.approx([200, 0, 5])


def test_wav_files_as_a_stream(spark, tmp_path):
    for i in range(3):
        store(tmp_path / "in" / "h" / f"{i}.wav", np.arange(RATE * 2))
    chunks = read_wav(spark, str(tmp_path / "in" / "h"), chunk_s=1.0, streaming=True)
    frames = framing.to_frames(chunks, "path", n=RATE)
    with pytest.raises(Exception, match="append|watermark"):
        frames.writeStream.format("memory").queryName("spanning").outputMode("append").start()
    query = (
        framing.whole_frames(chunks, "path", n=RATE).writeStream.format("memory").queryName("wavs")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = spark.table("wavs").collect()
    assert len(got) == 6 and {r.frame_seq for r in got} == {0, 1}


def test_frames_of_a_file_and_their_times(spark, tmp_path):
    store(tmp_path / "h" / "a.wav", np.arange(RATE * 5))
    start = F.lit(datetime(2024, 5, 1, 9, 0, 0))
    chunks = read_wav(spark, str(tmp_path / "h"), started=start, chunk_s=2.0)
    frames = framing.to_frames(chunks, "path", n=RATE).orderBy("frame_seq").collect()
    assert [r.captured_at.second for r in frames] == [0, 1, 2, 3, 4]
    assert all(len(r.samples) == RATE for r in frames)


def test_frame_files(spark, tmp_path):
    rows = [
        ("c1", 0, datetime(2024, 5, 1, 9, 8, 7, 123999), [0.0, 0.5, -0.5, 2.0, -2.0]),
        ("c1", 41, datetime(2024, 5, 1, 23, 0, 0), [0.1]),
    ]
    frames = spark.createDataFrame(rows, "call_id string, frame_seq int, captured_at timestamp, samples array<float>")
    for _ in range(2):  # writing again gives the same files
        assert write_wav_frames(frames, str(tmp_path), rate=RATE)[0] == 2
    names = sorted(p.name for p in (tmp_path / "c1").iterdir())
    assert names == ["frame_0001_090807_123.wav", "frame_0042_230000_000.wav"]
    with wave.open(str(tmp_path / "c1" / names[0])) as wav:
        pcm = np.frombuffer(wav.readframes(9), "<i2")
        assert wav.getframerate() == RATE and pcm.tolist() == [0, 16383, -16383, 32767, -32767]


def test_wav_bytes_have_a_header():
    with wave.open(io.BytesIO(wav_bytes(np.zeros(10), 48_000))) as wav:
        assert (wav.getnframes(), wav.getnchannels(), wav.getsampwidth()) == (10, 1, 2)


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_telemetry(spark, tmp_path, fmt):
    rows = [("h", datetime(2024, 1, 1), 5, "zoom.exe", ["zoom.exe"])]
    spark.createDataFrame(rows, schemas.PROCESS_POLL).write.format(fmt).save(str(tmp_path / "p"))
    got = read_telemetry(spark, "process_poll", str(tmp_path / "p"), fmt)
    assert [tuple(r) for r in got.collect()] == rows
    live = read_telemetry(spark, "process_poll", str(tmp_path / "p"), fmt, True, 1)
    assert live.isStreaming and live.columns == got.columns
    with pytest.raises(ValueError):
        read_telemetry(spark, "unknown", str(tmp_path))


def test_alerts_are_replaced_not_doubled(spark, tmp_path):
    rows = [("c", datetime(2024, 1, 1), "ai_voice", "t", "m")]
    alerts = spark.createDataFrame(rows, schemas.ALERT)
    for epoch in (0, 1, 1):
        write_alerts(alerts, str(tmp_path / "alerts"), epoch)
    assert spark.read.parquet(str(tmp_path / "alerts")).count() == 2


def test_tasks_follow_bytes(spark, tmp_path):
    for i in range(12):
        store(tmp_path / "h" / f"{i}.wav", np.arange(RATE))
    tasks = -(-12 * (RATE * 2 + 44) // 4000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    chunks = read_wav(spark, str(tmp_path / "h"), chunk_s=0.25, split_bytes=4000)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert chunks.rdd.getNumPartitions() == tasks and chunks.count() == 48


def test_recordings_of_a_host_never_mix(spark, tmp_path):
    store(tmp_path / "h" / "a.wav", np.full(RATE + 3000, 1))
    store(tmp_path / "h" / "b.wav", np.full(RATE + 5000, 2))
    chunks = read_wav(spark, str(tmp_path / "h"), chunk_s=0.3, pcm=True)
    frames = framing.to_frames(chunks, frame_s=1.0).collect()
    assert len(frames) == 2 and {len(set(np.frombuffer(f.samples, "<i2"))) for f in frames} == {1}
    assert {f.host_id for f in frames} == {"h"} and len({f.recording for f in frames}) == 2


def test_frames_take_each_files_rate_in_one_pass(spark, tmp_path):
    for rate in (8_000, 16_000):
        store(tmp_path / "h" / f"{rate}.wav", np.arange(rate * 9) % 100, rate)
    frames = read_frames(spark, str(tmp_path / "h"), pcm=True)
    plan = frames._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 2  # headers, then audio: once each
    got = frames.collect()
    assert sorted(len(f.samples) for f in got) == [48_000] * 3 + [96_000] * 3
    assert {f.frame_seq for f in got} == {0, 1, 2}


def test_stored_frames_come_back_in_order_and_time(spark, tmp_path):
    at = datetime(2024, 5, 1, 9, 8, 7, 123000)
    rows = [("c1", k, at + timedelta(seconds=3 * k), [k / 100] * (3 * RATE)) for k in (0, 1, 41)]
    frames = spark.createDataFrame(rows, "call_id string, frame_seq int, captured_at timestamp, samples array<float>")
    write_wav_frames(frames, str(tmp_path), rate=RATE)
    got = read_frames(spark, f"{tmp_path}/*").orderBy("frame_seq").collect()
    assert [(f.host_id, f.frame_seq, f.captured_at.time()) for f in got] == [("c1", k, t.time()) for _, k, t, _ in rows]
    assert [f.samples[0] for f in got] == pytest.approx([0, 0.01, 0.41], abs=1e-4)


def test_a_recording_without_a_time_began_before_its_file_was_closed(spark, tmp_path):
    store(tmp_path / "h" / "a.wav", np.arange(RATE * 4))
    os.utime(tmp_path / "h" / "a.wav", (1_700_000_000, 1_700_000_000))
    first = read_wav(spark, str(tmp_path / "h"), chunk_s=1.0).orderBy("chunk_seq").first()
    assert first.captured_at.timestamp() == 1_700_000_000 - 4


def test_files_that_cannot_be_read_are_listed(spark, tmp_path):
    folder = tmp_path / "h"
    store(folder / "good.wav", np.arange(RATE))
    (folder / "text.wav").write_bytes(b"no audio here at all")
    (folder / "cut.wav").write_bytes((folder / "good.wav").read_bytes()[:30])
    (folder / "short.wav").write_bytes((folder / "good.wav").read_bytes()[:1044])
    with wave.open(str(folder / "wide.wav"), "wb") as wav:
        wav.setnchannels(1)
        wav.setsampwidth(3)
        wav.setframerate(RATE)
        wav.writeframes(bytes(30))
    reasons = {r.path.rsplit("/", 1)[1]: r.reason for r in wav_files(spark, str(folder)).collect()}
    assert reasons == {
        "good.wav": None, "short.wav": None, "text.wav": "no WAVE header", "cut.wav": "no samples",
        "wide.wav": "24-bit samples, expected 16-bit",
    }
    sizes = {r.path.rsplit("/", 1)[1]: len(r.samples) for r in read_wav(spark, str(folder)).collect()}
    assert sizes == {"good.wav": RATE, "short.wav": 500}
