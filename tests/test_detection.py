from datetime import datetime, timedelta

import pytest

from voxward import schemas
from voxward.operators import detection
from voxward.params import MIC_CONSENT_ROOT

T0 = datetime(2024, 1, 1)
ROOT = MIC_CONSENT_ROOT


def at(s):
    return T0 + timedelta(seconds=s)


@pytest.fixture(scope="module")
def tables(spark):
    sessions = [
        # poll 0: zoom plays twice, a child of teams plays, others do not count
        ("h", at(0), "render", 0, 1, 10, "Zoom.exe", ["explorer.exe", "zoom.exe"]),
        ("h", at(0), "render", 1, 1, 10, "Zoom.exe", ["explorer.exe", "zoom.exe"]),
        ("h", at(0), "render", 2, 1, 11, "helper.exe", ["teams.exe", "helper.exe"]),
        ("h", at(0), "render", 3, 0, 12, "discord.exe", ["discord.exe"]),
        ("h", at(0), "render", 4, 1, 0, "skype.exe", ["skype.exe"]),
        ("h", at(0), "render", 5, 1, 13, None, None),
        ("h", at(0), "render", 6, 1, 14, "vlc.exe", ["explorer.exe", "vlc.exe"]),
        ("h", at(0), "capture", 0, 1, 10, "Zoom.exe", ["explorer.exe", "zoom.exe"]),
        ("h", at(0), "capture", 1, 1, 11, "helper.exe", ["teams.exe", "helper.exe"]),
        # poll 1: nothing plays
        ("h", at(1), "render", 0, 1, 14, "vlc.exe", ["explorer.exe", "vlc.exe"]),
        # poll 3: zoom plays, the mic is not used
        ("h", at(3), "render", 0, 1, 10, "zoom.exe", ["zoom.exe"]),
    ]
    processes = [
        ("h", at(0), 10, "Zoom.exe", ["zoom.exe"]),
        ("h", at(0), 20, "WhatsApp.exe", ["whatsapp.exe"]),
        ("h", at(0), 14, "vlc.exe", ["vlc.exe"]),
        ("h", at(1), 20, "WhatsApp.exe", None),
        ("h", at(1), 21, "helper.exe", ["teams.exe", "helper.exe"]),
        ("h", at(2), 20, "WhatsApp.exe", ["whatsapp.exe"]),
        ("h", at(3), 20, "WhatsApp.exe", ["whatsapp.exe"]),
    ]
    mic = [
        ("h", at(0), ROOT + "\\NonPackaged\\C:#apps#Zoom.exe", 9, 3),
        ("h", at(1), ROOT + "\\WhatsApp_abc", 9, 3),
        ("h", at(1), ROOT + "\\NonPackaged\\C:#apps#gone.exe", 9, 3),
        ("h", at(2), ROOT + "\\NonPackaged\\C:#apps#gone.exe", 9, 3),
        ("h", at(2), ROOT + "\\Other", 3, 9),
        ("h", at(2), ROOT + "\\Unset", 3, None),
        ("h", at(3), "SOFTWARE\\Elsewhere\\webcam\\App", 9, 3),
        ("h", at(4), ROOT, 9, 3),
    ]
    return (
        spark.createDataFrame(sessions, schemas.AUDIO_SESSION_POLL),
        spark.createDataFrame(processes, schemas.PROCESS_POLL),
        spark.createDataFrame(mic, schemas.MIC_USAGE_POLL),
    )


def second(r):
    return int((r.poll_ts - T0).total_seconds())


def test_pids(tables):
    sessions, _, _ = tables
    assert {(second(r), r.pid) for r in detection.voip_output_pids(sessions).collect()} == {(0, 10), (0, 11), (3, 10)}
    assert {(second(r), r.pid) for r in detection.voip_mic_pids(sessions).collect()} == {(0, 10)}
    by_poll = {second(r): r.mic_in_use_by_voip for r in detection.mic_in_use_by_voip(sessions).collect()}
    assert by_poll == {0: True, 1: False, 3: False}


def test_mic_in_use(tables):
    _, processes, mic = tables
    got = {second(r): r.mic_in_use for r in detection.mic_in_use(mic, processes).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True}


def test_sources_keep_duplicates_and_add_the_fallback(tables):
    found = detection.detect_voip_sources(*tables).collect()
    got = sorted((second(r), r.pid, r.name, r.method) for r in found)
    assert got == [
        (0, 10, "zoom.exe", 1), (0, 10, "zoom.exe", 1), (0, 11, "helper.exe", 1),
        (0, 20, "whatsapp.exe", 2), (1, 20, "whatsapp.exe", 2), (3, 10, "zoom.exe", 1),
    ]


def test_poll_status_shows_every_poll(tables):
    status = detection.poll_status(*tables)
    got = {second(r): (r.n_sources, r.has_voip_audio, r.mic_active, r.mic_in_use_by_voip) for r in status.collect()}
    assert got == {
        0: (4, True, True, True), 1: (1, True, True, False), 2: (0, False, False, False),
        3: (1, True, False, False), 4: (0, False, False, False),
    }
    strict = {second(r): r.call_active for r in detection.is_call_active_strict(status).collect()}
    loose = {second(r): r.call_active for r in detection.is_call_active(status).collect()}
    assert strict == {0: True, 1: True, 2: False, 3: False, 4: False}
    assert loose == {0: True, 1: True, 2: False, 3: True, 4: False}


def test_poll_status_needs_no_join(tables):
    plan = detection.poll_status(*tables)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
