"""The whole chain on two machines' telemetry and audio."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from voxward import schemas
from voxward.functions.identity import hash_number
from voxward.operators import scoring
from voxward.params import MIC_CONSENT_ROOT, DecisionParams
from voxward.plans.batch import BatchInputs, run_batch
from voxward.sources.blocklist import Blocklist
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)


def at(s):
    return T0 + timedelta(seconds=s)


@pytest.mark.parametrize("mode", ["per_result", "per_frame"])
def test_chain(spark, tmp_path, mode):
    sessions, mic = [], []
    for s in range(0, 60):
        # a calls from 5 to 40, b plays audio without a microphone
        if 5 <= s < 40:
            sessions.append(("a", at(s), "render", 0, 1, 7, "zoom.exe", ["zoom.exe"]))
        sessions.append(("b", at(s), "render", 0, 1, 9, "skype.exe", ["skype.exe"]))
        mic.append(("a", at(s), MIC_CONSENT_ROOT + "\\App", 9, 3))
        mic.append(("b", at(s), MIC_CONSENT_ROOT + "\\App", 3, 9))
    t = np.arange(8000) / 16_000
    loud, silent = 0.3 * np.sin(2 * np.pi * 500 * t), np.zeros(8000)
    frames = []
    for i, s in enumerate(range(0, 48, 3)):
        audio = silent if s in (9, 12) else loud
        frames.append(("a", None, i, at(s), 16_000, [float(v) for v in audio]))
        frames.append(("b", None, i, at(s), 16_000, [float(v) for v in loud]))
    number = "+1 (202) 555-0133"
    ui = [("a", "a#1", "Voice call", 1, 1, "Contact"), ("a", "a#1", "Voice call", 2, 2, number)]
    known = spark.range(1).select(hash_number(F.lit("+12025550133"))).first()[0]
    store = Blocklist(str(tmp_path / "list"))
    store.create(spark.createDataFrame([(known, 2, T0)], schemas.FLAGGED_NUMBERS))
    inputs = BatchInputs(
        spark.createDataFrame(sessions, schemas.AUDIO_SESSION_POLL),
        spark.createDataFrame([], schemas.PROCESS_POLL),
        spark.createDataFrame(mic, schemas.MIC_USAGE_POLL),
        spark.createDataFrame(frames, schemas.AUDIO_FRAME),
        spark.createDataFrame(ui, schemas.CALL_UI_TEXT),
        store,
        scorer=lambda x: np.full(len(x), 0.9),
        mixtures={
            m: scoring.Mixture(np.array([1.0]), np.zeros((1, 20)), np.eye(20)[None]) for m in ("human", "ai")
        },
    )
    for _ in range(2):  # a second run of the same number adds nothing
        out = run_batch(inputs, str(tmp_path / "out"), run=0, params=DecisionParams(), mode=mode)
    (call,) = out["call"].collect()
    assert (call.call_id, call.start_ts, call.end_ts) == ("a#1", at(5), at(40))
    assert call.is_caller_flagged and call.call_was_ai and call.caller_hash == known
    assert call.frames_processed == 12 and call.last_label == "AI"
    assert call.last_confidence == pytest.approx(78.0)  # 0.7 · 90 + 0.3 · 50
    decided = out["decision"].orderBy("update_seq").collect()
    assert [r.update_seq for r in decided] == list(range(1, 11))
    assert [r.should_notify for r in decided].index(True) == 4
    alerts = {r.kind: r for r in out["alert"].collect()}
    assert set(alerts) == {"flagged_caller", "ai_voice", "call_ended"}
    assert alerts["ai_voice"].message == "Smoothed: 78.0% (CNN: 90.0% · GMM: 50.0%)"
    assert alerts["call_ended"].message == "Analyzed 12 frames\nLast: AI (78.0%)"
    counts = {r.phone_hash: r.strike_count for r in store.read(spark).collect()}
    assert counts == {known: 3}
