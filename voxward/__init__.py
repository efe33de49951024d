"""Call-fraud and synthetic-voice analytics on Spark."""

from voxward.operators.caller import (
    caller_hashes,
    calls_to_flag,
    first_caller_id,
    lookup_blocklist,
    upsert_flags,
)
from voxward.operators.calls import assign_calls, call_edges, call_sessions, latch
from voxward.operators.decision import (
    align_scores,
    buffer_scores,
    current_state,
    decision_engine,
    ensemble,
    latest_per_tick,
)
from voxward.operators.detection import (
    detect_voip_sources,
    is_call_active,
    is_call_active_strict,
    mic_in_use,
    mic_in_use_by_voip,
    poll_status,
    voip_mic_pids,
    voip_output_pids,
)
from voxward.operators.features import cepstra, cnn_features, lfcc, mel_spectrogram, resample
from voxward.operators.framing import latest_n, to_frames, whole_frames
from voxward.operators.quality import drop_silent, frame_quality
from voxward.operators.rollup import (
    alerts,
    call_rollup,
    call_summary,
    caller_warnings,
    complete_calls,
    display_columns,
)
from voxward.operators.scoring import (
    LogisticScorer,
    Mixture,
    fit_gmm_pair,
    fit_logistic,
    gmm_loglik,
    latency_stats,
    load_mixtures,
    measure_frames,
    model_results,
    score_features,
    score_frames,
)
from voxward.operators.timeline import Timeline
from voxward.params import (
    APP_PROFILE,
    DecisionParams,
    MelParams,
    ModelThresholds,
    SilenceParams,
)
from voxward.plans.batch import BatchInputs, batch_predict, run_batch
from voxward.sources.alerts import write_alerts
from voxward.sources.blocklist import Blocklist
from voxward.sources.telemetry import read_telemetry
from voxward.sources.wav import read_frames, read_wav, wav_files, write_wav_frames
from voxward.streaming.blocklist import blocklist_stream
from voxward.streaming.decisions import decision_stream
from voxward.streaming.monitor import call_monitor_stream, poll_status_stream

__all__ = [name for name in dir() if not name.startswith("_")]
