"""Schemas of the canonical tables, as DDL for readers and ``createDataFrame``."""

AUDIO_SESSION_POLL = (
    "host_id string not null, poll_ts timestamp not null, direction string not null,"
    " session_seq int not null, state int not null, pid int not null,"
    " process_name string, parent_chain array<string>"
)
PROCESS_POLL = (
    "host_id string not null, poll_ts timestamp not null, pid int not null,"
    " process_name string not null, parent_chain array<string>"
)
MIC_USAGE_POLL = (
    "host_id string not null, poll_ts timestamp not null, key_path string not null,"
    " last_used_start bigint, last_used_stop bigint"
)
AUDIO_CHUNK = (
    "host_id string not null, chunk_seq bigint not null, captured_at timestamp not null,"
    " sample_rate int not null, channels int not null, samples array<float> not null"
)
AUDIO_FRAME = (
    "host_id string not null, call_id string, frame_seq int not null,"
    " captured_at timestamp not null, sample_rate int not null, samples array<float> not null"
)
CALL_UI_TEXT = (
    "host_id string not null, call_id string not null, window_name string not null,"
    " walk_ordinal int not null, depth int not null, text string"
)
FLAGGED_NUMBERS = (
    "phone_hash string not null, strike_count int, last_flagged_at timestamp"
)
GMM_MODEL = (
    "model string not null, component int not null, weight double not null,"
    " mean array<double> not null, cov array<array<double>> not null"
)
MODEL_RESULT = (
    "call_id string not null, frame_seq int not null, result_ts timestamp not null,"
    " model string not null, confidence_pct double not null, label string not null,"
    " inference_ms double"
)
DECISION = (
    "call_id string not null, update_seq int not null, update_ts timestamp,"
    " ensemble_score double not null, average_score double not null, label string not null,"
    " should_notify boolean not null, buffer_full boolean not null, frames_buffered int not null"
)
CALL = (
    "call_id string not null, host_id string not null, start_ts timestamp not null,"
    " end_ts timestamp, caller_hash string, is_caller_flagged boolean not null,"
    " call_was_ai boolean not null, frames_processed bigint not null,"
    " last_label string, last_confidence double"
)
ALERT = (
    "call_id string not null, ts timestamp not null, kind string not null,"
    " title string not null, message string not null"
)
TELEMETRY = {
    "audio_session_poll": AUDIO_SESSION_POLL,
    "process_poll": PROCESS_POLL,
    "mic_usage_poll": MIC_USAGE_POLL,
}
