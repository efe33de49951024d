"""Parameters of the engine, checked when they are built."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Model and decision contracts which results depend on.
VOIP_KEYWORDS = (
    "whatsapp",
    "zoom",
    "teams",
    "discord",
    "telegram",
    "signal",
    "skype",
    "viber",
    "slack",
    "webex",
)
MIC_CONSENT_ROOT = (
    r"SOFTWARE\Microsoft\Windows\CurrentVersion\CapabilityAccessManager\ConsentStore\microphone"
)
CALL_WINDOWS = ("Voice call", "Video call")
MAX_UI_DEPTH = 15
MIN_PHONE_DIGITS = 7
HUMAN, SUSPICIOUS, AI = "Human", "Suspicious", "AI Generated"
DISPLAY_LABELS = {HUMAN: "HUMAN", SUSPICIOUS: "SUSPICIOUS", AI: "AI"}
SEVERITIES = {HUMAN: "safe", SUSPICIOUS: "warn", AI: "alert"}
CAPTURE_RATE = 48_000
MODEL_RATE = 16_000
FRAME_SECONDS = 3.0
MODEL_SAMPLES = 40_000
TARGET_DB = -20.0
MAX_SILENCE_RATIO = 0.4
RECORDER_FRAMES = 20
TICK_MS = 100
PCM16_SCALE = 32_767
FLAGGED_TITLE = "⚠️ AI Scammer Flagged"
FLAGGED_MESSAGE = "A community-flagged AI caller is calling!"
AI_TITLE = "🚨 AI Voice Detected"
ENDED_TITLE = "📴 Call Ended"
ENDED_EMPTY = "No audio frames captured"


@dataclass(frozen=True)
class DecisionParams:
    """Rolling buffer, ensemble weights and label thresholds."""

    buffer_size: int = 5
    cnn_weight: float = 0.7
    gmm_weight: float = 0.3
    human_threshold: float = 0.40
    ai_threshold: float = 0.70

    def __post_init__(self) -> None:
        if self.buffer_size < 1:
            raise ValueError("buffer_size has to be at least 1")
        for name in ("cnn_weight", "gmm_weight"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} has to lie in [0, 1]")


# The weights the desktop application passes.
APP_PROFILE = DecisionParams(cnn_weight=0.6, gmm_weight=0.4)


# Cut points, and below it windows and level of silence.
@dataclass(frozen=True)
class ModelThresholds:
    """Cut points, in percent, of the label a single model gives."""

    human: float = 50.0
    ai: float = 70.0


@dataclass(frozen=True)
class SilenceParams:
    sample_rate: int = CAPTURE_RATE
    chunk_ms: float = 50
    threshold_db: float = -40.0
    max_ratio: float = MAX_SILENCE_RATIO

    def at(self, rate: int) -> SilenceParams:
        """The same windows of time at another sample rate."""
        return replace(self, sample_rate=int(rate))

    @property
    def chunk_samples(self) -> int:
        return max(1, int(self.sample_rate * self.chunk_ms / 1000))


@dataclass(frozen=True)
class MelParams:
    """Spectrogram shape; the two presets below are what the models expect."""

    n_fft: int
    hop: int
    win: int
    n_mels: int
    fmin: float
    fmax: float
    sample_rate: int = MODEL_RATE


# Feature shapes the two models were trained with.
CNN_MEL = MelParams(n_fft=512, hop=160, win=400, n_mels=60, fmin=0.0, fmax=8000.0)
CNN_COLUMNS = 79
GMM_MEL = MelParams(n_fft=2048, hop=512, win=2048, n_mels=128, fmin=80.0, fmax=7500.0)
N_LFCC = 20
