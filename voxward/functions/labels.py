"""Labels and display texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxward.params import (
    AI,
    DISPLAY_LABELS,
    ENDED_EMPTY,
    HUMAN,
    SEVERITIES,
    SUSPICIOUS,
    DecisionParams,
    ModelThresholds,
)


def _banded(score: Column, low: float, high: float, names: tuple[str, str, str]) -> Column:
    # NULL stays NULL; NaN sorts above every number and gets the top name.
    return (
        F.when(score < low, names[0])
        .when(score < high, names[1])
        .when(score.isNotNull(), names[2])
    )


def classify(score: Column, params: DecisionParams = DecisionParams()) -> Column:
    """Decision label of a score in [0, 1]."""
    return _banded(score, params.human_threshold, params.ai_threshold, (HUMAN, SUSPICIOUS, AI))


def model_label(pct: Column, cuts: ModelThresholds = ModelThresholds()) -> Column:
    """Label of a single model's confidence in percent."""
    return _banded(pct, cuts.human, cuts.ai, tuple(DISPLAY_LABELS.values()))


def gmm_confidence(ll_ai: Column, ll_human: Column) -> Column:
    """Confidence in percent from the two mean log likelihoods."""
    return F.lit(100.0) / (F.lit(1.0) + F.exp(F.lit(-0.5) * (ll_ai - ll_human)))


def label_code(label: Column) -> Column:
    """A label as a number, which aggregates hold in place where text would need sorting."""
    return F.array_position(F.array(*map(F.lit, DISPLAY_LABELS)), label).cast("int")


def from_code(code: Column) -> Column:
    return F.get(F.array(*map(F.lit, DISPLAY_LABELS)), code - 1)


def _mapped(label: Column, names: dict[str, str]) -> Column:
    out = F
    for key, name in names.items():
        out = out.when(label == key, name)
    return out.otherwise(label)


def display_label(label: Column) -> Column:
    return _mapped(label, DISPLAY_LABELS)


def severity(label: Column) -> Column:
    return _mapped(label, SEVERITIES)


def one_decimal(value: Column) -> Column:
    """A number with one decimal, halves of the exact value rounded to even."""
    return F.call_function("format_number", value, F.lit("0.0"))


def detail_text(cnn_pct: Column, gmm_pct: Column) -> Column:
    """Both models' confidences; a missing one is left out."""
    parts = [
        F.concat(F.lit(f"{name}: "), one_decimal(pct), F.lit("%"))
        for name, pct in (("CNN", cnn_pct), ("GMM", gmm_pct))
    ]
    return F.concat_ws(" · ", *parts)


def frames_text(frames: Column) -> Column:
    word = F.when(frames == 1, " frame analyzed").otherwise(" frames analyzed")
    return F.concat(frames.cast("string"), word)


def ended_text(frames: Column, label: Column, confidence: Column) -> Column:
    """Summary of a finished call; a call whose frames were all silent has no last label."""
    last = F.concat(
        F.lit("\nLast: "),
        F.coalesce(label, F.lit("—")),
        F.lit(" ("),
        one_decimal(F.coalesce(confidence, F.lit(0.0))),
        F.lit("%)"),
    )
    text = F.concat(F.lit("Analyzed "), frames.cast("string"), F.lit(" frames"), last)
    return F.when(frames > 0, text).otherwise(ENDED_EMPTY)


def ai_text(average: Column, detail: Column) -> Column:
    pct = one_decimal(average * 100)
    return F.concat(F.lit("Smoothed: "), pct, F.lit("% ("), detail, F.lit(")"))
