"""Score alignment, ensemble, rolling decision and its notifications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxward.functions.labels import classify, from_code, label_code
from voxward.operators.timeline import Timeline
from voxward.params import HUMAN, AI, DecisionParams

DEFAULT = DecisionParams()


def ensemble(cnn: Column | str, gmm: Column | str, params: DecisionParams = DEFAULT) -> Column:
    """Weighted score of both models, the one that is there, or 0.0."""
    cnn, gmm = _col(cnn), _col(gmm)
    both = F.lit(params.cnn_weight) * cnn + F.lit(params.gmm_weight) * gmm
    return F.coalesce(both, cnn, gmm, F.lit(0.0))


def latest_per_tick(
    results: DataFrame,
    keys: tuple[str, ...] = ("call_id", "model", "tick"),
    ts: str = "result_ts",
    value: str = "confidence_pct",
    tie: tuple[str, ...] = (),
) -> DataFrame:
    """The newest result per model in each poll tick; a combinable aggregate."""
    newest = F.struct(ts, *tie) if tie else F.col(ts)
    return results.groupBy(*keys).agg(
        F.max_by(value, newest).alias(value), F.max(ts).alias(ts), F.count("*").alias("n_results")
    )


def tick_of(ts: Column, tick_ms: int) -> Column:
    """Number of the poll tick a timestamp falls in."""
    return F.floor(F.unix_millis(ts) / F.lit(tick_ms))


def align_scores(
    results: DataFrame,
    mode: str = "per_result",
    key: str = "call_id",
    slot: str = "tick",
    ts: str = "result_ts",
    line: Timeline | None = None,
) -> DataFrame:
    """One row per update with both models' scores in [0, 1].

    ``per_result``: every slot with a new result is an update that shows the
    latest value of both models so far. ``per_frame``: one update per slot with
    what that slot brought. ``slot`` is the poll tick or the frame number.
    """
    if mode not in ("per_result", "per_frame"):
        raise ValueError("mode is per_result or per_frame")

    def newest(model: str) -> Column:
        pick = F.max_by("confidence_pct", F.when(F.col("model") == model, F.col(ts)))
        return (pick / 100.0).alias(model)

    updates = results.groupBy(key, slot).agg(newest("cnn"), newest("gmm"), F.max(ts).alias(ts))
    if mode == "per_frame":
        return updates
    line = line or Timeline((key,), (slot,))
    filled = line.last_known(updates, _cnn="cnn", _gmm="gmm")
    filled = filled.withColumns({"cnn": F.col("_cnn"), "gmm": F.col("_gmm")})
    return line.drop(filled.drop("_cnn", "_gmm"))


def _history(df: DataFrame, line: Timeline, n: int) -> tuple[DataFrame, list[Column]]:
    """Columns with this row's score and the ``n`` scores before it, newest first."""
    df = line.cut(df)
    lags = {f"_v{i}": F.lag("ensemble_score", i).over(line.rows) for i in range(1, n + 1)}
    if not line.width:
        out = df.withColumns(lags)
        return out, [F.col("ensemble_score"), *[F.col(c) for c in lags]]
    out = df.withColumns({**lags, "_row": F.row_number().over(line.rows)})
    chunks = line.tails(df, "ensemble_score", n, "_tail")
    last = {
        "_tail": lambda w: F.reverse(
            F.flatten(F.collect_list("_tail").over(w.rowsBetween(-n, -1)))
        )
    }
    out = line.carry(out, chunks, last, {})
    # Row r of a chunk lacks its i-th predecessor when i >= r; the tail of the
    # chunks before, newest first, has it at place i - r.
    past = [
        F.when(F.col("_row") > i, F.col(f"_v{i}")).otherwise(
            F.get("_tail", F.lit(i) - F.col("_row"))
        )
        for i in range(1, n + 1)
    ]
    return out, [F.col("ensemble_score"), *past]


def _mean(values: list[Column]) -> Column:
    """Mean of the non-NULL values, summed oldest first so chunk borders change nothing."""
    total = reduce(lambda a, v: a + F.coalesce(v, F.lit(0.0)), reversed(values), F.lit(0.0))
    held = reduce(lambda a, v: a + F.when(v.isNotNull(), 1).otherwise(0), values, F.lit(0))
    return F.when(held > 0, total / held)


def score_updates(
    df: DataFrame,
    line: Timeline,
    params: DecisionParams = DEFAULT,
    with_scores: bool = False,
) -> DataFrame:
    """Run the decision rules over updates that have ``cnn`` and ``gmm`` scores.

    Adds ensemble and rolling score, label, buffer state and the notify flag,
    and with ``with_scores`` the buffer itself, oldest first. One shuffle and
    one sort carry everything.
    """
    n = params.buffer_size
    df = df.withColumn("ensemble_score", ensemble("cnn", "gmm", params))
    df, values = _history(df, line, n)
    held = reduce(lambda a, v: a + F.when(v.isNotNull(), 1).otherwise(0), values[:n], F.lit(0))
    df = df.withColumns(
        {
            "average_score": _mean(values[:n]),
            "_previous": F.when(values[n].isNotNull(), _mean(values[1:])),
            "frames_buffered": held,
            **({"buffer_scores": F.array_compact(F.array(*values[:n][::-1]))} if with_scores else {}),
        }
    )
    label = classify(F.col("average_score"), params)
    was = F.coalesce(classify(F.col("_previous"), params), F.lit(HUMAN))
    df = df.withColumns(
        {
            "label": label,
            "buffer_full": F.col("frames_buffered") >= n,
            # Only a full buffer sets the label the next update is compared with.
            "should_notify": (F.col("frames_buffered") >= n) & (label == AI) & (was != AI),
        }
    )
    helpers = ["_previous", "_row", "_tail", *[f"_v{i}" for i in range(1, n + 1)]]
    return line.drop(df.drop(*helpers))


def decision_engine(
    updates: DataFrame,
    params: DecisionParams = DEFAULT,
    key: str = "call_id",
    order: tuple[str, ...] = ("update_seq",),
    line: Timeline | None = None,
) -> DataFrame:
    """The six decision fields per update."""
    return score_updates(updates, line or Timeline((key,), order), params)


def buffer_scores(
    updates: DataFrame,
    params: DecisionParams = DEFAULT,
    key: str = "call_id",
    order: tuple[str, ...] = ("update_seq",),
    line: Timeline | None = None,
) -> DataFrame:
    """The decision plus buffer content and the label of each score in it."""
    out = score_updates(updates, line or Timeline((key,), order), params, with_scores=True)
    labels = F.transform("buffer_scores", lambda s: classify(s, params))
    return out.withColumn("buffer_labels", labels)


def current_state(
    decisions: DataFrame,
    calls: DataFrame | None = None,
    key: str = "call_id",
    order: tuple[str, ...] = ("update_seq",),
) -> DataFrame:
    """Latest average, label and buffer size per call; a call without updates is 0.0 / Human."""
    at = Timeline((key,), order).at
    latest = decisions.groupBy(key).agg(
        F.max_by("average_score", at).alias("average_score"),
        F.max_by(label_code(F.col("label")), at).alias("label"),
        F.max_by("frames_buffered", at).alias("frames_buffered"),
    )
    latest = latest.withColumn("label", from_code(F.col("label")))
    return latest if calls is None else with_idle_calls(calls, latest, key)


def with_idle_calls(calls: DataFrame, latest: DataFrame, key: str = "call_id") -> DataFrame:
    """The state of all ``calls``; those without updates are 0.0 / Human."""
    out = calls.select(key).join(latest, key, "left")
    return out.withColumns(
        {
            "average_score": F.coalesce("average_score", F.lit(0.0)),
            "label": F.coalesce("label", F.lit(HUMAN)),
            "frames_buffered": F.coalesce("frames_buffered", F.lit(0)),
        }
    )


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


__all__ = [
    "align_scores",
    "buffer_scores",
    "current_state",
    "decision_engine",
    "ensemble",
    "latest_per_tick",
    "score_updates",
    "tick_of",
    "with_idle_calls",
]
