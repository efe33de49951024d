"""Rolling decisions over a stream of score updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxward.functions.labels import classify, from_code, label_code
from voxward.operators.decision import with_idle_calls
from voxward.operators.timeline import Timeline
from voxward.params import AI, HUMAN, SUSPICIOUS, DecisionParams
from voxward.streaming.ordered import OrderedProcessor, memories_of, run_ordered


class DecisionState(OrderedProcessor):
    """Score buffer, label and latest model scores of one call."""

    fields = ("cnn", "gmm")
    memory = T.StructType(
        [
            T.StructField("scores", T.ArrayType(T.DoubleType())),
            T.StructField("seq", T.LongType()),
            T.StructField("label", T.StringType()),
            T.StructField("cnn", T.DoubleType()),
            T.StructField("gmm", T.DoubleType()),
            T.StructField("was_ai", T.BooleanType()),
        ]
    )

    def __init__(self, key: str, tie: str, params: DecisionParams, fill: bool, idle_s: int | None):
        super().__init__(key, tie, idle_s)
        self.params, self.fill = params, fill

    def _score(self, cnn: float | None, gmm: float | None) -> float:
        known = [v for v in (cnn, gmm) if v is not None]
        if len(known) == 2:
            return self.params.cnn_weight * cnn + self.params.gmm_weight * gmm
        return known[0] if known else 0.0

    def _label(self, score: float) -> str:
        p = self.params
        return HUMAN if score < p.human_threshold else SUSPICIOUS if score < p.ai_threshold else AI

    def step(self, key, memory, rows):
        scores, seq, label, cnn, gmm, was_ai = memory or ([], 0, HUMAN, None, None, False)
        scores, made, size = list(scores), [], self.params.buffer_size
        for us, tie, new_cnn, new_gmm in rows:
            if self.fill:
                cnn = cnn if new_cnn is None else new_cnn
                gmm = gmm if new_gmm is None else new_gmm
            else:
                cnn, gmm = new_cnn, new_gmm
            score = self._score(cnn, gmm)
            scores.append(score)
            del scores[:-size]
            average = sum(scores) / len(scores)
            now, full = self._label(average), len(scores) == size
            notify = full and now == AI and label != AI
            label = now if full else label
            was_ai = was_ai or now == AI
            seq += 1
            made.append(
                (key, us, tie, seq, cnn, gmm, score, average, now, notify, full, len(scores), was_ai)
            )
        return (scores, seq, label, cnn, gmm, was_ai), made


def decision_stream(
    updates: DataFrame,
    params: DecisionParams = DecisionParams(),
    ts: str = "update_ts",
    tie: str = "update_seq",
    fill: bool = False,
    delay: str = "1 minute",
    idle_s: int | None = 86_400,
    history: DataFrame | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """The decision fields per update, and whether the call has been AI so far.

    ``fill`` carries each model's latest score forward, for streams with one
    row per model result. ``idle_s`` forgets a call after so long without updates;
    None keeps its state for ever. ``history`` (see ``decision_history``) lets a new
    job go on where a batch run over the updates before it has ended. ``buckets`` keeps the state of many calls together
    (see ``run_ordered``).
    """
    kind = updates.schema["call_id"].dataType.simpleString()
    made = run_ordered(
        updates.withColumn(tie, F.col(tie).cast("bigint")),
        DecisionState("call_id", tie, params, fill, idle_s),
        ts,
        delay,
        f"call_id {kind}, update_us bigint, tie bigint, update_seq bigint, cnn double, gmm double,"
        " ensemble_score double, average_score double, label string, should_notify boolean,"
        " buffer_full boolean, frames_buffered int, call_was_ai boolean",
        history,
        buckets,
    )
    return made.withColumn("update_ts", F.timestamp_micros("update_us")).drop("update_us")


def decision_history(decided: DataFrame, order: tuple[str, ...] = ("update_ts", "update_seq"), fill: bool = False) -> DataFrame:
    """What a decision job has to remember of each call, from the output of ``buffer_scores`` over all its updates so far.

    ``order`` begins with the time. One aggregate that combines before the shuffle, so a call with very many updates
    costs no more than others. Calls that are NULL have no state on streams and are left out.
    """
    at = Timeline(("call_id",), order).at
    # Without ``fill`` the job remembers the scores of the last update only, whatever they are.
    latest = {m: F.max_by(m, F.when(F.col(m).isNotNull(), at)) if fill else F.max_by(m, at) for m in ("cnn", "gmm")}
    state = decided.filter(F.col("call_id").isNotNull()).groupBy("call_id").agg(
        F.max_by("buffer_scores", at).alias("scores"),
        F.count(F.lit(1)).alias("seq"),
        # The label counts for the next update once the buffer is full.
        F.max_by(F.when(F.col("buffer_full"), label_code(F.col("label"))), at).alias("label"),
        *[pick.alias(m) for m, pick in latest.items()],
        F.bool_or(F.col("label") == AI).alias("was_ai"),
        F.max(F.unix_micros(F.col(order[0]).cast("timestamp"))).alias("seen"),
    )
    return state.withColumn("label", F.coalesce(from_code(F.col("label")), F.lit(HUMAN)))


def running_state(
    spark: SparkSession,
    checkpoint: str,
    params: DecisionParams = DecisionParams(),
    calls: DataFrame | None = None,
    bucketed: str | None = None,
) -> DataFrame:
    """``current_state`` of a decision job, read from its state as of its last finished micro-batch.

    The state is read where it lies, a task per partition of it; no update is read again and the job may go on running.
    ``calls`` adds those that had no update yet. ``bucketed`` is the type of ``call_id`` in a job with ``buckets``.
    """
    if bucketed is None:
        held = spark.read.format("statestore").option("stateVarName", "state").load(checkpoint)
        held = held.select("key.call_id", "value.memory")
    else:
        held = memories_of(spark, checkpoint, "call_id", bucketed, DecisionState)
    # A call whose updates all wait for the watermark remembers nothing yet.
    held = held.select("call_id", F.col("memory.scores").alias("scores")).filter(F.size("scores") > 0)
    average = F.aggregate("scores", F.lit(0.0), lambda a, v: a + v) / F.size("scores")
    state = held.select("call_id", average.alias("average_score"), F.size("scores").alias("frames_buffered"))
    state = state.select("call_id", "average_score", classify(F.col("average_score"), params).alias("label"), "frames_buffered")
    return state if calls is None else with_idle_calls(calls, state)
