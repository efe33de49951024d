"""Scoring frames with a pluggable classifier and a pair of Gaussian mixtures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from time import perf_counter

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxward.functions import dsp
from voxward.functions.labels import gmm_confidence, model_label
from voxward.operators.features import KEYS, per_batch
from voxward.params import ModelThresholds, SilenceParams
from voxward.schemas import GMM_MODEL

Scorer = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class LogisticScorer:
    """Probability of AI from flattened features."""

    weights: np.ndarray
    bias: float

    def __call__(self, features: np.ndarray) -> np.ndarray:
        z = features.reshape(len(features), -1) @ self.weights + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


@dataclass(frozen=True)
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray

    def mean_loglik(self, x: np.ndarray) -> np.ndarray:
        """Mean over the rows of each set of vectors; ``x`` is one set or a stack of them."""
        logs = dsp.mixture_loglik(x.reshape(-1, x.shape[-1]), self.weights, self.means, self.covs)
        return logs.reshape(x.shape[:-1]).mean(axis=-1)


def load_mixtures(params: DataFrame) -> dict[str, Mixture]:
    """The mixtures of a parameter table, by model name.

    Holds the model itself, a few rows by contract, so it is read whole.
    """
    rows = params.orderBy("model", "component").collect()
    out = {}
    for name in sorted({r["model"] for r in rows}):
        mine = [r for r in rows if r["model"] == name]
        out[name] = Mixture(*(np.array([r[c] for r in mine]) for c in ("weight", "mean", "cov")))
    return out


def fit_logistic(
    data: DataFrame, features: str, label: str, max_iter: int = 30, penalty: float = 0.01, tol: float = 1e-6
) -> LogisticScorer:
    """Train the stand-in classifier on flat feature arrays and a 0/1 label.

    ``penalty`` is on the squares of the weights in units of their feature's deviation; ``tol`` says when to stop.
    """
    rows = data.select(
        array_to_vector(F.transform(features, lambda v: v.cast("double"))).alias("features"),
        F.col(label).cast("double").alias("label"),
    )
    model = LogisticRegression(maxIter=max_iter, regParam=penalty, tol=tol).fit(rows)
    return LogisticScorer(model.coefficients.toArray(), model.intercept)


def em_step(data: DataFrame, mixtures: dict[str, Mixture], is_ai: Column, vectors: str = "lfcc") -> dict[str, Mixture]:
    """Both mixtures after one step of expectation and maximisation over the rows of their side.

    Each batch of frames gives sums of shares, vectors and products per component, which combine before the shuffle; only
    sums of the size of the model come back. A component that no row has a share in stays as it was. Rows whose side is
    NULL and frames without vectors are in neither sum.
    """

    def shares(batches):
        for batch in batches:
            for name, mine in batch.groupby("model"):
                mixture = mixtures[name]
                x = np.vstack([np.stack(v) for v in mine["x"]]).astype(np.float64)
                logs = np.stack(
                    [
                        np.log(w) + dsp.mixture_loglik(x, np.ones(1), m[None], c[None])
                        for w, m, c in zip(mixture.weights, mixture.means, mixture.covs, strict=True)
                    ]
                )
                share = np.exp(logs - np.logaddexp.reduce(logs, axis=0))
                for i, r in enumerate(share):
                    off = x - mixture.means[i]
                    sums = np.concatenate([[r.sum()], r @ off, ((off * r[:, None]).T @ off).ravel()])
                    yield pd.DataFrame({"model": name, "component": i, "sums": [sums]})

    side = F.when(is_ai, "ai").when(~is_ai, "human")
    rows = data.select(side.alias("model"), F.col(vectors).alias("x")).filter(F.col("model").isNotNull() & (F.size("x") > 0))
    parts = rows.mapInPandas(shares, "model string, component int, sums array<double>")
    cells = parts.select("model", "component", F.posexplode("sums")).groupBy("model", "component", "pos").agg(F.sum("col").alias("total"))
    found = cells.groupBy("model", "component").agg(F.array_sort(F.collect_list(F.struct("pos", "total"))).alias("cells")).collect()
    totals = {(r["model"], r["component"]): np.array([c["total"] for c in r["cells"]]) for r in found}
    out = {}
    for name, old in mixtures.items():
        d = old.means.shape[1]
        # Sums are taken about the old means, which keeps small variances beside large means.
        mine = [totals.get((name, i), np.zeros(1 + d + d * d)) for i in range(len(old.weights))]
        n = np.array([t[0] for t in mine])
        means, covs = old.means.copy(), old.covs.copy()
        for i, t in enumerate(mine):
            if n[i] > 0:
                shift = t[1 : 1 + d] / n[i]
                means[i] = old.means[i] + shift
                covs[i] = t[1 + d :].reshape(d, d) / n[i] - np.outer(shift, shift)
        out[name] = Mixture(n / n.sum() if n.sum() > 0 else old.weights, means, covs)
    return out


def _mixture_table(spark: SparkSession, mixtures: dict[str, Mixture]) -> DataFrame:
    rows = [
        (name, i, float(w), m.tolist(), c.tolist())
        for name, mix in mixtures.items()
        for i, (w, m, c) in enumerate(zip(mix.weights, mix.means, mix.covs, strict=True))
    ]
    return spark.createDataFrame(rows, GMM_MODEL)


def fit_gmm_pair(
    data: DataFrame,
    vectors: str,
    is_ai: Column,
    k: int = 2,
    max_iter: int = 20,
    seed: int = 7,
    start: dict[str, Mixture] | None = None,
) -> DataFrame:
    """Fit one mixture to human and one to AI rows; returns the parameter table.

    ``vectors`` holds an array of feature vectors per frame. The fits are
    distributed, only the parameters come back. With ``start`` the fit goes on
    from given mixtures for ``max_iter`` steps, as to follow new calls; ``k`` and ``seed`` don't count then.
    """
    spark: SparkSession = data.sparkSession
    if start is not None:
        for _ in range(max_iter):
            start = em_step(data, start, is_ai, vectors)
        return _mixture_table(spark, start)
    points = data.select(is_ai.alias("_ai"), F.explode(vectors).alias("_x")).select(
        "_ai", array_to_vector(F.transform("_x", lambda v: v.cast("double"))).alias("features")
    )
    rows = []
    for name, wanted in (("human", False), ("ai", True)):
        fitted = GaussianMixture(k=k, maxIter=max_iter, seed=seed).fit(
            points.filter(F.col("_ai") == wanted)
        )
        for i, (w, g) in enumerate(zip(fitted.weights, fitted.gaussians, strict=True)):
            rows.append((name, i, float(w), g.mean.tolist(), g.cov.toArray().tolist()))
    return spark.createDataFrame(rows, GMM_MODEL)


def gmm_loglik(
    data: DataFrame, mixtures: dict[str, Mixture], keys: tuple[str, ...], vectors: str = "lfcc", timed: bool = False
) -> DataFrame:
    """Mean log likelihood of each frame's vectors under both mixtures, with ``timed`` also the time per frame as ``gmm_ms``."""
    names = ("ll_human", "ll_ai", *(("gmm_ms",) if timed else ()))
    fields = [T.StructField(c, T.DoubleType()) for c in names]
    schema = T.StructType([data.schema[k] for k in keys] + fields)

    def run(batches):
        for batch in batches:
            stacks = [np.stack(v).astype(np.float64) for v in batch[vectors]]
            start = perf_counter()
            found = {f"ll_{m}": [float(mixtures[m].mean_loglik(x)) for x in stacks] for m in ("human", "ai")}
            if timed:
                found["gmm_ms"] = (perf_counter() - start) * 1000 / max(len(batch), 1)
            yield batch[list(keys)].assign(**found)

    return data.select(*keys, vectors).mapInPandas(run, schema)


def score_features(
    data: DataFrame, scorer: Scorer, keys: tuple[str, ...], features: str = "mel"
) -> DataFrame:
    """Apply a scorer to stored features: confidence, label and time per row."""
    fields = [T.StructField("confidence_pct", T.DoubleType()), T.StructField("inference_ms", T.DoubleType())]
    schema = T.StructType([data.schema[k] for k in keys] + fields)

    def run(batches):
        for batch in batches:
            if len(batch):
                start = perf_counter()
                p = np.asarray(scorer(np.stack(batch[features])), np.float64)
                ms = (perf_counter() - start) * 1000 / len(batch)
                yield batch[list(keys)].assign(confidence_pct=p * 100, inference_ms=ms)

    scored = data.select(*keys, features).mapInPandas(run, schema)
    return scored.withColumn("label", model_label(F.col("confidence_pct")))


def measure_frames(
    frames: DataFrame,
    cnn: Scorer | None = None,
    mixtures: dict[str, Mixture] | None = None,
    keys: tuple[str, ...] = KEYS,
    silence: SilenceParams | None = None,
    cepstra: bool = False,
) -> DataFrame:
    """All numbers the later steps need from a frame's audio, one row per frame.

    Audio crosses to Python once: silence check, both feature sets and both
    scores come from the same batch, and only numbers go back. With ``silence``
    frames that are mostly silent are marked, and no features are made of them.
    With ``cepstra`` those of every frame, silent or not, are kept as ``lfcc``, so that mixtures fitted on them score the
    frames without their audio (``score_measured``).
    """
    if cnn is None and mixtures is None:
        raise ValueError("scoring needs a scorer, a pair of mixtures, or both")
    names = ("silence_ratio", "max_amplitude", "cnn_pct", "cnn_ms", "ll_human", "ll_ai", "gmm_ms")

    def score(low: list[np.ndarray]) -> dict[str, object]:
        out = {}
        if cnn is not None:
            mel = dsp.cnn_features(np.stack([dsp.fit_center(x) for x in low]))
            start = perf_counter()
            out["cnn_pct"] = np.asarray(cnn(mel), np.float64) * 100
            out["cnn_ms"] = (perf_counter() - start) * 1000 / len(low)
        if mixtures is not None:
            vectors = dsp.lfcc(np.stack([dsp.fit_head(x) for x in low]))
            start = perf_counter()
            for name in ("human", "ai"):
                out[f"ll_{name}"] = mixtures[name].mean_loglik(vectors)
            out["gmm_ms"] = (perf_counter() - start) * 1000 / len(low)
        return out

    def fn(samples: pd.Series, rates: pd.Series) -> tuple:
        samples = samples.map(dsp.as_samples)
        out = pd.DataFrame(index=samples.index, columns=list(names), dtype=np.float64)
        out["max_amplitude"] = [np.abs(x).max() if len(x) else None for x in samples]
        heard = np.ones(len(samples), bool)
        if silence is not None:
            out["silence_ratio"] = [dsp.silence_ratio(x, silence.at(r)) for x, r in zip(samples, rates, strict=True)]
            heard = (out["silence_ratio"] <= silence.max_ratio).to_numpy()
        low = [dsp.resample(x, r) if h or cepstra else None for x, r, h in zip(samples, rates, heard, strict=True)]
        if heard.any():
            for name, values in score([x for x, h in zip(low, heard, strict=True) if h]).items():
                out.loc[heard, name] = values
        columns = tuple(out[name] for name in names)
        if not cepstra:
            return columns
        return *columns, [list(rows) for rows in dsp.lfcc(np.stack([dsp.fit_head(x) for x in low]))]

    fields = [T.StructField(c, T.DoubleType()) for c in names]
    if cepstra:
        fields.append(T.StructField("lfcc", T.ArrayType(T.ArrayType(T.DoubleType()))))
    measured = per_batch(frames, keys, fields, fn)
    silent = F.lit(False)
    if silence is not None:
        silent = F.col("silence_ratio") > silence.max_ratio
    return measured.withColumn("is_silent", silent)


def model_results(
    measured: DataFrame,
    keys: tuple[str, ...] = KEYS,
    models: tuple[str, ...] = ("cnn", "gmm"),
    cuts: ModelThresholds = ModelThresholds(),
) -> DataFrame:
    """Measured frames as one result row per frame and model; silent frames have none."""
    pct = {"cnn": F.col("cnn_pct"), "gmm": gmm_confidence(F.col("ll_ai"), F.col("ll_human"))}
    per_model = [
        F.struct(
            F.lit(m).alias("model"),
            # A heard frame without a number is one whose model gave NaN.
            F.coalesce(pct[m], F.lit(float("nan"))).alias("confidence_pct"),
            F.col(f"{m}_ms").alias("inference_ms"),
        )
        for m in models
    ]
    rows = measured.filter(~F.col("is_silent")).select(*keys, F.inline(F.array(*per_model)))
    return rows.withColumn("label", model_label(F.col("confidence_pct"), cuts))


def models_of(cnn: Scorer | None, mixtures: dict[str, Mixture] | None) -> tuple[str, ...]:
    """Names of the models that are there."""
    return tuple(m for m, used in (("cnn", cnn), ("gmm", mixtures)) if used is not None)


def score_frames(
    frames: DataFrame,
    cnn: Scorer | None = None,
    mixtures: dict[str, Mixture] | None = None,
    keys: tuple[str, ...] = KEYS,
    cuts: ModelThresholds = ModelThresholds(),
    silence: SilenceParams | None = None,
) -> DataFrame:
    """Both models' results for audio frames, one row per frame and model."""
    measured = measure_frames(frames, cnn, mixtures, keys, silence)
    return model_results(measured, keys, models_of(cnn, mixtures), cuts)


def score_measured(
    measured: DataFrame,
    mixtures: dict[str, Mixture],
    keys: tuple[str, ...] = KEYS,
    cuts: ModelThresholds = ModelThresholds(),
) -> DataFrame:
    """``score_frames`` from frames measured by a scorer alone with their ``cepstra``: the audio is not read again."""
    kept = (*keys, "cnn_pct", "cnn_ms", "is_silent")
    heard = measured.filter(~F.col("is_silent"))
    return model_results(gmm_loglik(heard, mixtures, kept, timed=True), keys, cuts=cuts)


def latency_stats(
    results: DataFrame,
    key: str = "model",
    value: str = "inference_ms",
    quantiles: tuple[float, ...] = (0.5, 0.95),
    step: float = 0.01,
) -> DataFrame:
    """Count, mean and exact quantiles of the times per model.

    A quantile is the smallest time that so large a share of the results does
    not exceed. Counts on a grid of ``step`` ms tell in which cell it lies, then
    the distinct times of that cell are ranked, so a window sees no more rows
    than there are cells, or distinct times in one.
    """
    timed = results.filter(F.col(value).isNotNull()).select(
        F.col(key), F.col(value), F.floor(F.col(value) / step).alias("_cell")
    )
    cells = timed.groupBy(key, "_cell").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_sum"))
    upto = Window.partitionBy(key).orderBy("_cell")
    cells = cells.withColumns(
        {"_seen": F.sum("_n").over(upto), "_all": F.sum("_n").over(Window.partitionBy(key))}
    )
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("_q")
    hit = cells.select("*", wanted).filter(
        (F.col("_seen") >= F.col("_all") * F.col("_q")) & (F.col("_seen") - F.col("_n") < F.col("_all") * F.col("_q"))
    )
    hit = hit.select(
        F.col(key).alias("_key"), F.col("_cell").alias("_at"), "_q",
        (F.col("_seen") - F.col("_n")).alias("_before"), (F.col("_all") * F.col("_q")).alias("_rank"),
    )
    times = timed.groupBy(key, "_cell", value).agg(F.count(F.lit(1)).alias("_n"))
    inside = times.join(hit, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_cell") == F.col("_at")))
    within = Window.partitionBy(key, "_q").orderBy(value)
    inside = inside.withColumn("_seen", F.col("_before") + F.sum("_n").over(within))
    picks = [
        F.min(F.when((F.col("_q") == float(q)) & (F.col("_seen") >= F.col("_rank")), F.col(value))).alias(
            f"p{round(q * 100)}_ms"
        )
        for q in quantiles
    ]
    found = inside.groupBy(F.col(key).alias("_key")).agg(*picks)
    sums = cells.groupBy(key).agg(F.sum("_n").alias("n"), (F.sum("_sum") / F.sum("_n")).alias("avg_ms"))
    return sums.join(found, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
