"""Quality rules with host-level verdicts, in DataFrame functions only.

Each text is measured and tested by rules. Failures are counted by host and
rule; the rates of hosts with few documents are shrunk towards the mean of all by
a beta prior fitted to the hosts (moments), and a host whose shrunk rate is over
the limit loses all its documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxward.llm.tables import fresh_name, small_side, stored

#: Runs of ASCII white space, and the characters that count as symbols.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class QualityParams:
    """Limits of the document rules, of a host's shrunk failure rate, and of the prior's weight in documents."""

    min_words: int = 50
    repeat_percent: int = 50
    symbol_percent: int = 10
    dup_line_percent: int = 30
    min_mean_chars: int = 3
    max_mean_chars: int = 12
    host_limit: float = 0.5
    min_prior: float = 2.0
    max_prior: float = 1000.0

    def rules(self) -> dict[str, Column]:
        """Failure conditions by rule; a text without words fails the first only."""
        n, chars = F.col("n_words"), F.col("word_chars")
        return {
            "short": n < self.min_words,
            "repeats": F.col("n_repeat_words") * 100 > n * self.repeat_percent,
            "symbols": F.col("n_symbols") * 100 > n * self.symbol_percent,
            "dup_lines": F.col("n_dup_lines") * 100 > F.col("n_lines") * self.dup_line_percent,
            "word_length": (chars < n * self.min_mean_chars) | (chars > n * self.max_mean_chars),
        }


def with_measures(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of MEASURES, all bigint, over whole texts; null texts count as empty.

    A word is repeated if it lies in a three-word window that occurs twice or
    more in the text, wherever; windows are compared by 64-bit hashes of their
    words. A repeated line has a word and equals an earlier line. Columns of
    these names in ``docs`` are replaced.
    """
    docs = docs.drop(*MEASURES)
    names = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select(
        *names,
        F.filter(F.split(text, SPACE), lambda x: x != "").alias("_words"),
        lines.alias("_lines"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).alias("n_symbols"),
    )
    words = F.col("_words")
    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("at")),
    )
    counted = split.select(
        *names,
        "n_symbols",
        F.size("_words").alias("n_words"),
        F.char_length(F.array_join("_words", "")).alias("word_chars"),
        F.size("_lines").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        windows.alias("_windows"),
    )
    # Most texts repeat no window; only the others are sorted with the places.
    hashes = F.col("_windows.h")
    repeated = counted.withColumn(
        "_sorted",
        F.when(F.size(F.array_distinct(hashes)) < F.size("_windows"), F.sort_array("_windows")).otherwise(
            F.slice("_windows", 1, 0)
        ),
    )
    order = F.col("_sorted")
    h = lambda i: F.get(order, i)["h"]
    again = F.filter(
        order, lambda e, i: F.coalesce(e["h"] == h(i - 1), F.lit(False)) | F.coalesce(e["h"] == h(i + 1), F.lit(False))
    )
    covered = F.array_distinct(F.flatten(F.transform(again, lambda e: F.array(e["at"], e["at"] + 1, e["at"] + 2))))
    measures = [F.size(covered) if c == "n_repeat_words" else F.col(c) for c in MEASURES]
    return repeated.select(*names, *(m.cast("bigint").alias(c) for c, m in zip(MEASURES, measures, strict=True)))


def bad_hosts(measured: DataFrame, host: str, params: QualityParams) -> DataFrame:
    """The hosts (column ``host``) whose shrunk failure rate is over the limit for some rule; a null host is one too.

    Counts are combined before the shuffle, so a host may hold any share of
    the documents. Only the prior, two numbers a rule, goes through the driver.
    """
    rules = params.rules()
    hosts = stored(
        measured.groupBy(host).agg(
            F.count("*").alias("docs"), *(F.count_if(failed).alias(name) for name, failed in rules.items())
        ),
        "hosts",
    )
    sums = hosts.agg(
        F.sum("docs").alias("docs"),
        *(F.sum(name).alias(name) for name in rules),
        *(F.sum(F.col(name) * F.col(name) / F.col("docs")).alias(f"{name}_squares") for name in rules),
    ).first()
    over = F.lit(False)
    for name in rules:
        alpha, beta = _prior(sums["docs"] or 0, sums[name] or 0, sums[f"{name}_squares"] or 0.0, params)
        over |= (F.col(name) + alpha) / (F.col("docs") + alpha + beta) > params.host_limit
    return stored(hosts.where(over).select(host), "bad-hosts")


def _prior(docs: int, failed: int, squares: float, params: QualityParams) -> tuple[float, float]:
    """Beta prior with the mean and variance of the hosts' rates, weighted by documents."""
    mean = failed / docs if docs else 0.0
    variance = squares / docs - mean * mean if docs else 0.0
    weight = mean * (1 - mean) / variance - 1 if variance > 1e-12 else params.max_prior
    weight = min(max(weight, params.min_prior), params.max_prior)
    return mean * weight, (1 - mean) * weight


def judge(docs: DataFrame, params: QualityParams = QualityParams(), host: str = "source") -> DataFrame:
    """``docs`` without ``text``, plus MEASURES, ``base_failed``, ``host_rejected``, ``kept``, and ``_text`` (the text's hash; ``_text_`` and so on if ``docs`` has that name).

    A document is kept if it has enough words, not too many repeated ones, and
    its host is not rejected. Measures are stored once without the texts; the
    host verdicts are joined to them. Null texts count as empty and fail.
    Repeated rows are judged each; an empty table gives no rows.
    """
    added = ("base_failed", "host_rejected", "kept")
    hashed, host_key = fresh_name(docs, "text"), fresh_name(docs, "host")
    measured = with_measures(docs.drop(*added).withColumn(hashed, F.xxhash64("text"))).drop("text")
    rules = params.rules()
    measured = stored(measured.withColumn("base_failed", rules["short"] | rules["repeats"]), "measures")
    bad = bad_hosts(measured, host, params).withColumnRenamed(host, host_key).withColumn("host_rejected", F.lit(True))
    joined = measured.join(small_side(bad), F.col(host).eqNullSafe(F.col(host_key)), "left").drop(host_key)
    rejected = F.coalesce("host_rejected", F.lit(False))
    return joined.withColumns({"host_rejected": rejected, "kept": ~F.col("base_failed") & ~rejected})


def keep_good(docs: DataFrame, params: QualityParams = QualityParams(), host: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, unchanged.

    Rejected rows are found by ``doc_id``, host and text, nulls included.
    """
    id_key, host_key, hashed = (fresh_name(docs, c) for c in ("id", "host", "text"))
    rejected = stored(
        judge(docs, params, host).where("NOT kept").select(
            F.col("doc_id").alias(id_key), F.col(host).alias(host_key), hashed
        ).distinct(),
        "rejected",
    )
    same = (
        F.col("doc_id").eqNullSafe(F.col(id_key)) & F.col(host).eqNullSafe(F.col(host_key)) & (F.xxhash64("text") == F.col(hashed))
    )
    return docs.join(small_side(rejected), same, "left_anti")
