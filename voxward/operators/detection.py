"""Call detection over polled telemetry.

Tables: ``audio_session_poll``, ``process_poll`` and ``mic_usage_poll``. A poll
is one (host_id, poll_ts).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxward.functions.identity import is_voip, is_voip_name
from voxward.params import MIC_CONSENT_ROOT, VOIP_KEYWORDS

POLL = ("host_id", "poll_ts")


def active_sessions(sessions: DataFrame, direction: str = "render") -> DataFrame:
    """Sessions that play or record now and whose process is known."""
    return sessions.filter(
        (F.col("direction") == direction)
        & (F.col("state") == 1)
        & (F.col("pid") != 0)
        & F.col("process_name").isNotNull()
    )


def voip_sessions(sessions: DataFrame, keywords: Iterable[str] = VOIP_KEYWORDS) -> DataFrame:
    """Active render sessions of call programs; repeated pids stay."""
    match = is_voip(F.col("process_name"), F.col("parent_chain"), keywords)
    return active_sessions(sessions).filter(match)


def voip_output_pids(sessions: DataFrame, keywords: Iterable[str] = VOIP_KEYWORDS) -> DataFrame:
    return voip_sessions(sessions, keywords).select(*POLL, "pid").distinct()


def voip_mic_pids(sessions: DataFrame, keywords: Iterable[str] = VOIP_KEYWORDS) -> DataFrame:
    """Pids of call programs that record; ancestors do not count here."""
    recording = active_sessions(sessions, "capture")
    named = recording.filter(is_voip_name(F.col("process_name"), keywords))
    return named.select(*POLL, "pid").distinct()


def _under(path: Column, root: str | None) -> Column:
    if root is None:
        return F.lit(True)
    low, base = F.lower(path), root.lower()
    return (low == base) | low.startswith(base + "\\")


def _claim(root: str | None) -> tuple[Column, Column]:
    """Of a mic key: does it say "in use", and which program has to run for it (NULL: none)."""
    leaf = F.element_at(F.split("key_path", r"\\"), -1)
    exe = F.when(leaf.contains("#"), F.lower(F.element_at(F.split(leaf, "#"), -1)))
    used = _under(F.col("key_path"), root) & (F.col("last_used_start") > F.col("last_used_stop"))
    used = F.coalesce(used, F.lit(False))
    return used, F.when(used, exe)


def mic_in_use(
    mic: DataFrame, processes: DataFrame, root: str | None = MIC_CONSENT_ROOT
) -> DataFrame:
    """Per poll with mic keys: does any program use the microphone.

    A desktop key (``#`` in its last segment) counts only while its program
    runs. Keys and processes meet in one grouped aggregate instead of a join,
    so both are combined before the shuffle; each table is read once.
    """
    used, exe = _claim(root)
    keys = mic.select(
        *POLL, exe.alias("exe"), used.alias("claimed"), F.lit(False).alias("running"), F.lit(True).alias("keyed")
    )
    running = processes.select(
        *POLL,
        F.lower("process_name").alias("exe"),
        F.lit(False).alias("claimed"),
        F.lit(True).alias("running"),
        F.lit(False).alias("keyed"),
    )
    told = [F.bool_or(c).alias(c) for c in ("claimed", "running", "keyed")]
    by_exe = keys.unionByName(running).groupBy(*POLL, "exe").agg(*told)
    in_use = F.col("claimed") & (F.col("exe").isNull() | F.col("running"))
    polls = by_exe.groupBy(*POLL).agg(F.bool_or(in_use).alias("mic_in_use"), F.bool_or("keyed").alias("keyed"))
    return polls.filter("keyed").drop("keyed")


def detect_voip_sources(
    sessions: DataFrame,
    processes: DataFrame,
    mic: DataFrame,
    keywords: Iterable[str] = VOIP_KEYWORDS,
    root: str | None = MIC_CONSENT_ROOT,
) -> DataFrame:
    """Call programs per poll: those that play audio and, while the mic is used, those that run."""
    playing = voip_sessions(sessions, keywords).select(
        *POLL,
        "pid",
        F.lower("process_name").alias("name"),
        F.col("parent_chain").alias("chain"),
        F.lit(1).alias("method"),
    )
    live = mic_in_use(mic, processes, root).filter("mic_in_use").select(*POLL)
    fallback = (
        processes.filter(is_voip_name(F.col("process_name"), keywords))
        .join(live, list(POLL), "left_semi")
        .join(voip_output_pids(sessions, keywords), [*POLL, "pid"], "left_anti")
        .select(
            *POLL,
            "pid",
            F.lower("process_name").alias("name"),
            F.col("parent_chain").alias("chain"),
            F.lit(2).alias("method"),
        )
    )
    return playing.unionByName(fallback)


def poll_status(
    sessions: DataFrame,
    processes: DataFrame,
    mic: DataFrame,
    keywords: Iterable[str] = VOIP_KEYWORDS,
    root: str | None = MIC_CONSENT_ROOT,
) -> DataFrame:
    """One row per poll: call sources, call audio, mic use.

    Everything reaches the poll through two grouped aggregates over tagged
    rows, the first per poll and pid or program, the second per poll. There is
    no join and no spine: a poll shows up if any table has a row for it. Each
    table is read once, and equal programs of a poll combine before the shuffle.
    """

    def tagged(df: DataFrame, **cols: Column) -> DataFrame:
        fields = {
            "pid": F.lit(None).cast("int"),
            "exe": F.lit(None).cast("string"),
            "sessions": F.lit(0),
            "named": F.lit(0),
            "recording": F.lit(0),
            "claimed": F.lit(False),
            "running": F.lit(False),
        }
        fields.update(cols)
        return df.select(*POLL, *[c.alias(n) for n, c in fields.items()])

    active = (F.col("state") == 1) & (F.col("pid") != 0) & F.col("process_name").isNotNull()
    name, chain = F.col("process_name"), F.col("parent_chain")
    plays = active & (F.col("direction") == "render") & is_voip(name, chain, keywords)
    records = active & (F.col("direction") == "capture") & is_voip_name(name, keywords)
    one = F.lit(1)
    by_session = tagged(
        sessions,
        pid=F.col("pid"),
        sessions=F.when(plays, one).otherwise(0),
        recording=F.when(records, one).otherwise(0),
    )
    # A process proves that its program runs, and its poll took place; only those of
    # call programs count by pid as well.
    def tag(**cols: Column) -> Column:
        return F.struct(
            cols.get("pid", F.lit(None).cast("int")).alias("pid"),
            cols.get("exe", F.lit(None).cast("string")).alias("exe"),
            cols.get("named", F.lit(0)).alias("named"),
            cols.get("running", F.lit(False)).alias("running"),
        )

    runs = tag(exe=F.lower(name), running=F.lit(True))
    calls = F.when(is_voip_name(name, keywords), F.array(runs, tag(pid=F.col("pid"), named=one)))
    marked = processes.select(*POLL, F.inline(calls.otherwise(F.array(runs))))
    by_process = tagged(
        marked, pid=F.col("pid"), exe=F.col("exe"), named=F.col("named"), running=F.col("running")
    )
    # Mic keys out of use still prove that their poll took place.
    used, exe = _claim(root)
    by_key = tagged(mic, exe=exe, claimed=used)
    rows = by_session.unionByName(by_process).unionByName(by_key)
    parts = rows.groupBy(*POLL, "pid", "exe").agg(
        F.sum("sessions").alias("sessions"),
        F.sum("named").alias("named"),
        F.max("recording").alias("recording"),
        F.bool_or("claimed").alias("claimed"),
        F.bool_or("running").alias("running"),
    )
    used = F.col("claimed") & (F.col("exe").isNull() | F.col("running"))
    unseen = F.when(F.col("sessions") == 0, F.col("named")).otherwise(0)
    polls = parts.groupBy(*POLL).agg(
        F.sum("sessions").alias("_playing"),
        F.sum(unseen).alias("_fallback"),
        F.max("recording").alias("_recording"),
        F.bool_or(used).alias("_used"),
    )
    sources = F.col("_playing") + F.when(F.col("_used"), F.col("_fallback")).otherwise(0)
    return polls.select(
        *POLL,
        sources.alias("n_sources"),
        (sources > 0).alias("has_voip_audio"),
        # The mic is looked at only while there is call audio.
        ((sources > 0) & F.col("_used")).alias("mic_active"),
        (F.col("_recording") > 0).alias("mic_in_use_by_voip"),
    )


def mic_in_use_by_voip(sessions: DataFrame, keywords: Iterable[str] = VOIP_KEYWORDS) -> DataFrame:
    """Per poll: does a call program record."""
    active = (F.col("state") == 1) & (F.col("pid") != 0) & (F.col("direction") == "capture")
    named = F.coalesce(is_voip_name(F.col("process_name"), keywords), F.lit(False))
    return sessions.groupBy(*POLL).agg(F.bool_or(active & named).alias("mic_in_use_by_voip"))


def is_call_active(status: DataFrame, require_mic: bool = False) -> DataFrame:
    """Add ``call_active`` to poll status rows: call audio, and with ``require_mic`` the mic."""
    active = F.col("has_voip_audio")
    return status.withColumn("call_active", active & F.col("mic_active") if require_mic else active)


def is_call_active_strict(status: DataFrame) -> DataFrame:
    return is_call_active(status, require_mic=True)
