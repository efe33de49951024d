"""Maps the given star-schema tables onto the engine's tables.

Only columns are mapped here; every operator is the one used on real data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxward.functions.signal import pcm16
from voxward.params import MelParams, SilenceParams

# Words that stand for call programs in the part table.
PART_KEYWORDS = ("ring", "gear", "economy")
# Eight samples per chunk on vectors of 64.
VECTOR_SILENCE = SilenceParams(sample_rate=8, chunk_ms=1000, threshold_db=-18.0)
# A spectrogram of five columns and eight bands on vectors of 64.
VECTOR_MEL = MelParams(n_fft=64, hop=16, win=48, n_mels=8, fmin=100.0, fmax=7000.0)
CANDIDATE = r"[+0-9A-Za-z][0-9 ().-]{2,}[0-9]"
VECTOR_REPEATS = 2250  # 64 × 2250 = 144,000 samples: three seconds at 48 kHz


def live(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = table(spark, sf_dir, name).schema
    # A pattern, as a stream takes a single file only that way.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}[.]parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def polls(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    """Events as polls of the user's machine."""
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("host_id"),
        F.col("ts").alias("poll_ts"),
        "event_id",
        (kind != "error").alias("has_voip_audio"),
        kind.isin("click", "purchase").alias("mic_active"),
    )


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as audio frames of the user's call; errors are the silent ones."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("call_id"),
        "ts",
        "event_id",
        (F.col("event_type") == "error").alias("is_silent"),
    )


def scores(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    """Events as score updates of the user's call."""
    kind = F.col("event_type")
    cnn = F.least(F.col("value") / 100, F.lit(1.0))
    gmm = (_k() + F.lit(0.3137)) / 100
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("call_id"),
        "ts",
        "event_id",
        F.when(kind != "signup", cnn).alias("cnn"),
        F.when(kind != "purchase", gmm).alias("gmm"),
        (kind == "error").alias("is_silent"),
    )


def results(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    """Events as results of one model each."""
    kind, ts = F.col("event_type"), F.col("ts")
    hour = F.unix_date(F.to_date(ts)).cast("bigint") * 24 + F.hour(ts)
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("call_id"),
        hour.alias("tick"),
        ts.alias("result_ts"),
        "event_id",
        F.when(kind.isin("click", "view"), "cnn").otherwise("gmm").alias("model"),
        F.least(F.col("value"), F.lit(100.0)).alias("confidence_pct"),
        F.col("value").alias("inference_ms"),
    )


def _word() -> Column:
    return F.element_at(F.split("p_name", " "), 2)


def _poll_of_part() -> list[Column]:
    poll = F.concat_ws("-", F.col("p_type"), (F.col("p_partkey") % 10).cast("string"))
    return [F.col("p_brand").alias("host_id"), poll.alias("poll_ts")]


def part_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as audio sessions: a render and a capture session each."""
    part = table(spark, sf_dir, "part")
    directions = F.array(
        F.struct(F.lit("render").alias("direction"), (F.col("p_size") % 2).alias("state")),
        F.struct(F.lit("capture").alias("direction"), (F.col("p_size") % 3).alias("state")),
    )
    return part.select(
        *_poll_of_part(),
        F.col("p_partkey").alias("pid"),
        _word().alias("process_name"),
        F.array(F.lower("p_type"), _word()).alias("parent_chain"),
        F.inline(directions),
    )


def part_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large parts as running processes."""
    return table(spark, sf_dir, "part").filter("p_size > 25").select(
        *_poll_of_part(),
        F.col("p_partkey").alias("pid"),
        _word().alias("process_name"),
        F.array(F.lower("p_type"), _word()).alias("parent_chain"),
    )


def part_mic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as mic consent keys, desktop keys where the size is odd."""
    desktop = F.concat(F.lit("apps\\C:#app#"), _word())
    packaged = F.concat(F.lit("apps\\"), _word())
    return table(spark, sf_dir, "part").select(
        *_poll_of_part(),
        F.when(F.col("p_size") % 2 == 1, desktop).otherwise(packaged).alias("key_path"),
        (F.col("p_partkey") % 7).alias("last_used_start"),
        (F.col("p_size") % 5).cast("bigint").alias("last_used_stop"),
    )


def ui_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number-like strings of a document as texts in its call window."""
    found = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    texts = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("call_id"), F.posexplode(found).alias("walk_ordinal", "text")
    )
    window = F.when(F.length("text") > 10, "Voice call").otherwise("Video call")
    return texts.withColumns({"window_name": window, "depth": F.col("walk_ordinal") + 1})


def customer_hash(key: str) -> Column:
    return F.sha2(F.format_string("Customer#%09d", key), 256)


def customer_phone(key: str) -> Column:
    """A customer's number as a call window shows it."""
    return F.regexp_replace(F.format_string("+%010d", key), r"(\d{4})(?=\d)", "$1 ")


def phone_hash(key: str) -> Column:
    return F.sha2(F.regexp_replace(customer_phone(key), " ", ""), 256)


def walks(calls: DataFrame, seen: str) -> DataFrame:
    """Each row as a walk over two call windows; only the third text of the first window is the caller's number."""
    shown = (
        ("Video call", 0, 1, F.lit("+99 999 9999")),
        ("Voice call", 1, 16, F.lit("+88 888 8888")),
        ("Voice call", 2, 2, F.lit("Mute")),
        ("Voice call", 3, 3, customer_phone("call_id")),
        ("Voice call", 4, 3, F.lit("+77 777 7777")),
    )
    names = ("window_name", "walk_ordinal", "depth", "text")
    texts = [F.struct(*[(v if n == "text" else F.lit(v)).alias(n) for n, v in zip(names, t, strict=True)]) for t in shown]
    return calls.select("call_id", F.col(seen).alias("seen_ts"), F.inline(F.array(*texts)))


def blocklist(spark: SparkSession, sf_dir: str, hashed=customer_hash) -> DataFrame:
    """Customers as listed callers: machinery buyers are unknown, debtors have no strikes."""
    strikes = F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey") % 3)
    since = F.expr("timestamp_ntz'1994-01-01 00:00:00' + make_dt_interval(c_nationkey)")
    return table(spark, sf_dir, "customer").filter("c_mktsegment <> 'MACHINERY'").select(
        hashed("c_custkey").alias("phone_hash"),
        strikes.cast("int").alias("strike_count"),
        since.alias("last_flagged_at"),
    )


def order_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as closed calls; finished orders were AI, urgent ones hide the caller."""
    known = F.col("o_orderpriority") != "1-URGENT"
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("call_id"),
        F.col("o_orderdate").alias("end_ts"),
        (F.col("o_orderstatus") == "F").alias("call_was_ai"),
        F.when(known, customer_hash("o_custkey")).alias("caller_hash"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as short frames of 64 samples."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").alias("samples"), "label"
    )


def rated_vectors(spark: SparkSession, sf_dir: str, rate: int) -> DataFrame:
    """Embeddings as short frames at a sample rate."""
    return vectors(spark, sf_dir).withColumn("sample_rate", F.lit(rate))


def pcm_tones(spark: SparkSession, sf_dir: str, repeats: int = VECTOR_REPEATS, rate: int = 48_000) -> DataFrame:
    """The same frames as 16-bit PCM bytes."""
    cores = spark.sparkContext.defaultParallelism
    # Two bytes per sample, low byte first, written in hexadecimal.
    unsigned = F.transform(pcm16(F.col("samples")), lambda v: F.pmod(v.cast("int"), F.lit(65_536)))
    digits = F.transform(unsigned, lambda v: F.lpad(F.hex((v % 256) * 256 + F.floor(v / 256)), 4, "0"))
    spread = vectors(spark, sf_dir).repartition(cores * 4, "vec_id")
    return spread.select(
        "vec_id",
        "label",
        F.lit(rate).alias("sample_rate"),
        F.unhex(F.repeat(F.array_join(digits, ""), repeats)).alias("samples"),
    )


def tones(spark: SparkSession, sf_dir: str, repeats: int = VECTOR_REPEATS, rate: int = 48_000) -> DataFrame:
    """Embeddings as audio frames: the vector is one period of a sound, repeated.

    Spread over the cores first, as a row grows from 256 bytes to half a
    megabyte here; on real audio the files give that parallelism.
    """
    cores = spark.sparkContext.defaultParallelism
    tiled = F.flatten(F.array_repeat("samples", repeats))
    spread = vectors(spark, sf_dir).repartition(cores * 4, "vec_id")
    return spread.select(
        "vec_id", "label", F.lit(rate).alias("sample_rate"), tiled.alias("samples")
    )
