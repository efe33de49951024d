"""A micro-batch's alerts of a day lie in few files, however many tasks it has."""

from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from voxward.sources.alerts import DAY_FILES, AlertSink


def test_files_of_a_day(spark, tmp_path):
    sink, shuffled = AlertSink(str(tmp_path / "alerts")), spark.conf.get("spark.sql.shuffle.partitions")
    first = F.lit(datetime(2024, 5, 1))
    rows = spark.range(3000).select(
        F.col("id").cast("string").alias("call_id"), F.lit("ai_voice").alias("kind"), (F.col("id") % 7).alias("update_seq"),
        (first + F.make_dt_interval(F.col("id") % 3)).alias("ts"),
    )
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as in a micro-batch with state
    try:
        sink.deliver(rows, "job", 0)
        sink.deliver(rows.union(rows.limit(5)), "job", 1)  # all known
        got = sink.read(spark).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
        spark.conf.unset("spark.sql.adaptive.enabled")
    want = {(str(i), i % 7, datetime(2024, 5, 1) + timedelta(days=i % 3)) for i in range(3000)}
    assert len(got) == 3000 and {(r.call_id, r.update_seq, r.ts) for r in got} == want
    for day in ("2024-05-01", "2024-05-02", "2024-05-03"):
        files = list(Path(sink.path).glob(f"job=job/run=0/epoch=0/day={day}/*.parquet"))
        assert 0 < len(files) <= DAY_FILES
