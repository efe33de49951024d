"""Session helpers: settings for local runs and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("voxward")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .config(_STATE_STORE, _ROCKSDB)
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship_package(spark)


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, whatever the session's own setting is."""
    before = spark.conf.get(_STATE_STORE)
    spark.conf.set(_STATE_STORE, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_STATE_STORE, before)


def drain(stream: DataFrame, name: str, keep_state: bool = False) -> DataFrame | tuple[DataFrame, str]:
    """Run a stream over what its source has now and read back what it wrote.

    The checkpoint goes at once, the rows when Python ends. Rows behind the
    watermark come out only if the source was ``closed``. With ``keep_state`` the
    checkpoint stays as long as the rows and its place is given too.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    kept = False
    try:
        with rocksdb(spark):
            query = (
                stream.writeStream.format("parquet")
                .option("checkpointLocation", f"{base}-checkpoint")
                .option("path", base)
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()
        kept = keep_state
    finally:
        (delete_at_end if kept else _delete)(spark, f"{base}-checkpoint")
    delete_at_end(spark, base)
    made = spark.read.schema(stream.schema).parquet(base)
    return (made, f"{base}-checkpoint") if keep_state else made


def closed(stream: DataFrame, ts: str, key: str) -> DataFrame:
    """A finite stream with a last row that is far past all others, under a reserved ``key`` and otherwise NULL.

    It lets the watermark pass every real row, so that a stream over stored
    data gives complete results. The row itself never gets due. Reserved are
    the smallest long and the text of one NUL.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/closing-{uuid.uuid4().hex}"
    numeric = isinstance(stream.schema[key].dataType, T.LongType)
    given = {ts: F.lit("2200-01-01"), key: F.lit(-(1 << 63)) if numeric else F.lit("\0")}
    last = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema]
    spark.range(1).select(last).write.parquet(folder)
    delete_at_end(spark, folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


_made: list[tuple[SparkSession, str]] = []


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Results are lazy and may be read for as long as Python runs; then their tables go."""
    _made.append((spark, path))


@atexit.register
def _delete_made() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the JVM may be gone
            _delete(spark, path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Give this package to the Python workers, once per application.

    Needed wherever it is neither installed on the workers nor in their
    working folder.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        base = Path(tempfile.mkdtemp(prefix="voxward-")) / package.name
        context.addPyFile(shutil.make_archive(str(base), "zip", package.parent, package.name))
        # The driver's own worker, which prepares stateful streams, takes this path instead.
        paths = [str(package.parent), context.environment.get("PYTHONPATH", "")]
        context.environment["PYTHONPATH"] = ":".join(p for p in paths if p)
        _shipped.add(context.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see.

    Read from ``spark.checkpoint.dir``, else one in the warehouse, which is
    shared as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several jobs read a costly result. The written table outlives
    lost executors, so nothing upstream is computed again; it goes when Python
    ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)
