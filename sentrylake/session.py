"""Session defaults used by the tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "sentrylake") -> SparkSession:
    """A local session with the settings the engine expects on a cluster."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SENTRYLAKE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor reaches; only a local session falls back to a folder of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="sentrylake-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def staged(df: DataFrame) -> DataFrame:
    """Write an intermediate that several later steps read and hand back the table. It is computed
    once, survives lost executors, and its size is known to the planner from then on."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_at(df: DataFrame) -> tuple[DataFrame, str]:
    """As staged, small rather than fast, and the folder, for removing it."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.writer.version", "v2").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediates that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: What a query shuffled leaves the disk as soon as the query ends, not when the driver next collects garbage.
FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_holding: dict = {}
_lock = threading.Lock()


@contextmanager
def held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Session settings for the time of a block. Blocks of several threads may overlap: the last one to end restores
    what was set before the first."""
    def at(key):
        return spark._jsparkSession.hashCode(), key
    with _lock:
        for key, value in settings.items():
            before, n = _holding.get(at(key), (spark.conf.get(key, None), 0))
            _holding[at(key)] = before, n + 1
            spark.conf.set(key, value)
    try:
        yield
    finally:
        with _lock:
            for key in settings:
                before, n = _holding.pop(at(key))
                if n > 1:
                    _holding[at(key)] = before, n - 1
                elif before is None:
                    spark.conf.unset(key)
                else:
                    spark.conf.set(key, before)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the cluster; only a bare test session gets its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="sentrylake-ckpt-"))
