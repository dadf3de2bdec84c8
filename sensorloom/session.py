"""Session set-up and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
_FOLDERS: set[str] = set()


def tuning(name: str, default: int) -> int:
    """Size of a chunk, leaf or block: ``SENSORLOOM_<NAME>`` in the environment, or the default."""
    return int(os.environ.get(f"SENSORLOOM_{name}", default))


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sensorloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SENSORLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the workers, for clusters (or working folders) that have not installed it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="sensorloom-ship-"), "sensorloom"), "zip", root, "sensorloom")
    spark.sparkContext.addPyFile(made)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_by_user = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_by_user.isDefined():
        return set_by_user.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="sensorloom-")
    return _LOCAL_SCRATCH[app]


def folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one; it goes when Python ends, or with :func:`forget`."""
    app = spark.sparkContext.applicationId
    path = f"{scratch_dir(spark)}/sensorloom-{app}"
    if path not in _FOLDERS:
        _FOLDERS.add(path)
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        context = spark.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        # a stopped context has no configuration left; the default one knows local and default file systems
        conf = context._jsc.hadoopConfiguration() if context._jsc else context._jvm.org.apache.hadoop.conf.Configuration()
        where.getFileSystem(conf).delete(where, True)


def forget(spark: SparkSession) -> None:
    """Delete every table written so far by this application; results that still read them can't be used afterwards."""
    _remove(spark, folder(spark))


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Lineage ends here, an executor lost later costs only a re-read, values that
    depend on the partitioning are fixed for good, and the planner knows the
    true size, so it broadcasts the table only when it really is small.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
