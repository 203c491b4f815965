"""Session builder and the folder for materialised intermediate results."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: dict[int, tuple[DataFrame, str]] = {}


def build_session(master: str = "local[8]", app: str = "feedloom", **conf: str) -> SparkSession:
    """A session with the settings every operator relies on: UTC, adaptive execution, Arrow."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder of its own; on a
    cluster a missing setting is an error, because a machine-local folder would not be shared.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    path = context.getCheckpointDir() if hasattr(context, "getCheckpointDir") else None
    if path:
        return path.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="feedloom-")
    atexit.register(shutil.rmtree, path, True)
    context.setCheckpointDir("file://" + path)
    return "file://" + path


def materialize(df: DataFrame, partition_by: list[str] | None = None, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage and survives the loss of executors. The files are removed when the
    driver ends, or by ``discard`` and ``release``; shuffle files of the write are removed when it is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/feedloom-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    if not _OWN:
        atexit.register(release, spark)
    _OWN.append(path)
    back = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(back)] = back, path
    return back


def discard(df: DataFrame) -> None:
    """Remove the files of a DataFrame that ``materialize`` has returned. What reads them must be consumed before."""
    _, path = _PATHS.pop(id(df))
    _OWN.remove(path)
    _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Remove all files ``materialize`` has written. Results that read them must be consumed before."""
    _PATHS.clear()
    while _OWN:
        _delete(spark, _OWN.pop())


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended already
        if path.startswith("file://"):
            shutil.rmtree(path[len("file://") :], ignore_errors=True)
