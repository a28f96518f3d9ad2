"""Session helpers shared by the whole package."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
BATCH_CONF, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def build(app: str = "tidemark", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a local folder is made for the rest of the
    session, but only if driver and executors are one process (a ``local`` master); else it is an error.
    """
    root = spark.sparkContext.getConf().get(CHECKPOINT_CONF) or spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        existing = spark.sparkContext._jsc.sc().getCheckpointDir()
        if existing.isDefined():
            root = existing.get()
        elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            root = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
        else:
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        spark.conf.set(CHECKPOINT_CONF, root)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new, unused path below the shared folder. What is left there is removed when the driver ends."""
    path = f"{shared_root(spark)}/{kind}-{uuid.uuid4().hex}"
    atexit.register(_remove_quietly, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of the shared folder, if it is there."""
    jvm, context = spark._jvm, spark.sparkContext
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001 - the session is gone with its driver
        pass


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context, so that Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tidemark-ship-")  # on the driver, which serves the archive while the session lasts
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / f"{top.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    context.addPyFile(str(archive))
    # texts may be very long: batches to Python are bounded by bytes, unless the session has a bound of its own
    if spark.conf.get(BATCH_CONF, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_CONF, "8m")
    context._tidemark_shipped = True


def ship_active() -> None:
    """``ship`` for the active session, for functions that get no DataFrame."""
    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)


def arrow_map(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with this package at hand on the executors."""
    ship(df.sparkSession)

    def run(batches):
        yield from fn(batches)
        trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Give free memory of this worker back to the machine: idle workers stay alive for a while."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the C library of GNU
        pass
