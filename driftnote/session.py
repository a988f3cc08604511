"""Session helpers: building one for tests, and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def local_session(cores: int = 8, partitions: int = 8, name: str = "driftnote") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where that is unset (a local test) a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        base = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
        if not base:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="driftnote-"))
            base = sc.getCheckpointDir()
    return base.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the application's part of the shared folder, which is deleted when the driver ends."""
    root = f"{shared_dir(spark)}/driftnote/{spark.sparkContext.applicationId}"
    fs, p = file_system(spark, root)
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, and a lost executor costs nothing.

    The table stays until ``discard`` of the result, ``clean`` or the driver's end.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._driftnote_path = path
    return written


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What is planned and run in here leaves no shuffle files once it has run; else they stay until the driver happens to collect its garbage. For tables that are
    collected or cut, not for a result that the caller runs."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def discard(*tables: DataFrame | str) -> None:
    """Delete tables that ``cut`` wrote, or paths: those that nothing will read any more."""
    for t in tables:
        path = t if isinstance(t, str) else t.__dict__.get("_driftnote_path")
        if path:
            fs, p = file_system(SparkSession.getActiveSession(), path)
            fs.delete(p, True)


def clean(spark: SparkSession) -> None:
    """Delete everything that this application has written to the shared folder; results that weren't read yet can't be read afterwards."""
    fs, p = file_system(spark, f"{shared_dir(spark)}/driftnote/{spark.sparkContext.applicationId}")
    fs.delete(p, True)


def ship(spark: SparkSession) -> None:
    """Give the package to the executors of a cluster, once a session."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local" or getattr(sc, "_driftnote_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="driftnote-zip-"), "driftnote.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(_PACKAGE):
            for n in sorted(names):
                if not n.endswith(".pyc"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    sc.addPyFile(path)
    sc._driftnote_shipped = True
