"""Session helpers: a tuned local session, and shipping this package to the executors."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def local_session(cores: int | str = "*", app: str = "bidlake", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once an application.

    The files go through Spark's own file server, so no folder has to be shared.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    fd, path = tempfile.mkstemp(prefix="bidlake-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, f"{PACKAGE.name}/{p.relative_to(PACKAGE)}")
    sc.addPyFile(path)  # the driver serves it from here for as long as it lives
    atexit.register(lambda: os.path.exists(path) and os.unlink(path))
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, spark.checkpoint.dir; one of our own where it is unset and the session is a single process."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="bidlake-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def _remove(files, place) -> None:
    try:
        files.delete(place, True)
    except Exception:  # noqa: BLE001  the JVM is gone already
        pass


def cut(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, for what several branches of a plan read: it is made once, and a lost executor costs its tasks only. The table goes as the driver ends."""
    spark = df.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}")
    atexit.register(_remove, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place)
    df.write.parquet(place.toString())
    return spark.read.schema(df.schema).parquet(place.toString())
