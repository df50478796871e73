"""The package's source on the executors, and tables written between the stages of a plan."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Tables cut within each ``settled`` that is open, the innermost last.
_MADE: list[list[str]] = []
#: Deletes the shuffle files of a query when it ends; else they stay until the driver happens to collect its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send this package's source to the session's workers, once a session, so that they can
    import it wherever they start (some 50 kB)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(tempfile.mkdtemp(prefix="trackloom-src-"), "trackloom_src.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), os.path.dirname(root)))
    spark.sparkContext.addPyFile(at)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, as the session names it (``spark.checkpoint.dir``).  Where that is unset, a
    local session gets a temporary one, deleted when Python ends; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir is not set, and {master} needs a folder that all machines share")
        own = tempfile.mkdtemp(prefix="trackloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def folder(spark: SparkSession, name: str = "stage") -> str:
    """A new folder's path among the application's scratch tables."""
    return f"{shared_dir(spark)}/trackloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def clear(spark: SparkSession) -> None:
    """Delete the application's scratch tables, once its results are stored."""
    _delete(spark, f"{shared_dir(spark)}/trackloom/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read back: a stage that several later ones read is computed once, and
    a lost executor costs a reread.  Shuffle files that it took are deleted."""
    spark = df.sparkSession
    at, before = folder(spark), spark.conf.get(_TIDY)
    if _MADE:
        _MADE[-1].append(at)
    spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.set(_TIDY, before)
    return spark.read.schema(df.schema).parquet(at)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make()`` returns, cut; the tables that were cut on the way to it are deleted."""
    made: list[str] = []
    _MADE.append(made)
    try:
        df = cut(make())
        kept = made.pop()
    finally:
        _MADE.pop()
        for at in made:
            _delete(spark, at)
    if _MADE:
        _MADE[-1].append(kept)
    return df
