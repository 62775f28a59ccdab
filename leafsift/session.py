"""Session helpers: parallelism, shared scratch tables, shipping of the package."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: list[str] = []


def build(app: str = "leafsift", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on; existing settings of a cluster win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, 1)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a scan that has fewer partitions than the cluster has cores.

    A large scan has many splits and passes unchanged, so no shuffle is added at scale; a small
    file whose one row group would keep every other core idle is dealt out before CPU-heavy work.
    """
    spark = df.sparkSession
    want = parallelism(spark)
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut lineage, that of spark.checkpoint.dir.

    Where the setting is absent a folder of our own serves a session of one machine (master
    ``local``); on a cluster, where other machines could not read it, that is an error.
    """
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    own = tempfile.mkdtemp(prefix="leafsift-")
    _OWN_DIRS.append(own)
    sc.setCheckpointDir("file://" + own)
    return sc.getCheckpointDir().rstrip("/")


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is; for narrow, staged tables."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it again.

    Cuts the lineage like checkpoint(), survives the loss of executors, and the copy is columnar,
    so later reads fetch only the columns they use. The shuffle files of the write are deleted with
    it. The table goes at the end of the ``scratch`` block it is written in, or with ``release``, or
    with the driver.
    """
    spark = df.sparkSession
    path = keep(spark, f"{shared_dir(spark)}/leafsift-{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._leafsift_path = path
    return out


def keep(spark: SparkSession, path: str) -> str:
    """``path``, to be deleted by ``release`` or with the driver."""
    p, fs = _file_system(spark, path)
    fs.deleteOnExit(p)
    _staged_paths(spark).append(path)
    return path


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _staged_paths(spark: SparkSession) -> list[str]:
    if not hasattr(spark, "_leafsift_paths"):
        spark._leafsift_paths = []
    return spark._leafsift_paths


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose staged tables are deleted at its end, but for those named to what it yields."""
    paths = _staged_paths(spark)
    start, kept = len(paths), set()

    def hold(df: DataFrame) -> DataFrame:
        kept.add(df._leafsift_path)
        return df

    yield hold
    own = paths[start:]
    paths[start:] = [p for p in own if p in kept]
    _delete(spark, [p for p in own if p not in kept])


def release(spark: SparkSession) -> None:
    """Delete the tables written by ``staged`` in this session; results that read them must be done."""
    _delete(spark, _staged_paths(spark))
    _staged_paths(spark).clear()


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``staged`` at once; what reads them must be done."""
    for df in tables:
        _delete(df.sparkSession, [df._leafsift_path])
        _staged_paths(df.sparkSession).remove(df._leafsift_path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p, fs = _file_system(spark, path)
        fs.delete(p, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_leafsift_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    tmp = tempfile.mkdtemp(prefix="leafsift-zip-")
    _OWN_DIRS.append(tmp)
    target = os.path.join(tmp, "leafsift.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for root, dirs, files in os.walk(here):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(target)
    sc._leafsift_shipped = True


@atexit.register
def _clean() -> None:
    for d in _OWN_DIRS:
        shutil.rmtree(d, ignore_errors=True)

