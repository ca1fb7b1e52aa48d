"""Session settings shared by the tests, the benchmark and the jobs."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    # One thread per Python worker; the workers already share the cores.
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("spoor")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would be lost together with the machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spoor-"))
    return context.getCheckpointDir()


_opened: ContextVar[list[str] | None] = ContextVar("opened", default=None)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and read it from there.

    For results that several jobs read: they survive lost executors, and unlike a
    cached result they carry their true size into the next plan.
    """
    path = f"{shared_dir(df.sparkSession)}/spoor-{uuid.uuid4().hex}"
    if _opened.get() is not None:
        _opened.get().append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """``stored``, and aggregates over the rows that are written, without another pass."""
    seen = Observation()
    out = stored(df.observe(seen, *[value.alias(name) for name, value in metrics.items()]))
    return out, seen.get


@contextmanager
def discard_stored(spark: SparkSession) -> Iterator[list[str]]:
    """Delete at the end what ``stored`` wrote inside, for jobs that run over and over.

    Gives the list of the folders; those taken off it stay.
    """
    token = _opened.set([])
    try:
        yield _opened.get()
    finally:
        paths = _opened.get()
        _opened.reset(token)
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Spark copies the archive to every executor, as it does for ``--py-files``.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="spoor-package-"), "spoor")
    archive = shutil.make_archive(
        base, "zip", os.path.dirname(package), os.path.basename(package)
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
