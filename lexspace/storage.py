"""Session helpers: reading tables and writing intermediate tables to the shared folder."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session's executors; once for each session."""
    context = spark.sparkContext
    if getattr(context, "_lexspace_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="lexspace-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/lexspace_package.zip", "w") as z:
        for at, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    z.write(full, os.path.join("lexspace", os.path.relpath(full, root)))
    context.addPyFile(f"{folder}/lexspace_package.zip")
    context._lexspace_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the data folder."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    Only a session in one process (local tests) may have none: a temporary folder is set and used. On a cluster that is a RuntimeError.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lexspace-")
        spark.conf.set(CHECKPOINT_CONF, path)
        spark.sparkContext.setCheckpointDir(path)
        atexit.register(shutil.rmtree, path.removeprefix("file://"), ignore_errors=True)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/lexspace/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, **options) -> DataFrame:
    """Write `df` to the shared folder and read it again: later uses neither recompute it nor depend on one executor. options: of the writer."""
    spark = df.sparkSession
    path = new_path(spark, label)
    if _scopes:
        _scopes[-1].append(path)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_scopes: list[list[str]] = []


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all intermediate tables that were written within; results that are still lazy must be used before."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def file_system(spark: SparkSession, path: str):
    """(Hadoop path, its file system): any storage that Spark reads."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    own, fs = file_system(spark, path)
    return fs.exists(own)


def delete(spark: SparkSession, path: str) -> None:
    own, fs = file_system(spark, path)
    fs.delete(own, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one small file."""
    own, fs = file_system(spark, path)
    out = fs.create(own, True)
    out.write(bytearray(text.encode()))
    out.close()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete the files of a table that materialise() wrote and that is no longer needed."""
    spark = df.sparkSession
    root = shared_dir(spark) + "/lexspace/"
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/lexspace/" in parent:
            delete(spark, root + parent.rpartition("/lexspace/")[2])
