"""Session helpers: where shared files go, and how table paths are built."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SHARED_DIR = "spark.checkpoint.dir"

_shipped: set[str] = set()  # applications that have the package
_own_folders: set[str] = set()  # of applications of this process


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once for an application, so
    that it need not be installed there."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = Path(__file__).parent
    fd, path = tempfile.mkstemp(prefix=f"{package.name}-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(application)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the folder all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Only where it is
    unset on a local master, as in tests, a temporary folder is made and set; on a
    cluster a folder of one machine would not do, so that is an error. What an
    application writes lies in a folder of its own, which is deleted when it ends."""
    base = spark.conf.get(SHARED_DIR, None)
    if not base:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = made.get() if made.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"{SHARED_DIR} must name a folder that all executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="termloom-")
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set(SHARED_DIR, base)
    own = f"{base.rstrip('/')}/termloom-{spark.sparkContext.applicationId}"
    if own not in _own_folders:
        fs, path = hadoop_path(spark, own)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _own_folders.add(own)
    return f"{own}/{purpose}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """The file system of a path, and the path, of the JVM."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def written_path(df: DataFrame, purpose: str) -> str:
    """Writes the rows of ``df`` to a new table of the shared folder."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return path


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of ``df`` from a table written to the shared folder: cuts the
    lineage and outlives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(written_path(df, purpose))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a test data directory: one Parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.getFileStatus(p).isDirectory()


def read_small(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None if there is none."""
    fs, p = hadoop_path(spark, path)
    if not fs.exists(p):
        return None
    source = fs.open(p)
    try:
        return bytes(source.readNBytes(fs.getFileStatus(p).getLen())).decode()
    finally:
        source.close()


def write_small(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file beside its place and moves it there in one step; False,
    with nothing changed, if a file is there already."""
    fs, p = hadoop_path(spark, path)
    _, beside = hadoop_path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.exists(p) and fs.rename(beside, p):
        return True
    fs.delete(beside, False)
    return False


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a path."""
    fs, p = hadoop_path(spark, path)
    files = fs.listStatus(p)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)

