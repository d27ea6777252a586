"""Files of given names, written by the tasks that hold their content.

Spark names its output files itself; formats that are known by their file names are
written here through the Arrow file systems, each file beside its place and then
moved there, so a task that is run again replaces its own files.

They are read here too where there are many small ones: Spark's file sources count
4 MB for opening a file, so a task of theirs gets a few files, however small.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import hadoop_path

WRITTEN = "filename string, n_bytes bigint"
NAMES_AT_ONCE = 10_000  # names of a batch of a listing


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it; a path without a scheme is a local one."""
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(re.sub(r"^file:(//(?=/))?", "", path))


def put(where: fs.FileSystem, path: str, content: bytes) -> None:
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    with where.open_output_stream(beside) as out:
        out.write(content)
    where.move(beside, path)


def remove(folder: str) -> None:
    """Deletes a folder and the files in it."""
    where, base = file_system(folder)
    where.delete_dir(base)


def write_named(files: DataFrame, folder: str) -> int:
    """Writes (filename, value) rows as text files of these names and returns how
    many. A name must occur once; rows without a name are left out, a NULL value is
    an empty file. Only names and sizes come back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, base = file_system(folder)
        for b in batches:
            sizes = []
            for name, value in zip(b["filename"], b["value"]):
                content = (value or "").encode()
                put(where, f"{base}/{name}", content)
                sizes.append(len(content))
            yield pd.DataFrame({"filename": b["filename"], "n_bytes": sizes})

    target, base = file_system(folder)
    target.create_dir(base, recursive=True)
    rows = files.where(F.col("filename").isNotNull()).select("filename", F.col("value").cast("string").alias("value"))
    return rows.mapInPandas(run, WRITTEN).agg(F.count(F.lit(1)).alias("n")).first()["n"]


def _names(folder: str) -> Iterator[str]:
    """Names of the files of a folder; hidden ones are left out."""
    where, base = file_system(folder)
    if isinstance(where, fs.LocalFileSystem):  # one after another, never a list of all
        found = (e.name for e in os.scandir(base) if e.is_file())
    else:
        found = (f.base_name for f in where.get_file_info(fs.FileSelector(base)) if f.is_file)
    return (n for n in found if n[0] not in "._")


def listed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(folder, filename) of the files of a path, whose wildcards are resolved, with
    names of a pattern. One task lists them, none of the names come to the driver."""
    file, at = hadoop_path(spark, path)
    roots = [r.getPath().toString() if r.isDirectory() else (r.getPath().getParent().toString(), r.getPath().getName()) for r in file.globStatus(at) or ()]
    if not roots:
        raise FileNotFoundError(path)
    fitting = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().toString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            for root in roots:
                folder, one = (root, None) if isinstance(root, str) else root
                held: list[str] = []
                for name in _names(folder) if one is None else [one]:
                    if re.fullmatch(fitting, name, re.DOTALL):
                        held.append(name)
                    if len(held) == NAMES_AT_ONCE:
                        yield pa.RecordBatch.from_pydict({"folder": [folder] * len(held), "filename": held})
                        held = []
                yield pa.RecordBatch.from_pydict({"folder": pa.array([folder] * len(held), pa.string()), "filename": pa.array(held, pa.string())})

    return spark.range(0, 1, 1, 1).mapInArrow(run, "folder string, filename string")


def dealt(files: DataFrame, key: Column) -> DataFrame:
    """(key, folder, filename) of listed files, dealt to the tasks by their key: the
    files of one key are in one task, one after another in the order of their names."""
    spark = files.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # a number of partitions that is asked for is kept, however few bytes the names have
    return files.select(key.alias("key"), "folder", "filename").repartition(tasks, "key").sortWithinPartitions("key", "folder", "filename")


def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, bytes]]:
    """(key, filename, content) of dealt files."""
    opened: dict[str, tuple[fs.FileSystem, str]] = {}
    for b in batches:
        for key, folder, name in zip(*(c.to_pylist() for c in b.columns)):
            if folder not in opened:
                opened[folder] = file_system(folder)
            where, base = opened[folder]
            with where.open_input_file(f"{base}/{name}") as source:
                yield key, name, source.read()
