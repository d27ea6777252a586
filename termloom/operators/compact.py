"""Consolidating a great many tiny files into few well-sized ones.

1. a manifest of all files is frozen (written once; late files are not seen);
2. each file's record is recognised by the checksum of its content, put into one
   form; of the copies of a record the lowest file number is kept. Rows of one
   file_no with the same record are one file, the row with the lowest name, then
   the fewest bytes; with different records each record counts under that number;
3. the records are bin-packed by size, first-fit decreasing, each bin one file;
4. every bin is rewritten, and what was written is read back and held against
   the manifest by row counts and checksums;
5. only then the commit marker, one small file, is moved into place: readers go by
   the marker, so they see all of the new files or none.

Packing is done in shards of the manifest of bounded size, so no task and not the
driver holds the whole of it; each shard leaves one bin at most half full.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import exists, shared_dir, write_small, written
from .skew import fragment_replicate_join

MARKER = "_COMMITTED.json"
TARGET_BYTES = 128 << 20
SHARD_FILES = 500_000  # files packed by one task, at most about
SHARD_BINS = 16  # bins of a shard, about
LISTING = "file_no bigint, name string, n_bytes int, record_bytes bigint, digest binary"
KEPT = "file_no bigint, record_bytes bigint, checksum bigint"
BINS = "file_no bigint, record_bytes bigint, checksum bigint, shard int, bin bigint"
DATA = "file_no bigint, name string, record string, bin bigint"


class CompactionError(RuntimeError):
    """What was written differs from the manifest; nothing was committed."""


def record_text(body: Column) -> Column:
    """The record of a file: without a leading byte order mark, with one kind of
    line end, without white space at line ends and blank lines at the end. A file
    without content (NULL, empty or only such white space) has no record: NULL."""
    text = F.when(F.startswith(body, F.lit("\ufeff")), F.substring(body, 2, 2**31 - 1)).otherwise(body)
    text = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    text = F.rtrim(F.regexp_replace(text, r"(?U)[^\S\n]+(?=\n|\z)", ""), F.lit("\n"))
    return F.when(F.length(text) > 0, text)


def _digest(record: Column) -> Column:
    return F.unhex(F.sha2(F.encode(record, "UTF-8"), 256))


def _checksum(digest: Column) -> Column:
    """A number from the first 48 bits of a digest; the numbers of a bin are added up."""
    return F.conv(F.hex(F.substring(digest, 1, 6)), 16, 10).cast("bigint")


def freeze_manifest(files: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Writes and returns the listing, (file_no, name, n_bytes, record_bytes,
    digest) of every file, and the kept files, (file_no, record_bytes, checksum).

    digest is NULL for files without content; kept is the lowest file_no of those
    with the same digest. Rows with a NULL file_no are no files; extra columns are
    ignored. Rows of one file_no with the same digest are listed once."""
    spark = files.sparkSession
    listed = files.where(F.col("file_no").isNotNull()).select(
        F.col("file_no").cast("bigint").alias("file_no"), "name", F.octet_length("body").alias("n_bytes"), record_text(F.col("body")).alias("_record")
    )
    listed = listed.select(
        "file_no", "name", "n_bytes", F.octet_length("_record").cast("bigint").alias("record_bytes"), _digest(F.col("_record")).alias("digest")
    )
    listed = listed.groupBy("file_no", "digest").agg(F.min(F.struct("name", "n_bytes")).alias("_row"), F.max("record_bytes").alias("record_bytes"))
    listed.select("file_no", "_row.name", "_row.n_bytes", "record_bytes", "digest").write.parquet(f"{folder}/listing")
    listing = spark.read.schema(LISTING).parquet(f"{folder}/listing")
    first = listing.where("digest IS NOT NULL").groupBy("digest").agg(F.min("file_no").alias("file_no"), F.max("record_bytes").alias("record_bytes"))
    first.select("file_no", "record_bytes", _checksum(F.col("digest")).alias("checksum")).write.parquet(f"{folder}/kept")
    return listing, spark.read.schema(KEPT).parquet(f"{folder}/kept")


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin number of each size; a size above the capacity has a bin of its own.

    A tree over the bins' free space finds the first bin that fits in
    logarithmic time."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    free = [capacity] * (2 * leaves)
    bins = [0] * len(sizes)
    for i in order:
        need = min(sizes[i], capacity)
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < need:
                node += 1
        bins[i] = node - leaves
        free[node] -= need
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
    return bins


def shard_of(file_no: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(file_no), F.lit(shards)).cast("int")


def pack_bins(kept: DataFrame, target_bytes: int = TARGET_BYTES, shard_files: int = SHARD_FILES) -> tuple[DataFrame, int]:
    """The kept files with their shard and bin, and the number of shards."""
    total = kept.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("record_bytes"), F.lit(0)).alias("bytes")).first()
    tasks = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_tasks = min(tasks, total["bytes"] // target_bytes)  # as many as there are tasks, if each fills a bin
    shards = max(1, -(-total["files"] // shard_files), -(-total["bytes"] // (SHARD_BINS * target_bytes)), by_tasks)
    spread = kept.withColumn("shard", shard_of(F.col("file_no"), shards)).repartitionById(shards, F.col("shard"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        if frames:
            rows = pd.concat(frames, ignore_index=True).sort_values("file_no", ignore_index=True)
            bins = first_fit_decreasing(rows["record_bytes"].astype(int).tolist(), target_bytes)
            yield rows.assign(bin=rows["shard"].astype("int64") * 2**32 + bins)

    return spread.mapInPandas(run, BINS), shards


@dataclass
class Compaction:
    """A committed compaction."""

    spark: SparkSession
    folder: str

    def listing(self) -> DataFrame:
        """(file_no, name, n_bytes, record_bytes, digest) of every file of the manifest."""
        return self.spark.read.schema(LISTING).parquet(f"{self.folder}/listing")

    def placement(self) -> DataFrame:
        """(file_no, record_bytes, checksum, shard, bin) of every file that stands for its record."""
        return self.spark.read.schema(BINS).parquet(f"{self.folder}/bins")

    def records(self) -> DataFrame:
        """(file_no, name, record, bin): every record once."""
        return self.spark.read.schema(DATA).parquet(f"{self.folder}/data")

    def report(self) -> DataFrame:
        """One row per bin: bin, records, record_bytes, checksum."""
        return self.spark.read.parquet(f"{self.folder}/report")


def _checks(df: DataFrame) -> DataFrame:
    return df.groupBy("bin").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum("record_bytes").alias("record_bytes"),
        F.sum(F.col("checksum").cast("decimal(28,0)")).alias("checksum"),
    )


def compact(files: DataFrame, folder: str | None = None, target_bytes: int = TARGET_BYTES, shard_files: int = SHARD_FILES) -> Compaction:
    """Rewrites the files' records into few well-sized files and commits them.

    files: file_no, name, body. An empty table gives an empty, committed result;
    repeated rows of a file give its record once.
    Raises CompactionError, with nothing committed, if what is read back differs
    from the manifest. The bodies are shuffled once: to the shards, in which all
    files of a bin lie together."""
    spark = files.sparkSession
    folder = folder or shared_dir(spark, "compaction")
    _, kept = freeze_manifest(files, folder)
    packed, shards = pack_bins(kept, target_bytes, shard_files)
    packed.write.parquet(f"{folder}/bins")
    bins = spark.read.schema(BINS).parquet(f"{folder}/bins")
    body = files.where(F.col("file_no").isNotNull()).select(F.col("file_no").cast("bigint").alias("file_no"), "name", "body")
    body = body.withColumn("shard", shard_of(F.col("file_no"), shards)).repartitionById(shards, F.col("shard"))
    body = body.select("shard", "file_no", "name", F.octet_length("body").alias("_bytes"), record_text(F.col("body")).alias("record"))
    body = body.withColumn("checksum", _checksum(_digest(F.col("record"))))
    there = bins.select("file_no", "checksum", "shard", "bin").repartitionById(shards, F.col("shard")).hint("shuffle_hash")
    first = Window.partitionBy("shard", "file_no", "checksum").orderBy("name", "_bytes")
    placed = body.join(there, ["shard", "file_no", "checksum"]).withColumn("_nth", F.row_number().over(first)).where("_nth = 1")
    placed = placed.select("file_no", "name", "record", "bin")
    placed.sortWithinPartitions("bin", "file_no").write.partitionBy("bin").parquet(f"{folder}/data")

    data = spark.read.schema(DATA).parquet(f"{folder}/data")
    found = _checks(data.select("bin", F.octet_length("record").cast("bigint").alias("record_bytes"), _checksum(_digest(F.col("record"))).alias("checksum")))
    found.write.parquet(f"{folder}/report")
    report = spark.read.schema(found.schema).parquet(f"{folder}/report")
    planned = _checks(bins)
    same = ["bin", "records", "record_bytes", "checksum"]
    wrong = planned.join(report, same, "left_anti").count() + report.join(planned, same, "left_anti").count()
    if wrong:
        raise CompactionError(f"{wrong} bins differ from the manifest in {folder}")
    state = report.agg(F.count(F.lit(1)).alias("bins"), F.coalesce(F.sum("records"), F.lit(0)).alias("records")).first()
    _commit(spark, folder, state.asDict())
    return Compaction(spark, folder)


def _commit(spark: SparkSession, folder: str, state: dict) -> None:
    """Moves the marker into its place in one step."""
    if not write_small(spark, f"{folder}/{MARKER}", json.dumps(state)):
        raise CompactionError(f"the marker could not be moved in {folder}")


def open_compaction(spark: SparkSession, folder: str) -> Compaction:
    """A compaction by its folder; refuses one that was not committed."""
    if not exists(spark, f"{folder}/{MARKER}"):
        raise CompactionError(f"{folder} is not committed")
    return Compaction(spark, folder)


def record_groups(listing: DataFrame) -> DataFrame:
    """(file_no, representative) of every file whose record another file has as well;
    the representative is the lowest file_no with that record.

    Counts are combined before the shuffle, and a digest has one row on the other
    side of the join, so the engine's adaptive skew join splits a record that very
    many files have."""
    held = listing.where("digest IS NOT NULL").select("file_no", "digest")
    shared = held.groupBy("digest").agg(F.min("file_no").alias("representative"), F.max("file_no").alias("_last")).where("representative < _last").drop("_last")
    return held.join(shared, "digest").select("file_no", "representative")


def same_records(listing: DataFrame) -> DataFrame:
    """(file_a, file_b), file_a < file_b: all pairs of files with the same record,
    expanded from ``record_groups`` shard by shard, so no task makes all pairs of a
    large group. Records of one file take no part in the pairing; two files that
    share several records have a row for each."""
    members = written(record_groups(listing), "groups")
    a = members.select(F.col("file_no").alias("file_a"), "representative")
    b = members.select(F.col("file_no").alias("file_b"), "representative")
    return fragment_replicate_join(a, b, "representative", "file_a", "inner").where("file_a < file_b").select("file_a", "file_b")
