"""Continuous ingestion: fetched articles in, cleaned and deduplicated documents out.

Exactly once by the checkpoint: the file source notes what it has read, the file
sink what it has committed.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.clean import MIN_WORDS, assign_ids, clean
from ..functions.text import document_name
from ..session import hadoop_path, read_small, write_small

ARTICLES = "title string, text string, source_url string, fetched_at timestamp"


def read_articles(spark: SparkSession, source: str, fmt: str = "json", max_files: int | None = None, schema: str = ARTICLES, pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(source)


def cleaned_stream(articles: DataFrame, min_words: int = MIN_WORDS, watermark: str | None = None) -> DataFrame:
    """Cleaned articles, one per content.

    Without a watermark the hashes of all contents ever seen are state; with one
    (``"7 days"`` of fetched_at) older hashes are dropped, and a copy that comes
    later than that is let through."""
    rows = clean(articles, min_words=min_words)
    if watermark is None:
        return rows.dropDuplicates(["sha1"])
    return rows.withWatermark("fetched_at", watermark).dropDuplicatesWithinWatermark(["sha1"])


def stream_ingest(
    spark: SparkSession, source: str, target: str, checkpoint: str, *, fmt: str = "json", schema: str = ARTICLES, min_words: int = MIN_WORDS,
    watermark: str | None = None, max_files: int | None = None, once: bool = True, pattern: str | None = None,
) -> StreamingQuery:
    """Starts the ingestion into Parquet at ``target``. ``once`` takes what is
    there and stops; otherwise it runs until stopped."""
    out = cleaned_stream(read_articles(spark, source, fmt, max_files, schema, pattern), min_words, watermark)
    writer = out.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_numbered(
    spark: SparkSession, source: str, target: str, checkpoint: str, *, fmt: str = "json", schema: str = ARTICLES, min_words: int = MIN_WORDS,
    max_documents: int | None = None, max_files: int | None = None, watermark: str | None = None,
) -> StreamingQuery:
    """Like ``stream_ingest``, but numbers the documents from 1 without gaps.

    Contents seen before are kept as the stream's own state, so a micro-batch does
    not read what earlier ones wrote; of equal contents that come together any one is
    taken. A batch is numbered after the last number, which stands in a small file for
    each batch, and written to a folder of its own batch number, so a repeated batch
    replaces itself. ``max_documents`` is exact."""

    def last_before(number: int) -> int:
        for n in range(number - 1, -1, -1):
            text = read_small(spark, f"{checkpoint}/numbered/{n}.json")
            if text is not None:
                return json.loads(text)["last"]
        return 0

    def take(batch: DataFrame, number: int) -> None:
        last = last_before(number)
        ordered = batch.withColumn("_order", F.concat_ws("\0", F.coalesce("title", F.lit("")), F.col("sha1")))
        numbered = assign_ids(ordered, "_order", last + 1, "doc_id").drop("_order")
        if max_documents is not None:
            numbered = numbered.where(F.col("doc_id") <= max_documents)
        named = numbered.withColumn("filename", document_name(F.col("doc_id")))
        named.write.mode("overwrite").parquet(f"{target}/batch={number}")
        taken = spark.read.schema(named.schema).parquet(f"{target}/batch={number}").count()
        fs, marker = hadoop_path(spark, f"{checkpoint}/numbered/{number}.json")
        fs.delete(marker, False)
        write_small(spark, f"{checkpoint}/numbered/{number}.json", json.dumps({"last": last + taken}))

    rows = cleaned_stream(read_articles(spark, source, fmt, max_files, schema), min_words, watermark)
    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
