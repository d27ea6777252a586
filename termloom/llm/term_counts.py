"""Frequency of every distinct term: occurrences, records, and marks.

Last-seen counters: the rows of a term are ordered by record, and a record is
counted where it differs from the last one seen, so no per-record set is kept.
The rows of a term are spread over sub-partitions by a hash of the record, so all
rows of one (term, record) meet in one of them. There are at least
SALTS_PER_TASK of them for each shuffle task, so even a term with a third of all rows
is spread evenly at any size; the sub-counts are then added up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS_PER_TASK = 4
MIN_SALTS = 64
RARE_MAX = 2  # occurrences of a rare term, at most
COMMON_SHARE = 0.5  # a common term occurs in more than this share of the cards


def last_seen_counts(rows: DataFrame, term: str, record: str, freq: str) -> DataFrame:
    """(term, records, occurrences) of rows (term, record, frequency).

    Repeated (term, record) rows are one record, with their greatest frequency.
    NULL terms are left out; a NULL record adds nothing."""
    salts = max(MIN_SALTS, SALTS_PER_TASK * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salt = F.pmod(F.xxhash64(F.col(record)), F.lit(salts))
    w = Window.partitionBy("_term", "_salt").orderBy("_record", F.desc("_freq"))
    last = F.lag("_record").over(w)
    seen = (
        rows.where(F.col(term).isNotNull() & F.col(record).isNotNull())
        .select(F.col(term).alias("_term"), F.col(record).alias("_record"), F.coalesce(F.col(freq), F.lit(0)).cast("bigint").alias("_freq"), salt.alias("_salt"))
        .withColumn("_new", last.isNull() | (last != F.col("_record")))
    )
    return (
        seen.where("_new")
        .groupBy("_term", "_salt").agg(F.count(F.lit(1)).alias("records"), F.sum("_freq").alias("occurrences"))
        .groupBy(F.col("_term").alias("term")).agg(F.sum("records").alias("records"), F.sum("occurrences").alias("occurrences"))
    )


def term_counts(
    postings: DataFrame, token_freq: DataFrame, vocabulary: DataFrame, rare_max: int = RARE_MAX, common_share: float = COMMON_SHARE
) -> DataFrame:
    """One row per distinct term of the collection, from any of the three tables.

    Columns: term, occurrences and records (counted from the postings, 0 where a
    term has none), run_frequency (sum over all runs of token_freq, repeated rows
    once; NULL where unknown), stated_records (sum of the vocabulary's doc_freq,
    each segment once; NULL where unknown), marks.

    marks: array with ``rare`` (run_frequency at most ``rare_max``) and ``common``
    (in more than ``common_share`` of the distinct cards), either, both or none.
    NULL terms are ignored; empty tables give no rows of their own."""
    freq = F.when(F.col("term_freq") > 0, F.col("term_freq")).otherwise(F.coalesce(F.size("positions"), F.lit(0)))
    counted = last_seen_counts(postings.select("term", "doc_id", freq.alias("freq")), "term", "doc_id", "freq")
    runs = (
        token_freq.where(F.col("token").isNotNull())
        .select("run_no", F.col("token").alias("term"), "frequency").distinct()
        .groupBy("term").agg(F.sum("frequency").cast("bigint").alias("run_frequency"))
    )
    stated = (
        vocabulary.where(F.col("term").isNotNull())
        .groupBy("segment_no", "term").agg(F.max("doc_freq").alias("df"))
        .groupBy("term").agg(F.sum("df").cast("bigint").alias("stated_records"))
    )
    cards = postings.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.lit(1).alias("_one")).agg(F.count(F.lit(1)).alias("_cards"))
    full = counted.join(runs, "term", "full").join(stated, "term", "full").crossJoin(F.broadcast(cards))
    rare = F.when(F.col("run_frequency") <= rare_max, F.lit("rare"))
    common = F.when(F.col("records") > common_share * F.col("_cards"), F.lit("common"))
    return full.select(
        "term", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), F.coalesce("records", F.lit(0)).alias("records"),
        "run_frequency", "stated_records", F.array_compact(F.array(rare, common)).alias("marks"),
    )


def marked_terms(counts: DataFrame) -> DataFrame:
    """(term, mark) for every mark of every term."""
    return counts.select("term", F.explode("marks").alias("mark"))
