"""Cleaning of fetched articles: lines, word counts, duplicates, numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import ranked
from .text import word_count

# What ends a line, what white space is stripped, and the first
# signs of lines that are dropped.
LINE_END = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029]"
OUTER_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
DROPPED_PREFIXES = ("==", "{{", "[[File:", "[[Категория:", "[[Category:")
MIN_WORDS = 200
CATEGORY_PREFIXES = ("Category:", "Категория:")


def clean_text(extract: Column, drop_prefixes: tuple[str, ...] = DROPPED_PREFIXES) -> Column:
    """Stripped lines without blank ones and those of a dropped prefix, joined by a line feed."""
    lines = F.transform(F.split(extract, LINE_END), lambda x: F.regexp_replace(x, OUTER_SPACE, ""))

    def wanted(x: Column) -> Column:
        good = x != ""
        for p in drop_prefixes:
            good = good & ~F.startswith(x, F.lit(p))
        return good

    return F.array_join(F.filter(lines, wanted), "\n")


def clean(df: DataFrame, extract: str = "text", drop_prefixes: tuple[str, ...] = DROPPED_PREFIXES, min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` with the cleaned text, ``word_count`` and ``sha1``; rows with a NULL
    or empty extract or fewer than ``min_words`` words are left out."""
    given = df.where(F.col(extract).isNotNull() & (F.col(extract) != ""))
    # exploding an array of one keeps the condition on the word count above the
    # cleaning, which is then done once and not once for the condition too
    once = F.explode(F.array(clean_text(F.col(extract), drop_prefixes))).alias("_cleaned")
    out = given.select("*", once).withColumn(extract, F.col("_cleaned")).drop("_cleaned")
    out = out.withColumn("word_count", word_count(F.col(extract)).cast("int"))
    return out.where(F.col("word_count") >= min_words).withColumn("sha1", F.sha1(extract))


def dedupe(df: DataFrame, existing: DataFrame | None = None, by: str = "sha1", order: str = "doc_id") -> DataFrame:
    """One row per content: the one with the least ``order``; content already in
    ``existing`` is left out. A NULL content never equals another.

    Only keys are aggregated, so a content that a third of all rows share is
    combined before the shuffle; the rows are then picked by their key."""
    known = df.where(F.col(by).isNotNull())
    first = known.groupBy(by).agg(F.min(order).alias("_first"))
    if existing is not None:
        first = first.join(existing.select(by).where(F.col(by).isNotNull()).distinct(), by, "left_anti")
    kept = df.join(first.select(F.col("_first").alias(order)), order, "left_semi")
    return kept.unionByName(df.where(F.col(by).isNull())).dropDuplicates([order])


def assign_ids(df: DataFrame, order: str, start: int = 1, name: str = "new_id") -> DataFrame:
    """``df`` with consecutive numbers from ``start`` in the order of a unique column."""
    return ranked(df, [order], name, start)


def strip_category(title: Column) -> Column:
    """A category's title without its namespace."""
    for p in CATEGORY_PREFIXES:
        title = F.replace(title, F.lit(p), F.lit(""))
    return title


