"""Queries of the problems whose operators live in this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import leakage, lookalike, markup, mixing, quality, relevance, subjects, term_counts

Query = Callable[[SparkSession, str], DataFrame]


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    scores = relevance.term_scores(table(spark, d, "postings"))
    return scores.withColumn("score", F.round("score", 6)).withColumn("doc_id", F.col("doc_id").cast("bigint"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return relevance.distinctive_terms(relevance.term_scores(table(spark, d, "postings")))


def p4_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.compare_word_counts(quality.text_quality(table(spark, d, "documents")), table(spark, d, "pages"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(quality.text_quality(table(spark, d, "documents")))


def p4_word_counts(spark: SparkSession, d: str) -> DataFrame:
    q = quality.compare_word_counts(quality.text_quality(table(spark, d, "documents")), table(spark, d, "pages"))
    return q.select("doc_id", "n_words", F.col("page_word_count").cast("bigint").alias("page_word_count"), "word_count_state")


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_documents(table(spark, d, "documents"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.markup_kinds(markup.clean_documents(table(spark, d, "documents")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_looking_pages(table(spark, d, "pages"))


def p6_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "title_tokens").where("NOT normalize_unicode")
    return lookalike.normalise(tokens, "text").select("page_id", "pos", "text", "text_normal")


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = term_counts.term_counts(table(spark, d, "postings"), table(spark, d, "token_freq"), table(spark, d, "vocabulary"))
    return counts.withColumn("marks", F.array_join("marks", ","))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.marked_terms(term_counts.term_counts(table(spark, d, "postings"), table(spark, d, "token_freq"), table(spark, d, "vocabulary")))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), min_coverage=leakage.MIN_COVERAGE)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).where(F.col("longest_run") >= leakage.MIN_RUN).select("doc_id", "item_id")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(mixing.written_sizes(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    sizes, targets = mixing.written_sizes(table(spark, d, "documents")), table(spark, d, "mix_targets")
    return mixing.mix_report(sizes, targets, mixing.mix(sizes, targets))


def p9_balance(spark: SparkSession, d: str) -> DataFrame:
    sizes, targets = mixing.written_sizes(table(spark, d, "documents")), table(spark, d, "mix_targets")
    return mixing.mix_balance(sizes, mixing.mix_report(sizes, targets, mixing.mix(sizes, targets)))


def p9_plan(spark: SparkSession, d: str) -> DataFrame:
    plan = mixing.source_plan(mixing.written_sizes(table(spark, d, "documents")), table(spark, d, "mix_targets"))
    return plan.select("source", "documents", "size", F.round("factor", 6).alias("factor"), F.round("planned_size", 3).alias("planned_size"), "outcome")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.outcomes(p9_report(spark, d))


def p10_subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_subjects(spark, d).select("doc_id", "subject")


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_composition(*subjects.classified(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects")))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            p1_scores, p1_found, p4_stats, p4_found, p4_word_counts, p5_clean, p5_found, p6_found, p6_tokens, p7_counts, p7_found,
            p8_leaks, p8_found, p9_mix, p9_report, p9_balance, p9_plan, p9_found, p10_subjects, p10_found, p10_composition,
        )
    }
