"""How much each term characterises a record against the whole collection.

Probabilistic relevance weighting (Okapi BM25): saturating term frequency,
document-length normalisation, and collection document frequencies counted from
the postings themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import fragment_replicate_join, mended_postings
from ..session import written

K1, B = 1.2, 0.75


def term_scores(postings: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """Score of every (card, term).

    Columns: doc_id, term, term_freq, doc_freq, doc_length, score, where
    score = ln(1 + (N - df + 0.5) / (df + 0.5)) * tf (k1 + 1) / (tf + k1 (1 - b + b len / avglen)).
    N is the number of cards that hold a term.

    Damaged rows are mended (see mended_postings), repeated (term, doc_id) rows
    count once with their greatest frequency, NULL terms and documents are left
    out; frequency 0 gives score 0. An empty index gives no rows. Ties keep
    equal scores. A term or card that holds a large part of all rows is split
    over tasks, so no task holds more than its share."""
    clean = written(
        mended_postings(postings).groupBy("doc_id", "term").agg(F.max("term_freq").alias("term_freq")),
        "postings",
    )
    doc_freq = clean.groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"))
    length = clean.groupBy("doc_id").agg(F.sum("term_freq").alias("doc_length"))
    collection = length.agg(F.count(F.lit(1)).alias("_n"), F.avg("doc_length").alias("_avg"))
    with_freq = fragment_replicate_join(clean, doc_freq, "term", "doc_id", "inner")
    full = fragment_replicate_join(with_freq, length, "doc_id", "term", "inner", loads_of=clean).crossJoin(F.broadcast(collection))
    tf, df = F.col("term_freq"), F.col("doc_freq")
    weight = F.log1p((F.col("_n") - df + 0.5) / (df + 0.5))
    relative = F.when(F.col("_avg") > 0, F.col("doc_length") / F.col("_avg")).otherwise(0.0)
    score = weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * relative))
    return full.select("doc_id", "term", "term_freq", "doc_freq", "doc_length", score.alias("score"))


def distinctive_terms(scores: DataFrame, min_freq: int = 3, max_docs: int = 5) -> DataFrame:
    """(doc_id, term) of terms frequent in their card and held by few cards."""
    return scores.where((F.col("term_freq") >= min_freq) & (F.col("doc_freq") <= max_docs)).select("doc_id", "term")
