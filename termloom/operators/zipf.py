"""Rank and frequency of tokens, and the log-log regression over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import ranked


def term_frequency(tokens: DataFrame) -> DataFrame:
    """(token, frequency) over all positions, the first included."""
    return tokens.where(F.col("term").isNotNull()).groupBy(F.col("term").alias("token")).agg(F.count(F.lit(1)).alias("frequency"))


def frequency_of_lists(token_lists: DataFrame) -> DataFrame:
    """(token, frequency) of (token, positions) rows; rows without positions are skipped."""
    sized = token_lists.where(F.size("positions") > 0)
    return sized.groupBy("token").agg(F.sum(F.size("positions")).cast("bigint").alias("frequency"))


def zipf_rank(frequencies: DataFrame) -> DataFrame:
    """(rank, token, frequency): unique ranks from 1, ties by token ascending.
    The numbers are given partition by partition, not by a single task."""
    return ranked(frequencies, [F.desc("frequency"), F.asc("token")], "rank").select("rank", "token", "frequency")


def top_ranks(rank: DataFrame, n: int = 1000) -> DataFrame:
    return rank.where(F.col("rank") <= n)


def zipf_regression(rank: DataFrame, top_n: int | None = None) -> DataFrame:
    """One row (slope, intercept, r_squared) of ln(frequency) on ln(rank), over the
    first ``top_n`` ranks, or all if it is 0, None or more than there are. Fewer
    than two ranks give NULL; equal frequencies give r_squared 1."""
    rows = rank if not top_n else top_ranks(rank, top_n)
    x, y = F.log("rank"), F.log("frequency")
    return rows.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r_squared"))


def zipf_fit(rank: DataFrame, regression: DataFrame | None = None) -> DataFrame:
    """(rank, token, frequency, log_rank, log_frequency, fitted) with the fitted line."""
    line = zipf_regression(rank) if regression is None else regression
    logs = rank.withColumn("log_rank", F.log("rank")).withColumn("log_frequency", F.log("frequency"))
    return logs.crossJoin(F.broadcast(line.select("slope", "intercept"))).select(
        "rank", "token", "frequency", "log_rank", "log_frequency", (F.col("slope") * F.col("log_rank") + F.col("intercept")).alias("fitted")
    )
