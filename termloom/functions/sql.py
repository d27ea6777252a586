"""The engine's functions for SQL: tokenize, word_count_of, clean_text, stem_ru, boolean_match."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.query import holds, parse_query
from .clean import DROPPED_PREFIXES, LINE_END, OUTER_SPACE
from .stem_ru import ENDINGS, LATER, VOWELS
from .text import nfkc, token_pattern


WORDS = r"(?U)\S+"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _define(spark: SparkSession, signature: str, returns: str, body: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {returns} RETURN {body}")


def _strip(word: str, endings, mark: str) -> str:
    listed = ", ".join(map(_quoted, endings))
    fits = f"filter(array({listed}), s -> endswith(w, s) AND length(w) - length(s) >= {mark})"
    return f"element_at(transform(array({word}), w -> left(w, length(w) - coalesce(length(try_element_at({fits}, 1)), 0))), 1)"


def _stem_body() -> str:
    def mark(pattern: str) -> str:
        return f"coalesce(nullif(length(regexp_extract(word, {_quoted(pattern)}, 0)), 0), length(word))"

    marks = {"rv": mark(f"^[^{VOWELS}]*[{VOWELS}]"), "r2": mark(f"(?s)^.[^{VOWELS}]*[{VOWELS}].[^{VOWELS}]*[{VOWELS}]")}
    body = _strip("word", ENDINGS, marks["rv"])
    for endings, region in LATER:
        body = _strip(body, endings, marks[region])
    return body


@F.pandas_udf(T.BooleanType())
def boolean_match(terms: pd.Series, query: pd.Series) -> pd.Series:
    """Whether a query holds for a document's terms. NULL terms are no terms; a
    NULL query, or one that can't be parsed, gives NULL."""
    trees: dict[str, object] = {}
    out = []
    for words, q in zip(terms, query):
        if q is not None and q not in trees:
            try:
                trees[q] = parse_query(q)
            except ValueError:
                trees[q] = None
        tree = trees.get(q)
        out.append(None if tree is None else holds(tree, set(words) if words is not None else set()))
    return pd.Series(out, dtype=object)


def register_functions(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    spark.udf.register("nfkc", nfkc)
    spark.udf.register("boolean_match", boolean_match)
    _define(spark, "tokenize(txt STRING)", "ARRAY<STRING>", f"regexp_extract_all(lower(nfkc(txt)), {_quoted(token_pattern())}, 0)")
    _define(spark, "word_count_of(txt STRING)", "INT", f"regexp_count(txt, {_quoted(WORDS)})")
    wanted = " AND ".join(["x <> ''", *(f"NOT startswith(x, {_quoted(p)})" for p in DROPPED_PREFIXES)])
    lines = f"transform(split(txt, {_quoted(LINE_END)}), x -> regexp_replace(x, {_quoted(OUTER_SPACE)}, ''))"
    _define(spark, "clean_text(txt STRING)", "STRING", f"array_join(filter({lines}, x -> {wanted}), '\\n')")
    _define(spark, "stem_ru(word STRING)", "STRING", _stem_body())
