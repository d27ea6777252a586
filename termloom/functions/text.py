"""Tokens of a text column, as Column expressions.

Only Unicode normalisation leaves the JVM, in Arrow batches; everything else is
built-in functions inside one projection.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters of a word, and signs that may continue one.
WORD_CLASS = r"\p{L}\p{Nd}_"
APOSTROPHES = "'’"
HYPHENS = "-‐‑‒–—―−"
ASCII_TERM_BYTES = 255


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility-composed form; NULL stays NULL."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def token_pattern(keep_hyphens: bool = False) -> str:
    tail = WORD_CLASS + APOSTROPHES + (r"\-" if keep_hyphens else "")
    return f"[{WORD_CLASS}][{tail}]*"


def folded(text: Column, normalise: bool = True, lowercase: bool = True) -> Column:
    """The text as it is cut into tokens."""
    if normalise:
        text = nfkc(text)
    return F.lower(text) if lowercase else text


def tokens_array(text: Column, keep_hyphens: bool = False) -> Column:
    """All tokens of a folded text in order."""
    return F.regexp_extract_all(text, F.lit(token_pattern(keep_hyphens)), F.lit(0))


def tokenize(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    *,
    normalise: bool = True,
    lowercase: bool = True,
    keep_hyphens: bool = False,
    keep_numbers: bool = True,
    strict_numbers: bool = False,
    stopwords: DataFrame | None = None,
) -> DataFrame:
    """(key, pos, term): one row per token; removed tokens leave gaps in pos.

    keep_numbers=False removes tokens of ASCII digits; one that ends at a hyphen
    (when hyphens split) or at the end of the text stays unless strict_numbers.
    stopwords: DataFrame (word), compared exactly after folding; it is broadcast
    only if Spark finds it small. A NULL or empty text has no tokens."""
    source = df.select(F.col(key).alias(key), folded(F.col(text), normalise, lowercase).alias("_t"))
    pattern = token_pattern(keep_hyphens)
    if keep_numbers:
        out = source.select(key, F.posexplode(F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))).alias("pos", "term"))
    else:
        both = F.lit(f"(?s)({pattern})(.?)")
        pairs = F.arrays_zip(F.regexp_extract_all("_t", both, F.lit(1)).alias("term"), F.regexp_extract_all("_t", both, F.lit(2)).alias("after"))
        out = source.select(key, F.posexplode(pairs).alias("pos", "_p")).select(key, "pos", F.col("_p.term").alias("term"), F.col("_p.after").alias("_after"))
        number = F.col("term").rlike("^[0-9]+$")
        if not strict_numbers:
            spared = [""] if keep_hyphens else ["", *HYPHENS]
            number = number & ~F.col("_after").isin(spared)
        out = out.where(~number).drop("_after")
    if stopwords is not None:
        out = out.join(stopwords.select(F.col("word").alias("term")).distinct(), "term", "left_anti").select(key, "pos", "term")
    return out


def tokenize_ascii(df: DataFrame, text: str = "text", key: str = "doc_id", max_bytes: int | None = ASCII_TERM_BYTES) -> DataFrame:
    """(key, pos, term) by the plain tokenizer: runs of ASCII letters, digits and
    ``_``, then lower case, then at most ``max_bytes``."""
    term = F.lower("_x")
    if max_bytes:
        term = F.substring(term, 1, max_bytes)
    found = F.regexp_extract_all(F.col(text), F.lit("[0-9A-Za-z_]+"), F.lit(0))
    return df.select(key, F.posexplode(found).alias("pos", "_x")).select(key, "pos", term.alias("term"))


def word_count(text: Column) -> Column:
    """Number of runs without white space."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def title_of(text: Column) -> Column:
    """First line of a document."""
    return F.substring_index(text, "\n", 1)


def document_number(name: Column) -> Column:
    """Number in a name ``doc<number>…``, -1 if there is none."""
    return F.coalesce(F.regexp_extract(name, r"^doc(-?\d{1,9})", 1).try_cast("int"), F.lit(-1))


def document_name(number: Column) -> Column:
    return F.format_string("doc%05d.txt", number)
