"""Russian suffix stemmer as a Column expression; no UDF.

A suffix goes only if what is left reaches a mark in the word. RV is just after the
first letter of VOWELS. R1 is just after the first such letter that is not the
word's first, R2 just after the first such letter past the one that follows R1. A
mark that is not found is the word's end.

The part of the word after RV is turned round, so that an ending is a beginning: an
alternation at the start of a text takes its first fitting branch, which is the
rule's own order, where one at the end of a text would take the longest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import fragment_replicate_join
from ..session import written

# Letters that end a region.
VOWELS = "аеиопвЭЮЯё"
# Endings of the first step; the first that fits goes, not the longest.
ENDINGS = (
    "вши вшись ся сь ими ыми его ого ему ому ей ой ий ый ую юю ая яя ое ее ивш ывш ующ ющ ем нн вш щ ете ите ешь ишь ила ыла "
    "ена или ыли ило ыло ено ует ят ал ил ыл им ым ен ет ит ыт ют ны ть нно ла на ли ло но й л н иями ями ами ьми иям ням ам "
    "ом ах ях ия ья ию ью ев ов ие ье ии ьи ы ь ю а е и о у я"
).split()
# Endings of the later steps, with the region that must remain.
LATER = ((("и",), "rv"), (("ость", "ост"), "r2"), (("ейш", "ейше", "ь"), "rv"))

WORD_MAX = 2**31 - 1
MAX_BROADCAST_BYTES = 32 << 20  # of terms and stems, by a measured bound
TERM_OVERHEAD = 24  # bytes of a term besides its letters, about

_HEAD = f"(?s)^(?:[^{VOWELS}]*[{VOWELS}]|.*)"
_HEAD_R2 = f"(?s)^(?:.[^{VOWELS}]*[{VOWELS}].[^{VOWELS}]*[{VOWELS}]|.*)"


def _begins(endings: tuple[str, ...] | list[str]) -> str:
    return "^(?:" + "|".join(e[::-1] for e in endings) + ")"


def stem_ru(word: Column | str) -> Column:
    """Stem of a word; NULL stays NULL, words without a letter of VOWELS stay as they are."""
    word = F.col(word) if isinstance(word, str) else word
    head = F.regexp_extract(word, _HEAD, 0)
    rest = F.regexp_replace(F.reverse(F.substring(word, F.length(head) + 1, F.length(word))), _begins(ENDINGS), "")
    for endings, region in LATER:
        if region == "rv":
            rest = F.regexp_replace(rest, _begins(endings), "")
        else:
            kept = F.length(F.regexp_extract(word, _HEAD_R2, 0)) - F.length(head)

            def cut(r: Column) -> Column:
                out = F.when(F.lit(False), r)
                for e in endings:  # noqa: B023
                    out = out.when(F.startswith(r, F.lit(e[::-1])) & (F.length(r) - len(e) >= kept), F.substring(r, len(e) + 1, WORD_MAX))
                return out.otherwise(r)

            # bound as a lambda's variable, so that the steps before are computed once
            rest = F.element_at(F.transform(F.array(rest), cut), 1)
    return F.concat(head, F.reverse(rest))


def with_stem(df: DataFrame, word: str = "term", stem: str = "stem") -> DataFrame:
    """``df`` with the stem of a column."""
    return df.withColumn(stem, stem_ru(word))


def stem_terms(counts: DataFrame) -> DataFrame:
    """(term, stem) of the distinct terms of ``counted_terms``; a frequent word is stemmed once."""
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_stem(counts.select("term", "word").repartition(tasks, "term"), "word").drop("word")


def counted_terms(rows: DataFrame, term: str = "term") -> DataFrame:
    """(term, word, n): rows of each non-NULL term, written once. word is the term
    again, a column of its own: conditions on its stem are not pushed down to the rows
    that are joined by the term."""
    grouped = rows.where(F.col(term).isNotNull()).groupBy(F.col(term).alias("term"))
    return written(grouped.agg(F.max(F.col(term)).alias("word"), F.count(F.lit(1)).alias("n")), "terms")


def _joined(rows: DataFrame, stems: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (term, doc_id, …) with their stem; terms without one are left out. Stems
    of at most MAX_BROADCAST_BYTES are broadcast; of more, each goes to the tasks that
    hold its term, a frequent term's rows being split by document."""
    size = counts.agg(F.coalesce(F.sum(F.octet_length("term") + TERM_OVERHEAD), F.lit(0)).alias("b")).first()["b"]
    if 2 * size <= MAX_BROADCAST_BYTES:
        return rows.join(F.broadcast(stems), "term")
    return fragment_replicate_join(rows, stems, "term", "doc_id", "inner", loads_of=counts, weight="n")


def stemmed(rows: DataFrame) -> DataFrame:
    """Rows (term, doc_id, …) with the stem of their term."""
    counts = counted_terms(rows)
    return _joined(rows, stem_terms(counts), counts)


def stem_tokens(tokens: DataFrame) -> DataFrame:
    """(doc_id, pos, term) with stems for terms."""
    return stemmed(tokens.select("doc_id", "pos", "term")).select("doc_id", "pos", F.col("stem").alias("term"))


def stem_postings(postings: DataFrame) -> DataFrame:
    """(term, doc_id, term_freq, positions) by stem: a document's postings of terms
    with one stem are merged. There are fewer postings than tokens, so an index is
    better stemmed here. ``postings`` is read twice; give a written table."""
    merged = stemmed(postings.select("term", "doc_id", "positions")).groupBy(F.col("stem").alias("term"), "doc_id")
    lists = merged.agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    return lists.select("term", "doc_id", F.size("positions").alias("term_freq"), "positions")


def stem_log(tokens: DataFrame, distinct: bool = False) -> DataFrame:
    """(original, stem) of the terms that stemming changes: once per document
    and term, or once per term."""
    rows = tokens.where("term IS NOT NULL").select("doc_id", "term")
    counts = counted_terms(rows)
    changed = stem_terms(counts).where("stem <> term")
    if not distinct:
        # a document's rows of a term meet before they are shuffled
        changed = _joined(rows.distinct(), changed, counts)
    return changed.select(F.col("term").alias("original"), "stem")
