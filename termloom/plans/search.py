"""Boolean search over the index.

The default plan reads the postings of the query's words once and makes one flag
row per document, whatever the number of operators; the universe of documents is
joined only if the query can hold for a document with none of the words.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.index import Index
from .query import And, Node, Not, Or, Term, holds, parse_query, terms_of, to_column

FOUND = "Найдено документов: "  # fixed value: begins the line with the number of documents
NO_TITLE = "(не удалось прочитать заголовок)"  # fixed value: shown for a document whose title is unknown


def _flags(index: Index, words: list[str]) -> DataFrame:
    """(doc_id, f0, f1, …): which of the words a document holds."""
    found = index.postings.where(F.col("term").isin(words)).select("doc_id", "term")
    return found.groupBy("doc_id").agg(*[F.bool_or(F.col("term") == w).alias(f"f{i}") for i, w in enumerate(words)])


def _flag(words: list[str], universe: bool):
    def column(word: str) -> Column:
        c = F.col(f"f{words.index(word)}")
        return F.coalesce(c, F.lit(False)) if universe else c

    return column


def matching(index: Index, query: str | Node, strict: bool = False, fold: str = "ascii") -> DataFrame:
    """(doc_id) of the documents for which the query holds, unordered."""
    tree = parse_query(query, strict, fold) if isinstance(query, str) else query
    words = terms_of(tree)
    everywhere = holds(tree, set())
    if not words:
        return index.docids.select("doc_id").where(F.lit(everywhere))
    flags = _flags(index, words)
    if everywhere:
        flags = index.docids.select("doc_id").join(flags, "doc_id", "left")
    return flags.where(to_column(tree, _flag(words, everywhere))).select("doc_id")


def matching_by_sets(index: Index, tree: Node | None) -> DataFrame:
    """The same by set operations, node by node: semi-join, union, anti-join."""
    docs = index.docids.select("doc_id")
    match tree:
        case None:
            return docs.where(F.lit(False))
        case Term(word):
            return index.postings.where(F.col("term") == word).select("doc_id").distinct()
        case Not(part):
            return docs.join(matching_by_sets(index, part), "doc_id", "left_anti")
        case And(a, b):
            return matching_by_sets(index, a).join(matching_by_sets(index, b), "doc_id", "left_semi")
        case Or(a, b):
            return matching_by_sets(index, a).union(matching_by_sets(index, b)).distinct()


def search(index: Index, query: str | Node, titles: DataFrame | None = None, strict: bool = False, fold: str = "ascii") -> DataFrame:
    """(doc_id, filename, title) of the matching documents, ascending.

    titles: DataFrame (doc_id, title) in the index's own numbers, or (filename,
    title); a document without one shows NO_TITLE. Without titles the column is NULL."""
    hits = matching(index, query, strict, fold).join(index.docids, "doc_id", "left")
    if titles is None:
        return hits.select("doc_id", "filename", F.lit(None).cast("string").alias("title")).orderBy("doc_id")
    key = "doc_id" if "doc_id" in titles.columns else "filename"
    named = hits.join(titles.select(key, "title"), key, "left")
    return named.select("doc_id", "filename", F.coalesce("title", F.lit(NO_TITLE)).alias("title")).orderBy("doc_id")


def search_many(index: Index, queries: dict[str, str], strict: bool = False, fold: str = "ascii") -> DataFrame:
    """(query_id, doc_id) for several queries in one scan of the postings: one flag
    row per document, one boolean column per query, then unpivoted."""
    trees = {q: parse_query(text, strict, fold) for q, text in queries.items()}
    words = list(dict.fromkeys(w for t in trees.values() for w in terms_of(t)))
    everywhere = any(holds(t, set()) for t in trees.values())
    if words:
        flags = _flags(index, words)
        base = index.docids.select("doc_id").join(flags, "doc_id", "left") if everywhere else flags
    else:
        base = index.docids.select("doc_id")
    flag = _flag(words, everywhere)
    hit = F.array_compact(F.array(*[F.when(to_column(t, flag), F.lit(q)) for q, t in trees.items()]))
    return base.select(F.explode(hit).alias("query_id"), "doc_id")


def result_lines(found: DataFrame) -> DataFrame:
    """(n, line): what is printed for the rows of ``search``: the number of documents,
    a blank line, then document, file name and title of each, set apart by tabs."""
    from ..operators.ordering import ranked

    rows = ranked(found, ["doc_id"], "_n", 2)
    lines = rows.select(F.col("_n").alias("n"), F.concat_ws("\t", F.col("doc_id").cast("string"), F.coalesce("filename", F.lit("")), F.coalesce("title", F.lit(""))).alias("line"))
    head = found.agg(F.concat(F.lit(FOUND), F.count(F.lit(1)).cast("string"), F.lit("\n")).alias("h")).select(F.posexplode(F.split("h", "\n")).alias("n", "line"))
    return head.select(F.col("n").cast("bigint").alias("n"), "line").unionByName(lines)
