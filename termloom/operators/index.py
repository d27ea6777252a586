"""The inverted index: build, save, load, export, verify."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import document_name, folded, tokens_array
from ..session import shared_dir, written
from .ordering import ranked, running_total

TABLES = ("postings", "vocabulary", "docids", "stats")
SAMPLE_DOCUMENTS = 2000  # about; they only say where the files of the postings are cut
POSTINGS = "term string, doc_id bigint, term_freq int, positions array<int>"


@dataclass
class Index:
    """postings (term, doc_id, term_freq, positions), vocabulary (term, term_id,
    doc_freq, postings_offset), docids (doc_id, filename), stats (one row)."""

    postings: DataFrame
    vocabulary: DataFrame
    docids: DataFrame
    stats: DataFrame

    def save(self, path: str) -> None:
        """Parquet tables; postings are clustered by term, with a bloom filter on
        it, so that a lookup touches few row groups."""
        spread = self.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
        spread.write.option("parquet.bloom.filter.enabled#term", "true").parquet(f"{path}/postings")
        _save_small(path, self.vocabulary, self.docids, self.stats)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{t}") for t in TABLES))


def _save_small(path: str, vocabulary: DataFrame, docids: DataFrame, stats: DataFrame) -> None:
    vocabulary.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/vocabulary")
    docids.write.parquet(f"{path}/docids")
    stats.write.parquet(f"{path}/stats")


@dataclass
class Layout:
    """Where the postings of each term go: ranges of terms of about equal load; a
    term above a range's load has several, one after another by document."""

    terms: list[str]  # first term of each range, ascending
    first: list[int]  # its first partition
    split: list[int]  # partitions of the range; more than 1 only for one frequent term
    n_partitions: int
    n_documents: int

    def partitions(self, terms: list[str], which: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Partition of each posting; ``which`` says which of the terms it has."""
        at = np.array([max(bisect_right(self.terms, t) - 1, 0) for t in terms], dtype=np.int64)
        if not len(at):
            return np.zeros(0, np.int32)
        first, split = np.array(self.first)[at], np.array(self.split)[at]
        k = split[which]
        return (first[which] + docs * k // max(self.n_documents, 1)).clip(0, self.n_partitions - 1).astype(np.int32)


def plan_layout(loads: list[tuple[str, int]], n_partitions: int, n_documents: int) -> Layout:
    """Cuts (term, postings) of a sample into at most 2 ``n_partitions`` ranges.
    An empty sample gives one partition."""
    target = max(1.0, sum(n for _, n in loads) / max(1, n_partitions))
    terms, first, split = [""], [0], [1]
    held, used = 0.0, 1
    for term, n in sorted(loads):
        several = int(n // target)
        if several > 1 or held + n > target and held:
            terms.append(term)
            first.append(used)
            split.append(max(1, several))
            used += max(1, several)
            held = 0.0 if several <= 1 else target  # after a split term a new range begins
        held += n
    return Layout(terms, first, split, used, n_documents)


def document_numbers(documents: DataFrame, order: str = "doc_num") -> DataFrame:
    """(order, doc_id, filename): dense numbers from 0 in ascending order."""
    numbered = ranked(documents.select(order), [order], "doc_id", 0)
    return numbered.select(order, F.col("doc_id").cast("bigint").alias("doc_id"), document_name(F.col(order)).alias("filename"))


def build_postings(tokens: DataFrame, drop_position_zero: bool = True) -> DataFrame:
    """(term, doc_id, term_freq, positions) of (doc_id, pos, term); positions ascend.

    One shuffle, on (term, doc_id): a document's tokens are combined before it,
    and no list is ever longer than one document."""
    kept = tokens.where(F.col("term").isNotNull())
    if drop_position_zero:
        kept = kept.where("pos > 0")
    grouped = kept.groupBy("term", "doc_id").agg(F.array_sort(F.collect_list(F.col("pos").cast("int"))).alias("positions"))
    return grouped.select("term", "doc_id", F.size("positions").alias("term_freq"), "positions")


def _grouped(batches: Iterator[pa.RecordBatch], drop_position_zero: bool, layout: Layout | None = None) -> Iterator[pa.RecordBatch]:
    """Postings of batches (key, tokens): the batch's words become numbers, and a
    stable sort by (row, number) brings each word's ascending positions together.
    With a layout each posting has its partition beside it."""
    for b in batches:
        lists = b.column(1)
        lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
        words = lists.flatten().dictionary_encode()
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        if drop_position_zero:
            kept = at > 0
            code, row, at = code[kept], row[kept], at[kept]
        group = row * max(len(words.dictionary), 1) + code
        order = np.argsort(group, kind="stable")
        group = group[order]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
        offsets = np.r_[first, len(group)].astype(np.int32)
        which, docs = code[order][first], b.column(0).take(pa.array(row[order][first]))
        columns = [
            words.dictionary.take(pa.array(which)),
            docs,
            pa.array(np.diff(offsets).astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(at[order].astype(np.int32))),
        ]
        names = ["term", "doc_id", "term_freq", "positions"]
        if layout is not None:
            columns.append(pa.array(layout.partitions(words.dictionary.to_pylist(), which, docs.to_numpy(zero_copy_only=False))))
            names.append("_part")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def document_postings(
    documents: DataFrame, text: str = "text", key: str = "doc_id", drop_position_zero: bool = True, *, normalise: bool = True, lowercase: bool = True, keep_hyphens: bool = False
) -> DataFrame:
    """What ``build_postings`` gives for the tokens of whole documents, without a
    shuffle: all occurrences of a (term, document) stand in one row, so they are
    grouped where they are, by vectorised Arrow batches. ``key`` must be unique; a
    NULL or empty text has no postings."""
    cut = _cut(documents, text, key, normalise=normalise, lowercase=lowercase, keep_hyphens=keep_hyphens)
    return cut.mapInArrow(lambda batches: _grouped(batches, drop_position_zero), POSTINGS)


def _cut(documents: DataFrame, text: str, key: str, *, normalise: bool = True, lowercase: bool = True, keep_hyphens: bool = False) -> DataFrame:
    tokens = tokens_array(folded(F.col(text), normalise, lowercase), keep_hyphens)
    return documents.select(F.col(key).cast("bigint").alias("doc_id"), tokens.alias("tokens"))


def term_sums(postings: DataFrame) -> DataFrame:
    """(term, _first document, doc_freq, _positions); term_freq is the number of
    positions, which are not read."""
    return postings.groupBy("term").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("doc_freq"), F.sum("term_freq").alias("_positions"))


def build_vocabulary(postings: DataFrame) -> DataFrame:
    """(term, term_id, doc_freq, postings_offset).

    term_id numbers the terms by their first document and then by term, from 0;
    the offset is the byte place of the term's list in term order, a list taking
    4 bytes and each posting 12 and 4 for each position."""
    return vocabulary_of(term_sums(postings))


def vocabulary_of(sums: DataFrame) -> DataFrame:
    sized = sums.select("term", "_first", "doc_freq", (4 + 12 * F.col("doc_freq") + 4 * F.col("_positions")).alias("_bytes"))
    placed = running_total(ranked(sized, ["_first", "term"], "term_id", 0), ["term"], "_bytes", "postings_offset")
    return placed.select("term", "term_id", "doc_freq", "postings_offset")


def index_stats(postings: DataFrame, docids: DataFrame) -> DataFrame:
    """One row: num_documents (empty ones too), num_terms, total_postings, total_positions."""
    return stats_of(term_sums(postings), docids)


def stats_of(sums: DataFrame, docids: DataFrame) -> DataFrame:
    totals = sums.agg(
        F.count(F.lit(1)).alias("num_terms"),
        F.coalesce(F.sum("doc_freq"), F.lit(0)).alias("total_postings"),
        F.coalesce(F.sum("_positions"), F.lit(0)).alias("total_positions"),
    )
    return docids.agg(F.count(F.lit(1)).alias("num_documents")).crossJoin(totals)


def build_index(tokens: DataFrame, docids: DataFrame, drop_position_zero: bool = True) -> Index:
    """Index of (doc_id, pos, term) rows over the documents (doc_id, filename).

    Tokens of documents that are not in ``docids`` are indexed too; ``verify_index``
    reports them."""
    return index_of(build_postings(tokens, drop_position_zero), docids)


def build_document_index(documents: DataFrame, drop_position_zero: bool = True, path: str | None = None, **options) -> Index:
    """Index of (doc_num, text) rows, saved at ``path`` (or in the shared folder)
    and loaded; the index's own dense numbers replace doc_num. Rows with a NULL
    doc_num are left out.

    Documents are numbered first, and each posting goes once, straight to the file
    that holds its range of terms; where the ranges are cut is taken from a sample
    of documents and has no bearing on the rows."""
    spark = documents.sparkSession
    path = path or shared_dir(spark, "index")
    documents = documents.where(F.col("doc_num").isNotNull()).select("doc_num", "text")
    numbered, docids, n = _numbered(documents)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = _cut(numbered.sample(min(1.0, SAMPLE_DOCUMENTS / max(n, 1)), seed=7), "text", "doc_id", **options)
    loads = sample.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()
    layout = plan_layout([(r["term"], r["n"]) for r in loads], partitions, n)
    shared = spark.sparkContext.broadcast(layout)
    found = _cut(numbered, "text", "doc_id", **options).mapInArrow(lambda b: _grouped(b, drop_position_zero, shared.value), f"{POSTINGS}, _part int")
    spread = found.repartitionById(layout.n_partitions, F.col("_part")).drop("_part").sortWithinPartitions("term", "doc_id")
    spread.write.option("parquet.bloom.filter.enabled#term", "true").parquet(f"{path}/postings")
    sums = written(term_sums(spark.read.schema(POSTINGS).parquet(f"{path}/postings")), "sums")
    _save_small(path, vocabulary_of(sums), docids, stats_of(sums, docids))
    return Index.load(spark, path)


def _numbered(documents: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, text), (doc_id, filename) and the number of documents. Numbers that
    follow each other already are shifted; others are ranked and joined to the
    documents, before there are any postings."""
    if documents.schema["doc_num"].dataType.typeName() in ("byte", "short", "integer", "long"):
        e = documents.agg(F.count("doc_num").alias("n"), F.count_distinct("doc_num").alias("u"), F.min("doc_num").alias("lo"), F.max("doc_num").alias("hi")).first()
        if e["n"] == 0 or e["n"] == e["u"] == e["hi"] - e["lo"] + 1:
            dense = (F.col("doc_num").cast("bigint") - F.lit(e["lo"] or 0)).alias("doc_id")
            return documents.select(dense, "text"), documents.select(dense, document_name(F.col("doc_num")).alias("filename")), e["n"]
    numbers = written(document_numbers(documents.select("doc_num")), "docids")
    return documents.join(numbers, "doc_num").select("doc_id", "text"), numbers.select("doc_id", "filename"), numbers.count()


def index_of(postings: DataFrame, docids: DataFrame) -> Index:
    """The index of these postings. They are written to the shared folder once, as
    the vocabulary and the statistics are taken from them."""
    kept = written(postings, "postings")
    sums = written(term_sums(kept), "sums")
    return Index(kept, vocabulary_of(sums), docids, stats_of(sums, docids))


def lookup(index: Index, term: str) -> DataFrame:
    """(doc_id, term_freq, positions) of one term, ascending."""
    return index.postings.where(F.col("term") == term).select("doc_id", "term_freq", "positions").orderBy("doc_id")


def verify_index(index: Index) -> DataFrame:
    """(rule, subject) of every violation; no rows for a sound index.

    Rules: doc_freq, term_freq, positions_ascend, document_known, documents_dense,
    term_known, offset, stats."""
    p, v, d = index.postings, index.vocabulary, index.docids
    counted = p.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum(F.lit(12) + 4 * F.size("positions")).alias("b"))
    both = v.join(counted, "term", "full")

    def broken(rule: str, df: DataFrame, subject) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), F.coalesce(subject.cast("string"), F.lit("")).alias("subject"))

    place = F.concat_ws("/", F.col("term"), F.col("doc_id").cast("string"))
    ascending = F.coalesce(F.forall(F.zip_with(F.slice("positions", 2, F.greatest(F.size("positions") - 1, F.lit(0))), F.slice("positions", 1, F.greatest(F.size("positions") - 1, F.lit(0))), lambda b, a: b > a), lambda x: x), F.lit(True))
    extent = d.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.countDistinct("doc_id").alias("u"))
    offsets = running_total(both.where("n IS NOT NULL").select("term", "postings_offset", (F.col("b") + 4).alias("b")), ["term"], "b", "want")
    found = index_stats(p.withColumn("term_freq", F.size("positions")), d)
    stats = index.stats.select(*[F.col(c).cast("bigint") for c in found.columns])
    return (
        broken("doc_freq", both.where("n IS NOT NULL AND doc_freq IS NOT NULL AND n <> doc_freq"), F.col("term"))
        .union(broken("term_known", both.where("n IS NULL OR doc_freq IS NULL"), F.col("term")))
        .union(broken("term_freq", p.where(F.col("term_freq") != F.size("positions")), place))
        .union(broken("positions_ascend", p.where(~ascending), place))
        .union(broken("document_known", p.join(d, "doc_id", "left_anti"), place))
        .union(broken("documents_dense", extent.where("n > 0 AND (lo <> 0 OR hi <> n - 1 OR u <> n)"), F.col("hi")))
        .union(broken("offset", offsets.where("want <> postings_offset"), F.col("term")))
        .union(broken("stats", stats.exceptAll(found), F.to_json(F.struct(*found.columns))))
    )


def posting_bytes(postings: DataFrame) -> DataFrame:
    """(term, bytes) of each term's list."""
    return postings.groupBy("term").agg((F.lit(4) + F.sum(F.lit(12) + 4 * F.size("positions"))).alias("bytes"))


def probe_terms(index: Index, terms: list[str] | None = None, n_terms: int = 10, n_postings: int = 3) -> DataFrame:
    """A look into the index: (term, doc_freq, nth, doc_id, term_freq, n_positions) of
    the first postings of some terms, by default the first terms. A term that is not
    known has doc_freq 0 and no posting."""
    spark = index.vocabulary.sparkSession
    if terms is None:
        terms = [r["term"] for r in index.vocabulary.orderBy("term").limit(n_terms).collect()]
    asked = spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string")
    held = index.postings.where(F.col("term").isin(terms)).select("term", "doc_id", "term_freq", F.size("positions").alias("n_positions"))
    # rank limits are pushed below the shuffle, so a frequent term sends a few rows of each task
    nth = Window.partitionBy("term").orderBy("doc_id")
    numbered = held.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= n_postings)
    counts = held.groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"))
    known = asked.join(F.broadcast(counts), "term", "left").withColumn("doc_freq", F.coalesce("doc_freq", F.lit(0)).cast("bigint"))
    return known.join(numbered, "term", "left").select("term", "doc_freq", "nth", "doc_id", "term_freq", "n_positions")
