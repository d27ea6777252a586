"""Writers of text and CSV forms of the engine's tables, and the binary posting lists."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stem_ru
from ..functions.text import folded, tokens_array
from ..operators.index import Index
from ..operators.skew import fragment_replicate_join
from ..operators.zipf import zipf_regression
from .files import read_token_columns
from .named import WRITTEN, file_system, put, write_named


TOKEN_FILE = "doc%05d.tokens"


def document_text(documents: DataFrame) -> DataFrame:
    """(filename, value): title, blank line, text."""
    return documents.select("filename", F.concat_ws("\n\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))).alias("value"))


def write_documents(documents: DataFrame, path: str) -> int:
    """One text file for each (filename, title, text); ``read_corpus`` reads them."""
    return write_named(document_text(documents), path)


def write_metadata(documents: DataFrame, path: str, append: bool = False) -> None:
    columns = ["doc_id", "title", "source_url", "word_count"]
    documents.select(*columns).write.mode("append" if append else "errorifexists").csv(path, header=True, quote='"', escape='"')


def token_lines(tokens: DataFrame, positions: bool = True) -> DataFrame:
    """(doc_id, value): ``term position …`` of each document and term."""
    lists = tokens.groupBy("doc_id", "term").agg(F.array_sort(F.collect_list("pos")).alias("p"))
    value = F.concat_ws(" ", F.col("term"), F.array_join(F.transform("p", lambda x: x.cast("string")), " ")) if positions else F.col("term")
    return lists.select("doc_id", "term", value.alias("value"))


def _token_files(lines: DataFrame) -> DataFrame:
    """(filename, value) of (doc_id, term, value) lines: a document's lines in the order of their terms."""
    lists = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term", "value"))).alias("l"))
    return lists.select(F.format_string(TOKEN_FILE, "doc_id").alias("filename"), F.concat(F.array_join("l.value", "\n"), F.lit("\n")).alias("value"))


def write_tokens(tokens: DataFrame, path: str, positions: bool = True) -> int:
    """A ``.tokens`` file for each document; ``read_tokens`` reads them."""
    return write_named(_token_files(token_lines(tokens, positions)), path)


TEXTS_AT_ONCE = 1000  # documents whose token lists are made at a time


def _joined_lines(docs: np.ndarray, lines: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """The documents of lines, and for each its lines joined; a document's lines follow each other."""
    first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(docs)].astype(np.int32)), lines)
    return docs[first], pc.binary_join(lists, b"\n" if lines.type == pa.binary() else "\n").cast(pa.binary()).to_pylist()


def _token_texts(docs: np.ndarray, lists: pa.Array, positions: bool) -> tuple[np.ndarray, list[bytes]]:
    """Token files of documents and their lists of tokens: the tokens become numbers in
    their order, and a stable sort by (row, number) brings each one's positions together."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
    words = lists.flatten().dictionary_encode()
    if not len(words):
        return docs[:0], []
    order_of = pc.sort_indices(words.dictionary)
    number = np.empty(len(order_of), dtype=np.int64)
    number[order_of.to_numpy(zero_copy_only=False)] = np.arange(len(order_of))
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    group = row * len(number) + number[words.indices.to_numpy(zero_copy_only=False)]
    order = np.argsort(group, kind="stable")
    group = group[order]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    lines = words.dictionary.take(order_of.take(pa.array(group[first] % len(number))))
    if positions:
        found = pa.ListArray.from_arrays(pa.array(np.r_[first, len(group)].astype(np.int32)), pa.array(at[order]).cast(pa.string()))
        lines = pc.binary_join_element_wise(lines, pc.binary_join(found, " "), " ")
    rows, texts = _joined_lines(group[first] // len(number), lines)
    return docs[rows], texts


def write_document_tokens(
    documents: DataFrame, path: str, text: str = "text", key: str = "doc_id", positions: bool = True, *, normalise: bool = True, lowercase: bool = True, keep_hyphens: bool = False
) -> int:
    """What ``write_tokens`` does for the tokens of whole documents, without a shuffle:
    a document's tokens stand in one row. ``key`` must be unique; a document without
    tokens or without a key has no file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = file_system(path)
        for b in batches:
            n = 0
            for at in range(0, b.num_rows, TEXTS_AT_ONCE):
                part = b.slice(at, TEXTS_AT_ONCE)
                docs, texts = _token_texts(part.column(0).to_numpy(zero_copy_only=False), part.column(1), positions)
                for doc, content in zip(docs.tolist(), texts):
                    put(where, f"{base}/{TOKEN_FILE % doc}", content + b"\n")
                n += len(texts)
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    target, base = file_system(path)
    target.create_dir(base, recursive=True)
    tokens = tokens_array(folded(F.col(text), normalise, lowercase), keep_hyphens)
    rows = documents.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc_id"), tokens.alias("tokens"))
    return rows.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def write_stemmed_tokens(lines: DataFrame, path: str) -> int:
    """``.tokens`` files of token lines (doc_num, token, rest) with stems for tokens.
    The lines keep their order, so a stem may stand on several of them."""
    stems = stem_ru.stemmed(lines.select(F.col("doc_num").cast("bigint").alias("doc_id"), F.col("token").alias("term"), "rest"))
    return write_named(_token_files(stems.select("doc_id", "term", F.rtrim(F.concat_ws(" ", "stem", "rest")).alias("value"))), path)


def stem_token_files(spark: SparkSession, source: str, path: str, pattern: str = "*.tokens") -> int:
    """What ``write_stemmed_tokens`` does for the token files of a folder, without a
    shuffle or join of their lines: the different tokens of the files that a task reads
    at a time are stemmed once, and the files are written where they were read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = file_system(path)
        for b in batches:
            n = 0
            for i in range(b.num_rows):
                docs, lines, stems, places, rests = (c[i].values for c in b.columns)
                stem = stems.cast(pa.binary()).take(places)
                values = pc.if_else(pc.equal(pc.binary_length(rests), 0), stem, pc.binary_join_element_wise(stem, rests, b" "))
                if not len(values):
                    continue
                rows, texts = _joined_lines(np.repeat(np.arange(len(docs)), lines.to_numpy(zero_copy_only=False)), values)
                for doc, content in zip(docs.take(pa.array(rows)).to_pylist(), texts):
                    put(where, f"{base}/{TOKEN_FILE % doc}", content + b"\n")
                n += len(texts)
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    target, base = file_system(path)
    target.create_dir(base, recursive=True)
    stems = F.transform("tokens", lambda t: stem_ru.stem_ru(t.cast("string")))
    rows = read_token_columns(spark, source, pattern).select("docs", "lines", stems.alias("stems"), "places", "rests")
    return rows.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """CSV with a header; with ``order`` the files follow each other in it."""
    (df.orderBy(*order) if order else df).write.csv(path, header=True)


def plot_lines(ranked: DataFrame, top_n: int = 1000) -> DataFrame:
    """(rank, frequency, token) of the first ranks, for plotting."""
    return ranked.where(F.col("rank") <= top_n).select("rank", "frequency", "token")


def write_plot_data(ranked: DataFrame, path: str, top_n: int = 1000) -> None:
    named = plot_lines(ranked, top_n).orderBy("rank").withColumnRenamed("rank", "# rank")
    named.coalesce(1).write.csv(path, sep="\t", header=True, quote="")


def write_plot(ranked: DataFrame, path: str, top_n: int = 1000) -> None:
    """The log-log picture as SVG: the first ranks and the line fitted to all of
    them. At most ``top_n`` points come to the driver."""
    line = zipf_regression(ranked).first()
    points = [(math.log(x["rank"]), math.log(x["frequency"])) for x in plot_lines(ranked, top_n).orderBy("rank").collect()]
    width, height, edge = 640, 480, 40
    right = max([x for x, _ in points] + [1.0])
    top = max([y for _, y in points] + [line["intercept"] or 0.0, 1.0])

    def place(x: float, y: float) -> str:
        return f"{edge + x / right * (width - 2 * edge):.1f},{height - edge - y / top * (height - 2 * edge):.1f}"

    dots = "".join('<circle cx="{}" cy="{}" r="2"/>'.format(*place(x, y).split(",")) for x, y in points)
    fitted = ""
    if line["slope"] is not None:
        a, b = line["slope"], line["intercept"]
        end = right if a >= 0 else min(right, -b / a)
        fitted = f'<polyline points="{place(0, b)} {place(end, a * end + b)}" fill="none" stroke="red"/>'
        fitted += f'<text x="{width // 2}" y="{edge // 2}">slope {a:.4f}, intercept {b:.4f}, R² {line["r_squared"]:.4f}</text>'
    axes = f'<polyline points="{place(0, top)} {place(0, 0)} {place(right, 0)}" fill="none" stroke="black"/><text x="{width // 2}" y="{height - 10}">ln rank</text><text x="2" y="{edge // 2}">ln frequency</text>'
    where, at = file_system(path)
    put(where, at, f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{axes}{fitted}{dots}</svg>'.encode())


def export_text(index: Index, path: str) -> None:
    """vocab and docids as tab-separated text, stats as JSON, and the posting lists in binary parts."""
    index.vocabulary.orderBy("term").write.csv(f"{path}/vocab.txt", sep="\t", quote="")
    index.docids.orderBy("doc_id").write.csv(f"{path}/docids.txt", sep="\t", quote="")
    index.stats.write.json(f"{path}/index_stats.json")
    write_postings(index, f"{path}/postings.bin")


def write_postings(index: Index, path: str) -> None:
    """The binary posting lists, in parts that follow each other as one file would.

    A list is 32-bit numbers: how many postings, then for each its document,
    frequency, number of positions and positions; lists follow in term order, so a
    term's begins at its ``postings_offset``. A task writes its range of (term,
    document) as it comes; a frequent term may go on in the next part."""
    target, folder = file_system(path)
    target.create_dir(folder, recursive=True)
    sums = index.postings.groupBy("term").agg(F.count(F.lit(1)).cast("int").alias("_n"), F.min("doc_id").alias("_first"))
    rows = fragment_replicate_join(index.postings.select("term", "doc_id", "term_freq", "positions"), sums, "term", "doc_id", "inner")
    # the first posting of a list has the length before it
    rows = rows.withColumn("_n", F.when(F.col("doc_id") == F.col("_first"), F.col("_n"))).drop("_first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, base = file_system(path)
        name = f"{base}/part-{TaskContext.get().partitionId():05d}.bin"
        beside = f"{name}.{uuid.uuid4().hex}.tmp"
        size = 0
        with where.open_output_stream(beside) as out:
            for b in batches:
                flat: list[int] = []
                for n, d, f, p in zip(b["_n"], b["doc_id"], b["term_freq"], b["positions"]):
                    if n == n:
                        flat.append(int(n))
                    flat += [d, f, len(p), *p]
                size += out.write(np.asarray(flat, dtype="<i4").tobytes())
        where.move(beside, name)
        yield pd.DataFrame({"filename": [name], "n_bytes": [size]})

    spread = rows.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
    spread.select("_n", "doc_id", "term_freq", "positions").mapInPandas(run, WRITTEN).agg(F.sum("n_bytes")).collect()
