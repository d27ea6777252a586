"""Readers of corpora, token files, word lists, metadata and index files."""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import document_number, title_of
from ..session import empty, exists
from .named import contents, dealt, file_system, listed

log = logging.getLogger("termloom.sources")


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("filename", F.col("_metadata.file_name"))


def read_corpus(spark: SparkSession, path: str, pattern: str = "doc*.txt") -> DataFrame:
    """(doc_num, filename, title, text) of a folder of text files, one document a
    file. title is the first line; doc_num is -1 where the name has no number. Files of no
    bytes are not read."""
    files = _named(spark.read.text(path, wholetext=True, pathGlobFilter=pattern))
    return files.select(
        document_number(F.col("filename")).alias("doc_num"), "filename", title_of(F.col("value")).alias("title"), F.col("value").alias("text")
    )


CHUNK_BYTES = 16 << 20  # of token files that are cut into lines at a time, about
CHUNK_FILES = 5000
_ODD = (b"\t", b"\r", b"  ", b" \n", b"\n ", b"\xef\xbb\xbf")


def token_chunks(read: Iterator[tuple[int, str, bytes]]) -> Iterator[tuple[list[int], list[str], list[bytes]]]:
    """Token files in chunks (doc_nums, names, contents); those of one document are together."""
    docs: list[int] = []
    names: list[str] = []
    texts: list[bytes] = []
    size = 0
    for doc, name, content in read:
        if docs and docs[-1] != doc and (size > CHUNK_BYTES or len(docs) >= CHUNK_FILES):
            yield docs, names, texts
            docs, names, texts, size = [], [], [], 0
        docs.append(doc)
        names.append(name)
        texts.append(content)
        size += len(content)
    if docs:
        yield docs, names, texts


def cut_lines(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(which text, token, rest) of the lines of token files; blank lines are skipped.

    Arrow cuts texts whose lines have single spaces only; others are cut one by one."""
    whole = b"\n".join(texts)
    if any(sign in whole for sign in _ODD) or whole[:1] == b" " or whole[-1:] == b" ":
        which, tokens, rests = [], [], []
        for i, text in enumerate(texts):
            for line in re.split(rb"\r\n|\r|\n", text.removeprefix(b"\xef\xbb\xbf")):
                line = line.strip(b" ")
                if line:
                    fields = re.split(rb"[ \t]+", line, maxsplit=1)
                    which.append(i)
                    tokens.append(fields[0])
                    rests.append(fields[1] if len(fields) > 1 else b"")
        return np.array(which, dtype=np.int64), pa.array(tokens, pa.binary()), pa.array(rests, pa.binary())
    lists = pc.split_pattern(pa.array(texts, pa.binary()), "\n")
    lines = lists.flatten()
    which = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    kept = pc.greater(pc.binary_length(lines), 0)
    fields = pc.split_pattern(lines.filter(kept), " ", max_splits=1)
    several = pc.list_value_length(fields).to_numpy(zero_copy_only=False)
    first = np.cumsum(several) - several
    values = fields.flatten()
    rests = values.take(pa.array(first + 1, mask=several < 2)).fill_null(b"")
    return which[kept.to_numpy(zero_copy_only=False)], values.take(pa.array(first)), rests


def _position(field: bytes) -> int:
    found = re.match(rb"[+-]?\d{1,9}", field)
    return int(found[0]) if found else 0


def cut_positions(rests: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(how many, positions) of the rests of token lines, which are not empty. Arrow
    reads plain numbers of up to 9 signs; where there is anything else each is read by itself."""
    fields = pc.split_pattern(rests, " ")
    flat = fields.flatten()
    try:
        if not (pc.max(pc.binary_length(flat)).as_py() or 0) > 9 and not pc.any(pc.match_substring_regex(flat, "[^0-9-]")).as_py():
            positions = flat.cast(pa.string()).cast(pa.int32()).to_numpy(zero_copy_only=False)
            return pc.list_value_length(fields).to_numpy(zero_copy_only=False).astype(np.int64), positions
    except pa.ArrowInvalid:
        pass
    lists = [[_position(x) for x in re.split(rb"[ \t]+", rest)] for rest in rests.to_pylist()]
    return np.array([len(p) for p in lists], dtype=np.int64), np.array([x for p in lists for x in p], dtype=np.int32)


def _lists(lengths: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(values.astype(np.int32)))


def _token_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Token files, dealt by their document."""
    return dealt(listed(spark, path, pattern), document_number(F.col("filename")))


def _batch(**columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def read_token_lines(spark: SparkSession, path: str, pattern: str = "*.tokens") -> DataFrame:
    """(filename, doc_num, token, rest) of token files, ``rest`` as it stands; blank lines are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, names, texts in token_chunks(contents(batches)):
            which, tokens, rests = cut_lines(texts)
            at = pa.array(which)
            yield _batch(filename=pa.array(names).take(at), doc_num=pa.array(docs, pa.int32()).take(at), token=tokens, rest=rests)

    # bytes become strings as they are
    found = _token_files(spark, path, pattern).mapInArrow(run, "filename string, doc_num int, token binary, rest binary")
    return found.select("filename", "doc_num", F.col("token").cast("string").alias("token"), F.col("rest").cast("string").alias("rest"))


def read_tokens(spark: SparkSession, path: str, pattern: str = "doc*.tokens", positive: bool = True) -> DataFrame:
    """(doc_num, token, positions) of token files ``token position position …``.

    A position is the number a field begins with, 0 if there is none. With
    ``positive`` only positions above 0 are kept. Lines without positions are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, _, texts in token_chunks(contents(batches)):
            which, tokens, lengths, positions = _positioned(texts, positive)
            yield _batch(doc_num=pa.array(docs, pa.int32()).take(pa.array(which)), token=tokens, positions=_lists(lengths, positions))

    found = _token_files(spark, path, pattern).mapInArrow(run, "doc_num int, token binary, positions array<int>")
    return found.select("doc_num", F.col("token").cast("string").alias("token"), "positions")


def _positioned(texts: list[bytes], positive: bool) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(which text, token, how many positions) of the lines with positions, and all the positions."""
    which, tokens, rests = cut_lines(texts)
    kept = pc.greater(pc.binary_length(rests), 0)
    which, tokens = which[kept.to_numpy(zero_copy_only=False)], tokens.filter(kept)
    lengths, positions = cut_positions(rests.filter(kept))
    if positive:
        above = positions > 0
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[above], minlength=len(lengths))
        some = lengths > 0
        which, tokens, lengths, positions = which[some], tokens.filter(pa.array(some)), lengths[some], positions[above]
    return which, tokens, lengths, positions


def read_token_postings(spark: SparkSession, path: str, pattern: str = "doc*.tokens") -> DataFrame:
    """(term, doc_id, term_freq, positions): what ``build_postings`` gives for the
    lists of ``read_tokens``, without a shuffle of them. One task reads the files of a
    document, so its repeated lines of a token are merged where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, _, texts in token_chunks(contents(batches)):
            which, tokens, lengths, positions = _positioned(texts, True)
            words = tokens.dictionary_encode()
            numbers, row = np.unique(np.array(docs, dtype=np.int64), return_inverse=True)
            several = max(len(words.dictionary), 1)
            group = np.repeat(row[which] * several + words.indices.to_numpy(zero_copy_only=False), lengths)
            order = np.lexsort((positions, group))
            group = group[order]
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
            n = np.diff(np.r_[first, len(group)])
            yield _batch(
                term=words.dictionary.take(pa.array(group[first] % several)), doc_id=pa.array(numbers[group[first] // several]),
                term_freq=pa.array(n.astype(np.int32)), positions=_lists(n, positions[order]),
            )

    found = _token_files(spark, path, pattern).mapInArrow(run, "term binary, doc_id bigint, term_freq int, positions array<int>")
    return found.select(F.col("term").cast("string").alias("term"), "doc_id", "term_freq", "positions")


def read_token_columns(spark: SparkSession, path: str, pattern: str = "*.tokens") -> DataFrame:
    """Token files as columns, a row for the many files that are read at a time: their
    documents and how many lines each has, the different tokens, and for the lines, by
    document, token and rest, the place of their token and their rest. All lines of a
    document are in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, _, texts in token_chunks(contents(batches)):
            which, tokens, rests = cut_lines(texts)
            words = tokens.dictionary_encode()
            different = words.dictionary.take(order := pc.sort_indices(words.dictionary))
            number = np.empty(len(order), dtype=np.int64)
            number[order.to_numpy(zero_copy_only=False)] = np.arange(len(order))
            numbers, row = np.unique(np.array(docs, dtype=np.int64), return_inverse=True)
            key = row[which] * max(len(order), 1) + number[words.indices.to_numpy(zero_copy_only=False)]
            if not (np.diff(key) > 0).all():
                placed = pc.sort_indices(pa.table({"key": key, "rest": rests}), sort_keys=[("key", "ascending"), ("rest", "ascending")])
                key, rests = key[placed.to_numpy(zero_copy_only=False)], rests.take(placed)
            at, n = np.divmod(key, max(len(order), 1))
            lines = np.bincount(at, minlength=len(numbers))
            columns = {"docs": pa.array(numbers[lines > 0]), "lines": pa.array(lines[lines > 0].astype(np.int32)), "tokens": different, "places": pa.array(n.astype(np.int32)), "rests": rests}
            yield _batch(**{name: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for name, c in columns.items()})

    return _token_files(spark, path, pattern).mapInArrow(run, "docs array<bigint>, lines array<int>, tokens array<binary>, places array<int>, rests array<binary>")


def explode_token_lists(lists: DataFrame, key: str = "doc_num") -> DataFrame:
    """(doc_id, pos, term) of token lists; repeated lines of a token are merged by the index."""
    return lists.select(F.col(key).cast("bigint").alias("doc_id"), F.explode("positions").alias("pos"), F.col("token").alias("term"))


def read_stopwords(spark: SparkSession, path: str | None) -> DataFrame:
    """(word): one a line, ``#`` starts a comment, outer white space is dropped,
    words are not folded. No path gives no words; a missing file is logged and
    gives none."""
    if path is not None and not exists(spark, path):
        log.warning("no stop words at %s", path)
        path = None
    if path is None:
        return empty(spark, "word string")
    word = F.regexp_replace(F.regexp_replace("value", "#.*", ""), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return spark.read.text(path).select(word.alias("word")).where("word <> ''").distinct()


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, source_url, word_count) of a CSV file with a header."""
    return spark.read.csv(path, header=True, quote='"', escape='"', schema=schemas.METADATA)


def titles_by_filename(metadata: DataFrame) -> DataFrame:
    """(filename, title): metadata numbers are the numbers in file names."""
    return metadata.select(F.format_string("doc%05d.tokens", "doc_id").alias("filename"), "title").unionAll(
        metadata.select(F.format_string("doc%05d.txt", "doc_id"), "title")
    )


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated vocabulary; malformed rows are dropped."""
    return spark.read.csv(path, sep="\t", schema=schemas.VOCABULARY, mode="DROPMALFORMED", quote="")


def read_docids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schemas.DOCIDS, mode="DROPMALFORMED", quote="")


def read_index_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.STATS).json(path)


FIRST_READ, MOST_READ = 4 << 10, 16 << 20  # bytes of a posting list read at a time


def _numbers(parts: list[tuple[str, int, int]], start: int, opened: dict) -> Iterator[np.ndarray]:
    """The 32-bit numbers from a place on of files that follow each other, (path,
    start, size) each; more is read at a time the longer it goes on."""
    step = FIRST_READ
    for path, at, size in parts:
        if at + size <= start:
            continue
        if path not in opened:
            where, name = file_system(path)
            opened[path] = where.open_input_file(name)
        place = max(start, at)
        while place < at + size:
            opened[path].seek(place - at)
            block = opened[path].read(min(step, at + size - place))
            yield np.frombuffer(block, dtype="<i4")
            place += len(block)
            step = min(4 * step, MOST_READ)


def _list_of(chunks: Iterator[np.ndarray]) -> Iterator[tuple[int, int, list[int]]]:
    """Postings of one list, read as they come."""
    held = np.zeros(0, dtype="<i4")
    at = 0

    def more(n: int) -> bool:
        nonlocal held, at
        while len(held) - at < n:
            block = next(chunks, None)
            if block is None:
                return False
            held, at = np.concatenate([held[at:], block]), 0
        return True

    if not more(1):
        return
    left, at = int(held[0]), 1
    for _ in range(left):
        if not more(3):
            raise ValueError("a posting list ends too early")
        d, f, n = held[at : at + 3].tolist()
        if not more(3 + n):
            raise ValueError("a posting list ends too early")
        yield d, f, held[at + 3 : at + 3 + n].tolist()
        at += 3 + n


def read_postings(spark: SparkSession, path: str, vocabulary: DataFrame) -> DataFrame:
    """(term, doc_id, term_freq, positions) of binary posting lists: one file, or a
    folder of parts that follow each other. ``vocabulary`` (term, postings_offset)
    says where lists begin; with a few of its rows only their lists are read."""
    where, base = file_system(path)
    info = where.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = sorted((f for f in where.get_file_info(fs.FileSelector(base)) if f.base_name.endswith(".bin")), key=lambda f: f.base_name) if info.type == fs.FileType.Directory else [info]
    prefix = path[: len(path) - len(base)] if path.endswith(base) else "file://"
    parts, at = [], 0
    for f in found:
        parts.append((prefix + f.path, at, f.size))
        at += f.size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["term", "doc_id", "term_freq", "positions"]
        opened: dict = {}
        rows: list[tuple] = []
        for b in batches:
            for term, offset in zip(b["term"], b["postings_offset"]):
                for posting in _list_of(_numbers(parts, int(offset), opened)):
                    rows.append((term, *posting))
                    if len(rows) >= 20_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return vocabulary.select("term", "postings_offset").mapInPandas(run, schemas.POSTINGS)


def read_category_members(spark: SparkSession, path: str) -> DataFrame:
    """(cat, ns, title, next) of recorded API pages, one file a page; cat is the
    file's name up to the first dot, next the token of the following page."""
    pages = _named(spark.read.json(path, schema=schemas.API_MEMBERS, multiLine=True))
    members = pages.select(
        F.substring_index("filename", ".", 1).alias("cat"), F.explode("query.categorymembers").alias("m"), F.try_element_at("continue", F.lit("cmcontinue")).alias("next")
    )
    return members.select("cat", F.coalesce("m.ns", F.lit(0)).alias("ns"), "m.title", "next")


def read_extracts(spark: SparkSession, path: str) -> DataFrame:
    """(page_key, title, extract, source_url) of recorded API answers: the first page of each."""
    answers = spark.read.json(path, schema=schemas.API_EXTRACTS, multiLine=True)
    first = answers.select(F.try_element_at(F.map_entries("query.pages"), F.lit(1)).alias("p")).where("p IS NOT NULL")
    return first.select(F.col("p.key").alias("page_key"), "p.value.title", "p.value.extract", F.col("p.value.fullurl").alias("source_url"))
