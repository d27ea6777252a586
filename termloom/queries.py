"""Queries over the test tables, one or more for each operator of the core.

Counts are BIGINT, lists are joined to strings and doubles rounded, so that rows
compare with those of the SQL twins in ``oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas
from .functions import clean as cleaning
from .functions import stem_ru, text
from .functions.sql import register_functions
from .operators import compact, crawl, index, skew, zipf
from .plans import search as searching
from .plans.query import parse_query, print_query
from .session import exists, fingerprint, is_folder, shared_dir, table, written, written_path
from .sources import files, sinks
from .sources.named import remove
from .sources.sinks import plot_lines, token_lines
from .streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]

STOPWORDS = ("the", "of", "and", "in", "der", "die", "und", "в", "и", "на", "с")
SEARCHES = {
    "bool_and": "the AND of",
    "bool_or": "die OR of",
    "bool_not": "NOT the",
    "bool_nested": "(the OR der) AND NOT (of OR und)",
    "bool_not_and": "NOT the AND of",
    "bool_precedence": "der OR the AND NOT of",
    "bool_unknown": "NOT zzzzqq AND the",
    "bool_double_not": "NOT NOT the",
}
MIN_WORDS = 150
ROOTS = ("Списки", "Понятия", "История")
# Probes of the stemmer, its own sample words among them.
WORDS = (
    "программирование программа программист обучение обучать обученный книга книги книгой большой большая большие делать делал "
    "делающий красивый красивая красиво быстро быстрый быстрее машина машины машинный python я новейшего новейше новость"
).split()


def _long(c: str):
    return F.col(c).cast("bigint").alias(c)


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def plain_tokens(spark: SparkSession, d: str, **options) -> DataFrame:
    tokens = text.tokenize(documents(spark, d), normalise=False, **options)
    return tokens.select("doc_id", _long("pos"), "term")


def stopwords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in STOPWORDS], "word string")


def numbered(spark: SparkSession, d: str) -> DataFrame:
    return index.document_numbers(documents(spark, d).select(F.col("doc_id").alias("doc_num")))


_saved: dict[tuple, str] = {}  # folder of the index built by an application over files


def corpus_index(spark: SparkSession, d: str) -> index.Index:
    """Index of the corpus, built and saved once by an application and then loaded,
    so searches read the clustered files. Its own dense numbers replace the document
    numbers. It is built again where the documents' files have changed or its own
    folder is gone."""
    key = (spark.sparkContext.applicationId, d, fingerprint(spark, f"{d}/documents.parquet"))
    if key not in _saved or not exists(spark, f"{_saved[key]}/stats/_SUCCESS"):
        folder = shared_dir(spark, "index")
        index.build_document_index(documents(spark, d).withColumnRenamed("doc_id", "doc_num"), path=folder, normalise=False)
        _saved[key] = folder
    return index.Index.load(spark, _saved[key])


def entry(spark: SparkSession, d: str) -> DataFrame:
    """Boolean search with titles: documents on ``the`` and ``of`` but not ``der``."""
    return searching.search(corpus_index(spark, d), "the AND of AND NOT der", titles(spark, d))


def titles(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(text.document_name(F.col("doc_id").cast("int")).alias("filename"), text.title_of(F.col("text")).alias("title"))


# ------------------------------------------------------------------ tokens
def tokens(spark, d):
    return plain_tokens(spark, d)


def tokens_nfkc(spark, d):
    return text.tokenize(documents(spark, d)).select("doc_id", _long("pos"), "term")


def tokens_no_lowercase(spark, d):
    return plain_tokens(spark, d, lowercase=False)


def tokens_keep_hyphens(spark, d):
    return plain_tokens(spark, d, keep_hyphens=True)


def tokens_remove_numbers(spark, d):
    return plain_tokens(spark, d, keep_numbers=False)


def tokens_strict_numbers(spark, d):
    return plain_tokens(spark, d, keep_numbers=False, strict_numbers=True)


def tokens_stopwords(spark, d):
    return plain_tokens(spark, d, stopwords=stopwords(spark))


def ascii_tokens(spark, d):
    return text.tokenize_ascii(documents(spark, d)).select("doc_id", _long("pos"), "term")


def doc_term_positions(spark, d):
    return token_lines(plain_tokens(spark, d)).select("doc_id", "term", "value")


# ------------------------------------------------------------------- index
def postings(spark, d):
    p = index.document_postings(documents(spark, d), normalise=False)
    return p.select("term", "doc_id", _long("term_freq"), F.array_join(F.transform("positions", lambda x: x.cast("string")), " ").alias("positions"))


def postings_all_positions(spark, d):
    p = index.document_postings(documents(spark, d), drop_position_zero=False, normalise=False)
    return p.select("term", "doc_id", _long("term_freq"), F.element_at("positions", 1).cast("bigint").alias("first_position"))


def vocabulary(spark, d):
    return corpus_index(spark, d).vocabulary.select("term", "term_id", "doc_freq", "postings_offset")


def postings_of_tokens(spark, d):
    """The same from token rows, as after stemming or with stop words removed."""
    p = index.build_postings(plain_tokens(spark, d))
    return p.select("term", "doc_id", _long("term_freq"))


def posting_bytes(spark, d):
    return index.posting_bytes(index.document_postings(documents(spark, d), normalise=False))


def docids(spark, d):
    return numbered(spark, d).select("doc_id", "filename")


def index_stats(spark, d):
    return corpus_index(spark, d).stats


def term_lookup(spark, d):
    found = index.lookup(corpus_index(spark, d), "the")
    return found.select("doc_id", _long("term_freq"), F.size("positions").cast("bigint").alias("n_positions"))


def verify_index(spark, d):
    return index.verify_index(corpus_index(spark, d))


def verify_damaged(spark, d):
    """What is found in an index with planted faults: a wrong doc_freq, offset and
    term_freq, a missing term and a missing document."""
    sound = corpus_index(spark, d)
    last = sound.docids.agg(F.max("doc_id").alias("_last"))
    first = sound.postings.where("term = 'of'").agg(F.min("doc_id").alias("_first"))
    vocabulary = sound.vocabulary.where("term <> 'der'").withColumns(
        {"doc_freq": F.col("doc_freq") + (F.col("term") == "the").cast("int"), "postings_offset": F.col("postings_offset") + 4 * (F.col("term") == "und").cast("int")}
    )
    wrong = ((F.col("term") == "of") & (F.col("doc_id") == F.col("_first"))).cast("int")
    postings = sound.postings.crossJoin(F.broadcast(first)).withColumn("term_freq", F.col("term_freq") + wrong).drop("_first")
    docids = sound.docids.crossJoin(F.broadcast(last)).where("doc_id < _last").drop("_last")
    return index.verify_index(index.Index(postings, vocabulary, docids, sound.stats))


def probe_terms(spark, d):
    probes = index.probe_terms(corpus_index(spark, d), ["the", "und", "zzzzqq"])
    return probes.select("term", "doc_freq", *[_long(c) for c in ("nth", "doc_id", "term_freq", "n_positions")])


def stemmed_vocabulary(spark, d):
    own = written(index.document_postings(documents(spark, d), normalise=False), "postings")
    return stem_ru.stem_postings(own).groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"))


def stemmed_tokens(spark, d):
    """Occurrences of each stem, over the stemmed token rows."""
    return stem_ru.stem_tokens(plain_tokens(spark, d)).groupBy("term").agg(F.count(F.lit(1)).alias("frequency"))


# ------------------------------------------------------------------ search
def _search(name: str) -> Query:
    def run(spark, d):
        return searching.search(corpus_index(spark, d), SEARCHES[name]).select("doc_id", "filename")

    run.__name__ = name
    run.__doc__ = f"Documents for which {SEARCHES[name]!r} holds."
    return run


def bool_with_titles(spark, d):
    return entry(spark, d)


def bool_by_sets(spark, d):
    return searching.matching_by_sets(corpus_index(spark, d), parse_query(SEARCHES["bool_nested"]))


def search_many(spark, d):
    return searching.search_many(corpus_index(spark, d), SEARCHES)


def printed_results(spark, d):
    return searching.result_lines(entry(spark, d))


QUERY_PROBES = (
    "a AND b", "a OR b AND c", "(a OR b) AND NOT c", "NOT NOT a", "NOT a AND b", "a b", "a && b", "!a", "AND a", "a OR", "NOT", "(a OR b", "(a b) AND c", "zzz", "NOT zzz", "A and B", "(((c)))",
)


def query_probes(spark, d):
    """Trees and results of lenient queries over four documents: a in 0 and 1, b in 1 and 2, c in 3."""
    tokens = spark.createDataFrame([(0, 1, "a"), (1, 1, "a"), (1, 2, "b"), (2, 1, "b"), (3, 1, "c")], "doc_id bigint, pos int, term string")
    small = index.build_index(tokens, spark.range(4).select(F.col("id").alias("doc_id"), text.document_name(F.col("id")).alias("filename")))
    found = searching.search_many(small, {q: q for q in QUERY_PROBES})
    docs = found.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(F.col("doc_id").cast("string"))), ",").alias("docs"))
    trees = spark.createDataFrame([(q, print_query(parse_query(q))) for q in QUERY_PROBES], "query string, tree string")
    return trees.join(docs, F.col("query") == F.col("query_id"), "left").select("query", "tree", F.coalesce("docs", F.lit("")).alias("docs"))


# -------------------------------------------------------------------- zipf
def _ranks(spark, d) -> DataFrame:
    return zipf.zipf_rank(zipf.term_frequency(plain_tokens(spark, d)))


def zipf_rank(spark, d):
    return _ranks(spark, d)


def zipf_top_n(spark, d):
    return plot_lines(_ranks(spark, d), 100)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def zipf_regression(spark, d):
    return _rounded(zipf.zipf_regression(_ranks(spark, d)), "slope", "intercept", "r_squared")


def zipf_regression_top_n(spark, d):
    return _rounded(zipf.zipf_regression(_ranks(spark, d), 100), "slope", "intercept", "r_squared")


def zipf_fit(spark, d):
    return _rounded(zipf.zipf_fit(_ranks(spark, d)), "log_rank", "log_frequency", "fitted")


# -------------------------------------------------------------------- stem
def stem_words(spark, d):
    return stem_ru.with_stem(spark.createDataFrame([(w,) for w in WORDS], "term string")).select(F.col("term").alias("word"), "stem")


def stem_log(spark, d):
    return stem_ru.stem_log(plain_tokens(spark, d))


def stem_log_distinct(spark, d):
    return stem_ru.stem_log(plain_tokens(spark, d), distinct=True)


TOKEN_PROBES = (
    ("plain", "Hello, World", {}), ("hyphens", "state-of–the—art", {}), ("kept", "state-of-the-art a–b", {"keep_hyphens": True}), ("quotes", "Rock’n'roll dogs' 'x", {}),
    ("forms", "ﬁ Ⅳ ½ Ａｂ", {}), ("numbers", "7 cats 8", {"keep_numbers": False}), ("flushed", "7-up", {"keep_numbers": False}), ("strict", "7-up 8", {"keep_numbers": False, "strict_numbers": True}),
    ("case", "The Ёж", {"lowercase": False}), ("nothing", "", {}),
)


def token_probes(spark, d):
    """The tokenizer's rules on texts made for them."""
    out = None
    for name, probe, options in TOKEN_PROBES:
        one = text.tokenize(spark.createDataFrame([(name, probe)], "probe string, text string"), key="probe", **options)
        out = one if out is None else out.unionByName(one)
    return out.select("probe", _long("pos"), "term")


# --------------------------------------------------------------------- files
_exported: dict[str, str] = {}  # folder of the files of a saved index


def exported(spark: SparkSession, d: str) -> tuple[index.Index, str]:
    own = corpus_index(spark, d)
    saved = next(f for k, f in reversed(_saved.items()) if k[:2] == (spark.sparkContext.applicationId, d))
    if saved not in _exported:
        _exported[saved] = shared_dir(spark, "export")
        sinks.export_text(own, _exported[saved])
    return own, _exported[saved]


def corpus_files(spark, d):
    """Documents written as one text file each, and read again."""
    folder = shared_dir(spark, "corpus")
    rest = F.regexp_replace(F.substring(F.col("text"), F.length(text.title_of(F.col("text"))) + 2, F.length("text")), r"\A\n", "")
    named = documents(spark, d).select(text.document_name(F.col("doc_id").cast("int")).alias("filename"), text.title_of(F.col("text")).alias("title"), rest.alias("text"))
    sinks.write_documents(named, folder)
    return files.read_corpus(spark, folder).select(_long("doc_num"), "filename", "title", F.sha1("text").alias("sha1"))


def _token_files(spark: SparkSession, d: str) -> str:
    folder = shared_dir(spark, "tokens")
    sinks.write_document_tokens(documents(spark, d), folder, normalise=False)
    return folder


ROUNDS = 4  # of writing and using token files


def _of_token_files(spark: SparkSession, d: str, use: Callable[[str], DataFrame]) -> DataFrame:
    """Rows that ``use`` makes of the token files in a folder. A file takes a block of
    the disk however short it is, all of them 4.6 times the bytes of the documents. So
    those of a part of the documents are written, used and deleted before the next
    part's, and the rows of all are kept in tables."""
    parts = []
    for i in range(ROUNDS):
        folder = shared_dir(spark, "tokens")
        own = documents(spark, d).where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == i)
        sinks.write_document_tokens(own, f"{folder}/tokens", normalise=False)
        rows = use(f"{folder}/tokens")
        parts.append(written_path(rows, "rows"))
        remove(folder)
    return spark.read.schema(rows.schema).parquet(*parts)


def _joined(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)


def token_files(spark, d):
    """Token files with their positions, written and read again."""
    return files.read_tokens(spark, _token_files(spark, d), positive=False).select(_long("doc_num"), "token", _joined("positions"))


def token_file_postings(spark, d):
    """The index of token files, which leaves position 0 out."""
    found = _of_token_files(spark, d, lambda folder: files.read_token_postings(spark, folder).select("term", "doc_id", "term_freq"))
    return found.select("term", "doc_id", _long("term_freq"))


def token_file_ranks(spark, d):
    """Ranks by the positions of token files."""
    return zipf.zipf_rank(zipf.frequency_of_lists(files.read_tokens(spark, _token_files(spark, d), positive=False)))


def stemmed_token_files(spark, d):
    def stems(folder: str) -> DataFrame:
        sinks.stem_token_files(spark, folder, f"{folder}/stems")
        return files.read_token_lines(spark, f"{folder}/stems").select("doc_num", "token", "rest")

    return _of_token_files(spark, d, stems).select(_long("doc_num"), F.col("token").alias("stem"), F.col("rest").alias("positions"))


def metadata_file(spark, d):
    folder = shared_dir(spark, "metadata")
    own = documents(spark, d).select(F.col("doc_id").cast("int").alias("doc_id"), F.concat(F.lit('"'), text.title_of(F.col("text")), F.lit('", a')).alias("title"),
                                     F.lit(None).cast("string").alias("source_url"), text.word_count(F.col("text")).alias("word_count"))
    sinks.write_metadata(own, folder)
    return files.read_metadata(spark, folder).select(_long("doc_id"), "title", "source_url", _long("word_count"))


def metadata_titles(spark, d):
    """Titles by file name, from a metadata file."""
    folder = shared_dir(spark, "metadata")
    own = documents(spark, d).select(F.col("doc_id").cast("int").alias("doc_id"), text.title_of(F.col("text")).alias("title"), F.lit(None).cast("string").alias("source_url"), F.lit(0).alias("word_count"))
    sinks.write_metadata(own, folder)
    return files.titles_by_filename(files.read_metadata(spark, folder))


def api_members(spark, d):
    """Recorded answers of the API, a file for each category, read as members."""
    folder = shared_dir(spark, "answers")
    pages = members(spark, d).groupBy("cat").agg(F.collect_list(F.struct("ns", "title")).alias("categorymembers"))
    answers = pages.select(F.concat(F.hex(F.encode("cat", "UTF-8")), F.lit(".1.json")).alias("filename"), F.to_json(F.struct(F.struct("categorymembers").alias("query"))).alias("value"))
    sinks.write_named(answers, folder)
    found = files.read_category_members(spark, f"{folder}/*.json")
    return found.select(F.decode(F.unhex("cat"), "UTF-8").alias("cat"), _long("ns"), "title")


def api_extracts(spark, d):
    """Recorded answers of the API, a file for each article, read as extracts."""
    folder = shared_dir(spark, "answers")
    key = F.col("doc_id").cast("string")
    page = F.struct(text.title_of(F.col("text")).alias("title"), F.col("text").alias("extract"), F.concat(F.lit("http://wiki/"), key).alias("fullurl"))
    answers = documents(spark, d).select(F.concat(key, F.lit(".json")).alias("filename"), F.to_json(F.struct(F.struct(F.create_map(key, page).alias("pages")).alias("query"))).alias("value"))
    sinks.write_named(answers, folder)
    return files.read_extracts(spark, folder).select(F.col("page_key").cast("bigint").alias("doc_id"), "title", F.sha1("extract").alias("sha1"), "source_url")


def backoffs(spark, d):
    """Seconds to wait by attempts made and what the server asked for."""
    asked = spark.createDataFrame([(n, a) for n in (0, 1, 5, 6, 9) for a in (None, "7", "soon", "0.5")], "attempts int, asked string")
    return asked.select(_long("attempts"), "asked", crawl.backoff_seconds(F.col("attempts"), F.col("asked")).alias("seconds"))


def stopword_file(spark, d):
    folder = shared_dir(spark, "stopwords")
    lines = spark.createDataFrame([("words.txt", "# function words\n" + "\n".join(f" {w} # {w}\t" for w in STOPWORDS) + "\n\n")], "filename string, value string")
    sinks.write_named(lines, folder)
    return files.read_stopwords(spark, f"{folder}/words.txt")


def vocabulary_file(spark, d):
    return files.read_vocabulary(spark, f"{exported(spark, d)[1]}/vocab.txt")


def docids_file(spark, d):
    return files.read_docids(spark, f"{exported(spark, d)[1]}/docids.txt")


def stats_file(spark, d):
    return files.read_index_stats(spark, f"{exported(spark, d)[1]}/index_stats.json")


def postings_file(spark, d):
    """All binary posting lists, written and read again."""
    own, folder = exported(spark, d)
    found = files.read_postings(spark, f"{folder}/postings.bin", files.read_vocabulary(spark, f"{folder}/vocab.txt"))
    return found.select("term", "doc_id", _long("term_freq"), _joined("positions"))


def postings_file_lookup(spark, d):
    """One term's list by its place in the binary file."""
    own, folder = exported(spark, d)
    one = files.read_vocabulary(spark, f"{folder}/vocab.txt").where("term = 'the'")
    return files.read_postings(spark, f"{folder}/postings.bin", one).select("doc_id", _long("term_freq"), F.size("positions").cast("bigint").alias("n_positions"))


def zipf_file(spark, d):
    folder = shared_dir(spark, "zipf")
    sinks.write_csv(_ranks(spark, d), folder, ["rank"])
    return spark.read.csv(folder, header=True, schema=schemas.RANKED)


# ----------------------------------------------------------------------- SQL
def sql_tokenize(spark, d):
    register_functions(spark)
    documents(spark, d).createOrReplaceTempView("sql_documents")
    return spark.sql("SELECT doc_id, CAST(pos AS BIGINT) AS pos, term FROM (SELECT doc_id, tokenize(text) AS terms FROM sql_documents) LATERAL VIEW posexplode(terms) t AS pos, term")


def sql_clean_text(spark, d):
    register_functions(spark)
    documents(spark, d).createOrReplaceTempView("sql_documents")
    return spark.sql("SELECT doc_id, sha1(body) AS sha1, CAST(word_count_of(body) AS BIGINT) AS word_count FROM (SELECT doc_id, clean_text(text) AS body FROM sql_documents)")


def sql_stem(spark, d):
    register_functions(spark)
    plain_tokens(spark, d).select("term").distinct().createOrReplaceTempView("sql_terms")
    return spark.sql("SELECT term AS word, stem_ru(term) AS stem FROM sql_terms")


def sql_boolean_match(spark, d):
    register_functions(spark)
    documents(spark, d).select("doc_id", text.tokens_array(F.lower("text")).alias("terms")).createOrReplaceTempView("sql_token_lists")
    return spark.sql(f"SELECT doc_id FROM sql_token_lists WHERE boolean_match(slice(terms, 2, greatest(size(terms) - 1, 0)), '{SEARCHES['bool_nested']}')")


# ------------------------------------------------------------ cleaning, queue
def clean_docs(spark, d):
    return cleaning.clean(documents(spark, d), min_words=MIN_WORDS).select("doc_id", _long("word_count"), "sha1")


def dedupe_sha1(spark, d):
    hashed = documents(spark, d).where("text IS NOT NULL").select("doc_id", F.sha1("text").alias("sha1"))
    return cleaning.assign_ids(cleaning.dedupe(hashed), "doc_id").select("doc_id", "sha1", "new_id")


def dedupe_existing(spark, d):
    """Contents that are not among those of another table: documents of a known
    language whose text no document of an unknown language has."""
    own = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "lang", F.sha1("text").alias("sha1"))
    return cleaning.dedupe(own.where("lang IS NOT NULL").drop("lang"), own.where("lang IS NULL")).select("doc_id", "sha1")


def document_titles(spark, d):
    """Titles from the crawl's metadata, where it has one, beside the first line of the text."""
    meta = queue(spark, d).where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("title").alias("page_title"))
    own = documents(spark, d).select("doc_id", text.title_of(F.col("text")).alias("title"))
    return own.join(meta, "doc_id", "left")


def queue(spark: SparkSession, d: str) -> DataFrame:
    """The crawl queue: of repeated deliveries of a page the last processed."""
    pages = table(spark, d, "pages")
    return pages.groupBy("id").agg(F.max_by(F.struct(*[c for c in pages.columns if c != "id"]), F.coalesce("processed_at", F.timestamp_seconds(F.lit(0)))).alias("p")).select("id", "p.*")


def status_histogram(spark, d):
    return crawl.status_histogram(queue(spark, d)).select(_long("status"), "pages")


def status_all(spark, d):
    return crawl.status_histogram(queue(spark, d).where("status IS NULL OR status <> 2"), all_statuses=True).select(_long("status"), "pages")


def crawl_stats(spark, d):
    return crawl.crawl_stats(queue(spark, d))


def page_queue_top(spark, d):
    return crawl.next_pages(queue(spark, d), 50).select(_long("id"), "title", _long("attempts"))


def page_claim(spark, d):
    state = written(queue(spark, d), "queue")
    return crawl.claim(state, crawl.next_pages(state, 50)).select(_long("id"), _long("status"), _long("attempts"))


def requeued_pages(spark, d):
    return crawl.status_histogram(crawl.requeue(queue(spark, d))).select(_long("status"), "pages")


def queue_steps(spark, d):
    """A stored queue after its steps: 50 pages are claimed; those tried for the first
    time are done, for the second time failed, the others are lost and queued again;
    two titles come in, one of them known."""
    stored = crawl.StoredQueue.create(queue(spark, d), shared_dir(spark, "queue"))
    claimed = stored.claim(50)
    status = F.when(F.col("attempts") == 1, crawl.DONE).otherwise(crawl.FAILED)
    error = F.when(F.col("attempts") > 1, "lost")
    columns = [status.alias("status"), *[F.lit(None).cast(t).alias(c) for c, t in (("sha1", "string"), ("word_count", "int"), ("source_url", "string"), ("doc_id", "int"))], error.alias("last_error")]
    stored.apply(claimed.where("attempts <= 2").select("id", *columns))
    stored.requeue()
    known = queue(spark, d).agg(F.min("title").alias("title"))
    stored.enqueue(known.union(spark.createDataFrame([("a title that no page has",)], "title string")))
    return stored.state().select(_long("id"), "title", _long("status"), _long("attempts"), "last_error")


def event_log(spark, d):
    """Two appends to an event log."""
    folder = shared_dir(spark, "events")
    pages = queue(spark, d)
    crawl.append_events(crawl.log_events(pages.where(F.col("status") == crawl.FAILED).select("id"), "failed", "a page failed"), folder)
    crawl.append_events(crawl.log_events(pages.where(F.col("status") == crawl.NEW).select("id"), "new", "a page waits"), folder)
    return crawl.read_events(spark, folder).select("id", "event_type", "message", "details")


def event_counts(spark, d):
    return crawl.event_counts(table(spark, d, "events"), F.get_json_object("props", "$.k").cast("int") >= 50).withColumnRenamed("flagged", "upper_half")


def members(spark: SparkSession, d: str) -> DataFrame:
    """Category members: each document's category holds it, the category's first
    word holds the category, and each category its parent, so the graph has cycles."""
    named = table(spark, d, "documents").where("category IS NOT NULL").select(cleaning.strip_category(F.col("category")).alias("cat"), text.title_of(F.col("text")).alias("title"))
    parent = F.substring_index("cat", " ", 1)
    return (
        named.select("cat", F.lit(0).alias("ns"), "title")
        .union(named.select(parent, F.lit(14), F.concat(F.lit("Категория:"), F.col("cat"))))
        .union(named.select("cat", F.lit(14), F.concat(F.lit("Category:"), parent)))
    )


def category_bfs(spark, d):
    return crawl.discover(members(spark, d), list(ROOTS))[1].select("cat", _long("depth"))


def category_pages(spark, d):
    return crawl.discover(members(spark, d), list(ROOTS))[0]


def category_depth(spark, d):
    return crawl.discover(members(spark, d), list(ROOTS), max_depth=1)[1].select("cat", _long("depth"))


# --------------------------------------------------------------- streaming
def stream_dedupe(spark, d):
    """The documents taken as a stream: cleaned, one per content."""
    folder = shared_dir(spark, "stream")
    schema = T.StructType([f for f in table(spark, d, "documents").schema if f.name in ("doc_id", "text")])
    path = f"{d}/documents.parquet"
    source, pattern = (path, None) if is_folder(spark, path) else (d, "documents.parquet")
    query = ingest.stream_ingest(spark, source, f"{folder}/out", f"{folder}/checkpoint", fmt="parquet", schema=schema, min_words=MIN_WORDS, pattern=pattern)
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("sha1", _long("word_count"))


MAX_NUMBERED = 500


def stream_numbered(spark, d):
    """The documents taken as a stream and numbered without gaps, up to a cap."""
    folder = shared_dir(spark, "stream")
    schema = "title string, text string, source_url string, fetched_at timestamp"
    own = documents(spark, d).select(text.title_of(F.col("text")).alias("title"), "text", F.lit(None).cast("string").alias("source_url"), F.lit(None).cast("timestamp").alias("fetched_at"))
    own.write.parquet(f"{folder}/in")
    ingest.stream_numbered(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", fmt="parquet", schema=schema, min_words=MIN_WORDS, max_documents=MAX_NUMBERED).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(_long("doc_id"), "filename")


# ---------------------------------------------------- training-data problems
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return compact.same_records(compact.compact(table(spark, d, "file_info")).listing())


def p2_compact(spark: SparkSession, d: str) -> DataFrame:
    """Every record once, as read back from the committed files."""
    return compact.compact(table(spark, d, "file_info")).records().select("file_no", "name", "record")


def p3_totals(spark: SparkSession, d: str) -> DataFrame:
    totals = skew.term_totals(table(spark, d, "postings"), table(spark, d, "vocabulary"))
    return totals.select("term", "n_rows", F.round("row_share", 9).alias("row_share"), "cards", "occurrences", "n_positions", "position_sum", "stated_cards")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.dominant_terms(skew.term_totals(table(spark, d, "postings"), table(spark, d, "vocabulary")))


ALL: tuple[Query, ...] = (
    tokens, tokens_nfkc, tokens_no_lowercase, tokens_keep_hyphens, tokens_remove_numbers, tokens_strict_numbers, tokens_stopwords,
    ascii_tokens, doc_term_positions, postings, postings_all_positions, postings_of_tokens, vocabulary, posting_bytes, docids, index_stats, term_lookup,
    verify_index, verify_damaged, probe_terms, stemmed_vocabulary, stemmed_tokens, printed_results, query_probes, token_probes, corpus_files, token_files,
    token_file_postings, token_file_ranks, stemmed_token_files, metadata_file, metadata_titles, api_members, api_extracts, backoffs, stopword_file, vocabulary_file, docids_file, stats_file, postings_file,
    postings_file_lookup, zipf_file, sql_tokenize, sql_clean_text, sql_stem, sql_boolean_match, *map(_search, SEARCHES), bool_with_titles, bool_by_sets, search_many, zipf_rank, zipf_top_n,
    zipf_regression, zipf_regression_top_n, zipf_fit, stem_words, stem_log, stem_log_distinct, clean_docs, dedupe_sha1, dedupe_existing,
    document_titles, status_histogram, status_all, queue_steps, event_log, crawl_stats, page_queue_top, page_claim, requeued_pages, event_counts, category_bfs,
    category_pages, category_depth, stream_dedupe, stream_numbered, p2_found, p2_compact, p3_totals, p3_found,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in ALL}
