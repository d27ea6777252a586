from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.functions import text
from termloom.operators import crawl, index, zipf
from termloom.sources import files, sinks, wiki_api
from termloom.streaming import ingest

from .conftest import rows


def test_corpus_and_tokens(spark, tmp_path):
    (tmp_path / "doc00002.txt").write_text("Title\n\nbody text\n")
    (tmp_path / "doc00001.txt").write_text("One")
    (tmp_path / "doc00003.txt").write_text("")
    (tmp_path / "note.txt").write_text("no")
    got = files.read_corpus(spark, str(tmp_path))
    assert rows(got, "doc_num", "title") == [(1, "One"), (2, "Title")]
    (tmp_path / "doc00001.tokens").write_text("a 0 2\nb 1\nd\n\n")
    (tmp_path / "doc00002.tokens").write_text("b 0\nc 1 3x\na -2 2\n")
    assert rows(files.read_tokens(spark, str(tmp_path))) == [(1, "a", [2]), (1, "b", [1]), (2, "a", [2]), (2, "c", [1, 3])]
    assert rows(files.read_tokens(spark, str(tmp_path), positive=False), "token", "positions") == [
        ("a", [-2, 2]), ("a", [0, 2]), ("b", [0]), ("b", [1]), ("c", [1, 3])
    ]
    assert files.explode_token_lists(files.read_tokens(spark, str(tmp_path))).count() == 5


ODD_FILES = {
    "doc00001.tokens": b"a 2 0 1\nb 1\nd\n\n", "doc00001_more.tokens": b"\xef\xbb\xbf  a 3 1\r\nc\t0x1F 4\tz\r\n", "doc00002.tokens": b"a 12345678901 +5 -2 007\nb  7\na 9",
    "doc-3.tokens": "книга 1 2\n".encode() * 2, "docx.tokens": b"e 1 \n f 2\n\tg 3\n", "doc00004.tokens": b"", "_doc00005.tokens": b"h 1\n", "other.tokens": b"i 1\n",
}


def test_many_token_files(spark, tmp_path):
    """Small files are read many in a task, and a document's lists of a token meet without a shuffle of them."""
    for name, content in ODD_FILES.items():
        (tmp_path / name).write_bytes(content)
    found = files.read_tokens(spark, f"file:{tmp_path}")
    assert rows(found) == rows(files.read_tokens(spark, f"{tmp_path.parent}/{tmp_path.name[:-1]}[{tmp_path.name[-1]}]")) == sorted(
        [(1, "a", [2, 1]), (1, "b", [1]), (1, "a", [3, 1]), (1, "c", [4]), (2, "a", [123456789, 5, 7]), (2, "b", [7]), (2, "a", [9]), (-3, "книга", [1, 2]), (-3, "книга", [1, 2])]
        + [(-1, "e", [1]), (-1, "f", [2]), (-1, "", [3])], key=repr,
    )
    assert (2, "a", [123456789, 5, -2, 7]) in rows(files.read_tokens(spark, str(tmp_path), positive=False))
    assert ("doc00001.tokens", 1, "d", "") in rows(files.read_token_lines(spark, str(tmp_path))) and files.read_token_lines(spark, str(tmp_path), "{other,docx}.*").count() == 4
    postings = files.read_token_postings(spark, str(tmp_path))
    assert rows(postings) == rows(index.build_postings(files.explode_token_lists(found))) and (("a", 1, 4, [1, 1, 2, 3])) in rows(postings)
    with pytest.raises(FileNotFoundError):
        files.read_tokens(spark, f"{tmp_path}/none")
    for i in range(300):
        (tmp_path / f"doc{i + 10:05d}.tokens").write_text(f"t{i} 1 2\nt 3\n")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    many = files.read_token_postings(spark, str(tmp_path), "doc?????.tokens")
    assert many.rdd.getNumPartitions() == files.read_tokens(spark, str(tmp_path)).rdd.getNumPartitions() == n and many.where("term = 't' AND term_freq = 1").count() == 300
    assert "Aggregate" not in many._jdf.queryExecution().optimizedPlan().toString()


def test_stemmed_token_files(spark, tmp_path):
    """Files stemmed where they are read are those that a join of all lines gives."""
    (tmp_path / "in").mkdir()
    for name, content in (ODD_FILES | {f"doc{i:05d}.tokens": f"книги {i}\nкнигой 1 2\nпрограммирование\nкниги 0\nё\n".encode() for i in range(10, 200)}).items():
        (tmp_path / "in" / name).write_bytes(content)
    sinks.write_stemmed_tokens(files.read_token_lines(spark, f"{tmp_path}/in"), f"{tmp_path}/joined")
    want = {f.name: f.read_bytes() for f in (tmp_path / "joined").iterdir()}
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("stems", "")
    assert sinks.stem_token_files(spark, f"{tmp_path}/in", f"{tmp_path}/out") == len(want) == 194
    tasks = sum(jobs.getStageInfo(s).numTasks for j in jobs.getJobIdsForGroup("stems") for s in jobs.getJobInfo(j).stageIds)
    spark.sparkContext.setJobGroup("", "")
    assert {f.name: f.read_bytes() for f in (tmp_path / "out").iterdir()} == want
    assert want["doc00010.tokens"].decode() == "книг 0\nкниг 10\nкниг 1 2\nпрограммирован\nё\n" and tasks <= 12


def test_document_token_files(spark, tmp_path):
    own = spark.createDataFrame([(1, "b a A книги"), (2, None), (3, "…"), (None, "c"), (100000, "a-b a\nё 𝒳")], "doc_id int, text string")
    for positions in (True, False):
        assert sinks.write_document_tokens(own, f"{tmp_path}/{positions}", positions=positions) == 2 == sinks.write_tokens(text.tokenize(own.where("doc_id > 0")), f"{tmp_path}/rows{positions}", positions)
        for name in ("doc00001.tokens", "doc100000.tokens"):
            assert (tmp_path / str(positions) / name).read_bytes() == (tmp_path / f"rows{positions}" / name).read_bytes()
    assert (tmp_path / "True" / "doc00001.tokens").read_text() == "a 1 2\nb 0\nкниги 3\n" and sinks.write_document_tokens(own.limit(0), f"{tmp_path}/none") == 0


def test_token_files_round_trip(spark, tmp_path):
    tokens = spark.createDataFrame([(1, 0, "b"), (1, 2, "a"), (1, 1, "a"), (2, 0, "книгой"), (2, 1, "книги"), (2, 2, "a")], "doc_id bigint, pos int, term string")
    assert sinks.write_tokens(tokens, f"{tmp_path}/out") == 2 and (tmp_path / "out" / "doc00001.tokens").read_text() == "a 1 2\nb 0\n"
    assert sinks.write_tokens(tokens, f"{tmp_path}/out") == 2 and len(list((tmp_path / "out").iterdir())) == 2
    assert rows(files.read_tokens(spark, f"{tmp_path}/out", positive=False)) == [(1, "a", [1, 2]), (1, "b", [0]), (2, "a", [2]), (2, "книги", [1]), (2, "книгой", [0])]
    sinks.write_stemmed_tokens(files.read_token_lines(spark, f"{tmp_path}/out"), f"{tmp_path}/stems")
    assert (tmp_path / "stems" / "doc00002.tokens").read_text() == "a 2\nкниг 1\nкниг 0\n"
    sinks.write_tokens(tokens, f"{tmp_path}/bare", positions=False)
    assert (tmp_path / "bare" / "doc00001.tokens").read_text() == "a\nb\n"
    assert sinks.write_tokens(tokens.limit(0), f"{tmp_path}/none") == 0


def test_postings_file(spark, tmp_path):
    import struct

    docids = spark.range(3).select(F.col("id").alias("doc_id"), F.format_string("doc%05d.txt", "id").alias("filename"))
    tokens = spark.createDataFrame([(d, p, t) for d in range(3) for p, t in enumerate(["x", "hot", "hot", f"t{d}"])], "doc_id bigint, pos int, term string")
    ix = index.build_index(tokens, docids)
    sinks.write_postings(ix, f"{tmp_path}/p")
    whole = b"".join(f.read_bytes() for f in sorted((tmp_path / "p").iterdir()))
    assert struct.unpack(f"<{len(whole) // 4}i", whole)[:6] == (3, 0, 2, 2, 1, 2) and len(whole) == 4 * (1 + 3 * 5 + 3 * 5)
    (tmp_path / "postings.bin").write_bytes(whole)
    for path in ("p", "postings.bin"):
        assert rows(files.read_postings(spark, f"{tmp_path}/{path}", ix.vocabulary)) == rows(ix.postings)
    assert rows(files.read_postings(spark, f"file://{tmp_path}/p", ix.vocabulary.where("term = 't1'")), "doc_id", "positions") == [(1, [3])]
    (tmp_path / "cut.bin").write_bytes(whole[:-4])
    with pytest.raises(Exception, match="ends too early"):
        files.read_postings(spark, f"{tmp_path}/cut.bin", ix.vocabulary).count()
    empty = index.build_index(tokens.limit(0), docids)
    sinks.write_postings(empty, f"{tmp_path}/e")
    assert files.read_postings(spark, f"{tmp_path}/e", empty.vocabulary).count() == 0
    sinks.write_plot(zipf.zipf_rank(zipf.term_frequency(tokens)), f"{tmp_path}/plot.svg")
    assert (tmp_path / "plot.svg").read_text().count("<circle") == 5
    sinks.write_plot(zipf.zipf_rank(zipf.term_frequency(tokens.limit(0))), f"{tmp_path}/none.svg")


def test_layout():
    lay = index.plan_layout([("a", 1), ("hot", 50), ("m", 3), ("z", 6)], 6, 100)
    assert lay.n_partitions >= sum(lay.split[1:]) + 1 and max(lay.split) >= 4
    terms = ["", "a", "hot", "m", "zz"]
    parts = [lay.partitions(terms, np.full(100, i), np.arange(100)) for i in range(5)]
    assert len(set(parts[2])) == max(lay.split) and all((np.diff(p) >= 0).all() for p in parts) and all(a.max() <= b.min() for a, b in zip(parts, parts[1:]))
    assert index.plan_layout([], 4, 0).n_partitions == 1


def test_document_index_of_any_numbers(spark):
    texts = [(7, "x b a b"), (3, "x a"), (None, "x lost"), (9, None), (4, "")]
    df = spark.createDataFrame(texts, "doc_num int, text string")
    got = index.build_document_index(df)
    tokens = text.tokenize(df.where("doc_num IS NOT NULL").withColumn("doc_id", F.expr("CASE doc_num WHEN 3 THEN 0 WHEN 4 THEN 1 WHEN 7 THEN 2 ELSE 3 END")))
    want = index.build_index(tokens, got.docids)
    assert rows(got.postings) == rows(want.postings) and rows(got.vocabulary) == rows(want.vocabulary) and rows(got.stats) == rows(want.stats)
    assert rows(got.docids) == [(0, "doc00003.txt"), (1, "doc00004.txt"), (2, "doc00007.txt"), (3, "doc00009.txt")] and index.verify_index(got).count() == 0
    dense = index.build_document_index(df.where("doc_num IS NOT NULL").selectExpr("CASE doc_num WHEN 7 THEN 11 WHEN 3 THEN 12 WHEN 9 THEN 13 ELSE 14 END AS doc_num", "text"))
    assert rows(dense.postings, "term", "doc_id") == [("a", 0), ("a", 1), ("b", 0)] and dense.docids.count() == 4
    assert index.build_document_index(df.limit(0)).stats.first()["num_documents"] == 0


def test_stopwords_and_metadata(spark, tmp_path):
    (tmp_path / "stop").write_text("# all\n the \nThe # x\n\n of\r\n")
    assert rows(files.read_stopwords(spark, f"{tmp_path}/stop")) == [("The",), ("of",), ("the",)]
    assert files.read_stopwords(spark, None).count() == files.read_stopwords(spark, f"{tmp_path}/none").count() == 0
    docs = spark.createDataFrame([(1, 'a "b", c', "http://x", 5), (2, None, None, None)], "doc_id int, title string, source_url string, word_count int")
    sinks.write_metadata(docs, f"{tmp_path}/meta")
    assert rows(files.read_metadata(spark, f"{tmp_path}/meta")) == rows(docs)
    assert ("doc00001.txt", 'a "b", c') in rows(files.titles_by_filename(docs))


def test_documents_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("doc00001.txt", "T", "body\nmore"), ("doc00002.txt", None, None), (None, "x", "y")], "filename string, title string, text string")
    assert sinks.write_documents(docs, f"{tmp_path}/d") == 2
    assert rows(files.read_corpus(spark, f"{tmp_path}/d"), "doc_num", "title", "text") == [(1, "T", "T\n\nbody\nmore"), (2, "", "\n\n")]


def test_api_answers(spark, tmp_path):
    (tmp_path / "Root.1.json").write_text(json.dumps({"query": {"categorymembers": [{"ns": 0, "title": "A"}, {"title": "B"}]}, "continue": {"cmcontinue": "x"}}))
    (tmp_path / "Root.2.json").write_text(json.dumps({"query": {"categorymembers": [{"ns": 14, "title": "Category:S"}]}}))
    assert rows(files.read_category_members(spark, f"{tmp_path}/Root.*.json")) == [("Root", 0, "A", "x"), ("Root", 0, "B", "x"), ("Root", 14, "Category:S", None)]
    (tmp_path / "art.json").write_text(json.dumps({"query": {"pages": {"7": {"title": "A", "extract": "text", "fullurl": "u"}}}}))
    assert rows(files.read_extracts(spark, f"{tmp_path}/art.json")) == [("7", "A", "text", "u")]


def test_client_retries_and_pages():
    answers = [OSError(), b"no json", json.dumps({"query": {"categorymembers": [{"ns": 0, "title": "A"}]}, "continue": {"cmcontinue": "t"}}).encode(),
               json.dumps({"query": {"categorymembers": [{"ns": 14, "title": "B"}]}}).encode()]
    asked, slept = [], []

    def fetch(url, timeout):
        asked.append(url)
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    client = wiki_api.PoliteClient("http://x", delay=0, fetch=fetch, sleep=slept.append)
    assert list(client.members("Root")) == [(0, "A"), (14, "B")]
    assert "cmcontinue=t" in asked[-1] and slept == [1.0, 2.0]
    with pytest.raises(wiki_api.LostPageError):
        list(wiki_api.PoliteClient("http://x", delay=0, fetch=lambda u, t: b"no json", sleep=slept.append).members("Root"))
    assert [wiki_api.backoff(0, x) for x in ("inf", "nan", "1e9", "-3")] == [1, 1, wiki_api.MAX_RETRY_AFTER, 0]
    assert [wiki_api.backoff(n) for n in (0, 3, 9)] == [1, 8, 60] and wiki_api.backoff(0, "7") == 7 and wiki_api.backoff(1, "soon") == 2


def test_workers_share_the_rate(monkeypatch):
    made = []

    class Client:
        def __init__(self, url, delay):
            made.append(delay)

        def members(self, item):
            yield 0, "A"
            raise wiki_api.LostPageError(item)

    monkeypatch.setattr(wiki_api, "PoliteClient", Client)
    reader = wiki_api.WikiApi({"url": "http://x", "items": '["a", "b", "c"]', "workers": "8", "delay": "0.5"}).reader(None)
    shares = reader.partitions()
    assert len(shares) == 3 and list(reader.read(shares[0])) == [("a", 0, "A", None), ("a", None, None, "a")] and made == [1.5]
    strict = wiki_api.WikiApi({"url": "http://x", "items": '["a"]', "on_error": "fail"}).reader(None)
    with pytest.raises(wiki_api.LostPageError):
        list(strict.read(strict.partitions()[0]))


MEMBERS = [("r", 0, "p1"), ("r", 14, "Category:s"), ("s", None, "p2"), ("s", 14, "Категория:r"), ("s", 14, "Category:t"), ("t", 0, "p1"), ("t", 0, "p3"), ("z", 0, "no"), ("s", 4, "talk")]


def test_discover(spark):
    members = spark.createDataFrame(MEMBERS, "cat string, ns int, title string")
    pages, cats = crawl.discover(members, ["r"])
    assert rows(pages) == [("p1",), ("p2",), ("p3",)] and rows(cats) == [("r", 0), ("s", 1), ("t", 2)]
    pages, cats = crawl.discover(members, ["r"], max_depth=1)
    assert rows(pages) == [("p1",), ("p2",)] and rows(cats) == [("r", 0), ("s", 1)]
    assert crawl.discover(members.limit(0), ["r"])[0].count() == 0


def test_queue(spark):
    state = spark.createDataFrame([(1, "a", 0, 0, None), (2, "b", 3, 2, "x"), (3, "c", 3, 3, "x"), (4, "d", 2, 1, None), (5, "e", 1, 1, None)],
                                  "id int, title string, status int, attempts int, last_error string")
    for c, t in (("sha1", "string"), ("word_count", "int"), ("source_url", "string"), ("doc_id", "int"), ("discovered_at", "timestamp"), ("processed_at", "timestamp")):
        state = state.withColumn(c, F.lit(None).cast(t))
    chosen = crawl.next_pages(state, 5)
    assert rows(chosen, "id") == [(1,), (2,)]
    claimed = crawl.claim(state, chosen)
    assert rows(claimed, "id", "status", "attempts") == [(1, 2, 1), (2, 2, 3), (3, 3, 3), (4, 2, 1), (5, 1, 1)]
    results = spark.createDataFrame([(1, 1, "h", 9, "u", 1, None), (2, 3, None, None, None, None, "bad")],
                                    "id int, status int, sha1 string, word_count int, source_url string, doc_id int, last_error string")
    after = crawl.apply_results(claimed, results)
    assert rows(after, "id", "status", "last_error") == [(1, 1, None), (2, 3, "bad"), (3, 3, "x"), (4, 2, None), (5, 1, None)]
    stats = crawl.crawl_stats(after).first()
    assert (stats["pages"], stats["done"], stats["saved"], stats["failed_for_good"]) == (5, 2, 1, 2)
    assert rows(crawl.requeue(after).where("id = 4"), "status") == [(0,)]
    more = crawl.enqueue(after, spark.createDataFrame([("a",), ("new",), ("new",), (None,)], "title string"))
    assert rows(more.where("id > 5"), "id", "title", "status") == [(6, "new", 0)]
    assert json.loads(crawl.log_events(chosen.select("id"), "claim", "m").first()["details"])["id"] in (1, 2)


QUEUE = "id int, title string, status int, sha1 string, word_count int, source_url string, doc_id int, attempts int, last_error string, discovered_at timestamp, processed_at timestamp"


def test_stored_queue(spark, tmp_path):
    none = (None,) * 4
    pages = spark.createDataFrame([(i, f"t{i}", 0, *none, 0, None, None, None) for i in range(1, 6)], QUEUE)
    q = crawl.StoredQueue.create(pages, f"{tmp_path}/q")
    with pytest.raises(crawl.ConflictError):
        crawl.StoredQueue.create(pages, f"{tmp_path}/q")
    other = crawl.StoredQueue(spark, f"{tmp_path}/q")
    assert rows(q.claim(2), "id", "status", "attempts") == [(1, 2, 1), (2, 2, 1)] and rows(other.claim(2), "id") == [(3,), (4,)]
    results = spark.createDataFrame([(1, 1, "h", 9, "u", 1, None), (2, 3, None, None, None, None, "bad"), (99, 1, None, None, None, None, None)],
                                    "id int, status int, sha1 string, word_count int, source_url string, doc_id int, last_error string")
    q.apply(results)
    q.enqueue(spark.createDataFrame([("t1",), ("new",), (None,)], "title string"))
    other.requeue()
    expected = [(1, 1, 1), (2, 3, 1), (3, 0, 1), (4, 0, 1), (5, 0, 0), (6, 0, 0)]
    assert rows(q.state(), "id", "status", "attempts") == expected
    q.compact()
    assert len(q.log()) == 1 and rows(other.state(), "id", "status", "attempts") == expected
    # a step that another writer took first changes nothing
    number, state = q._at()
    q.claim(1)
    with pytest.raises(crawl.ConflictError):
        other._commit(number + 1, state)
    with pytest.raises(FileNotFoundError):
        crawl.StoredQueue(spark, f"{tmp_path}/none").state()


def test_event_log(spark, tmp_path):
    for ids in ((3, 1), (2,)):
        crawl.append_events(crawl.log_events(spark.createDataFrame([(i,) for i in ids], "page int"), "failed", "m"), f"{tmp_path}/log")
    assert rows(crawl.read_events(spark, f"{tmp_path}/log"), "id", "details") == [(1, '{"page":1}'), (2, '{"page":3}'), (3, '{"page":2}')]


def article(n: int, text: str) -> str:
    return json.dumps({"title": f"t{n}", "text": text, "source_url": "u", "fetched_at": "2026-01-01T00:00:00Z"}) + "\n"


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    texts = ["one two three", "four five six", "one two three", "short", "seven eight nine"]
    for i, t in enumerate(texts):
        (src / f"{i}.json").write_text(article(i, t))
    ingest.stream_ingest(spark, str(src), f"{tmp_path}/out", f"{tmp_path}/cp", min_words=3, max_files=1).awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted({t for t in texts if t != "short"})
    (src / "9.json").write_text(article(9, "four five six") + article(10, "ten eleven twelve"))
    ingest.stream_ingest(spark, str(src), f"{tmp_path}/out", f"{tmp_path}/cp", min_words=3).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4


def test_stream_numbered(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i, t in enumerate(["a b c", "d e f", "a b c"]):
        (src / f"{i}.json").write_text(article(i, t))
    run = lambda: ingest.stream_numbered(spark, str(src), f"{tmp_path}/out", f"{tmp_path}/cp", min_words=3, max_documents=3).awaitTermination()
    run()
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "doc_id") == [(1,), (2,)]
    (src / "8.json").write_text(article(8, "g h i") + article(9, "j k l") + article(10, "d e f"))
    run()
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "doc_id") == [(1,), (2,), (3,)]


def test_watermark_dedupe(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "0.json").write_text(article(0, "a b c") + article(1, "a b c"))
    ingest.stream_ingest(spark, str(src), f"{tmp_path}/out", f"{tmp_path}/cp", min_words=3, watermark="1 day").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1
