from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.operators import index, ordering, zipf
from termloom.plans import search
from termloom.plans.query import And, Not, Or, QueryError, Term, explain_query, holds, parse_query, print_query
from termloom.sources import files, sinks

from .conftest import rows


@pytest.fixture(scope="module")
def small(spark):
    """doc 0: a 0 2, b 1; doc 1: b 0, c 1 3, a 2."""
    tokens = spark.createDataFrame(
        [(0, 0, "a"), (0, 2, "a"), (0, 1, "b"), (1, 0, "b"), (1, 1, "c"), (1, 3, "c"), (1, 2, "a")], "doc_id bigint, pos int, term string"
    )
    ids = spark.createDataFrame([(0, "doc00001.tokens"), (1, "doc00002.tokens")], "doc_id bigint, filename string")
    return index.build_index(tokens, ids)


def test_index(small):
    assert rows(small.postings) == [("a", 0, 1, [2]), ("a", 1, 1, [2]), ("b", 0, 1, [1]), ("c", 1, 2, [1, 3])]
    assert rows(small.vocabulary) == [("a", 0, 2, 0), ("b", 1, 1, 36), ("c", 2, 1, 56)]
    assert tuple(small.stats.first()) == (2, 3, 4, 5)
    assert index.verify_index(small).count() == 0
    assert rows(index.posting_bytes(small.postings)) == [("a", 36), ("b", 20), ("c", 24)]


def test_document_postings_equal_token_postings(spark):
    from termloom.functions.text import tokenize

    texts = ["a b a", "", None, "B c-d ﬁ", "x " * 5000 + "y", "a"]
    docs = spark.createDataFrame([(i * 3, t, "z") for i, t in enumerate(texts)], "doc_id bigint, text string, term string")
    for drop in (True, False):
        assert rows(index.document_postings(docs, drop_position_zero=drop)) == rows(index.build_postings(tokenize(docs), drop))
    assert index.document_postings(docs.limit(0)).count() == 0
    ix = index.build_document_index(docs.select(F.col("doc_id").cast("int").alias("doc_num"), "text"))
    assert index.verify_index(ix).count() == 0 and ix.docids.count() == len(texts)


def test_save_load_export(spark, small, tmp_path):
    small.save(f"{tmp_path}/ix")
    again = index.Index.load(spark, f"{tmp_path}/ix")
    assert rows(again.postings) == rows(small.postings)
    sinks.export_text(again, f"{tmp_path}/text")
    assert rows(files.read_vocabulary(spark, f"{tmp_path}/text/vocab.txt")) == rows(small.vocabulary)
    assert rows(files.read_docids(spark, f"{tmp_path}/text/docids.txt")) == rows(small.docids)
    assert rows(files.read_postings(spark, f"{tmp_path}/text/postings.bin", small.vocabulary)) == rows(small.postings)
    assert rows(files.read_index_stats(spark, f"{tmp_path}/text/index_stats.json")) == rows(small.stats)


def test_verify_finds_violations(spark, small):
    bad = index.Index(
        small.postings.withColumn("term_freq", F.lit(9)), small.vocabulary.where("term <> 'c'").withColumn("doc_freq", F.lit(7)), small.docids.where("doc_id > 0"), small.stats
    )
    rules = {r["rule"] for r in index.verify_index(bad).collect()}
    assert rules == {"term_freq", "doc_freq", "term_known", "document_known", "documents_dense", "stats"}


def test_empty_index(spark):
    ix = index.build_index(spark.createDataFrame([], "doc_id bigint, pos int, term string"), spark.createDataFrame([], "doc_id bigint, filename string"))
    assert tuple(ix.stats.first()) == (0, 0, 0, 0)
    assert index.verify_index(ix).count() == 0
    assert search.matching(ix, "NOT a").count() == 0


PROBES = {
    "a AND b": {1}, "a OR b AND c": {0, 1}, "(a OR b) AND NOT c": {0, 1, 2}, "NOT NOT a": {0, 1}, "NOT a AND b": {2}, "a b": {0, 1},
    "a && b": {0, 1}, "!a": {0, 1}, "AND a": set(), "a OR": {0, 1}, "NOT": {0, 1, 2, 3}, "(a OR b": {0, 1, 2}, "(a b) AND c": {0, 1},
    "zzz": set(), "NOT zzz": {0, 1, 2, 3}, "A and B": {1},
}
HELD = {0: {"a"}, 1: {"a", "b"}, 2: {"b"}, 3: {"c"}}


@pytest.fixture(scope="module")
def four(spark):
    tokens = spark.createDataFrame([(d, i + 1, w) for d, ws in HELD.items() for i, w in enumerate(sorted(ws))], "doc_id bigint, pos int, term string")
    ids = spark.createDataFrame([(d, f"doc0000{d + 1}.txt") for d in HELD], "doc_id bigint, filename string")
    return index.build_index(tokens, ids)


@pytest.mark.parametrize("query", PROBES)
def test_search_probes(four, query):
    assert {r[0] for r in search.matching(four, query).collect()} == PROBES[query]


def test_search_many_equals_single(four):
    many = search.search_many(four, {q: q for q in PROBES})
    got = {q: set() for q in PROBES}
    for r in many.collect():
        got[r["query_id"]].add(r["doc_id"])
    assert got == PROBES


@pytest.mark.parametrize("query", ["", ")", "()", "   "])
def test_parse_errors(query):
    with pytest.raises(QueryError):
        parse_query(query)


@pytest.mark.parametrize("query", ["a b", "a && b", "!a", "AND a", "a OR", "NOT", "(a OR b"])
def test_strict_mode(query):
    with pytest.raises(QueryError):
        parse_query(query, strict=True)


def test_folds():
    assert parse_query("ПРОГРАММА Tail") == Term("ПРОГРАММА")
    assert parse_query("ПРОГРАММА", fold="full") == Term("программа")
    assert parse_query("«x»") == Term("«x»")
    assert explain_query("a AND NOT (b OR c)").splitlines() == ["AND", "  TERM a", "  NOT", "    OR", "      TERM b", "      TERM c"]


trees = st.recursive(st.sampled_from("abcz").map(Term), lambda t: st.builds(Not, t) | st.builds(And, t, t) | st.builds(Or, t, t), max_leaves=6)


@given(trees)
def test_print_parse_round_trip(tree):
    assert parse_query(print_query(tree), strict=True) == tree


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(tree=trees)
def test_plans_agree(four, tree):
    expected = {d for d, words in HELD.items() if holds(tree, words)}
    assert {r[0] for r in search.matching(four, tree).collect()} == expected
    assert {r[0] for r in search.matching_by_sets(four, tree).collect()} == expected


def test_titles(spark, four):
    titles = spark.createDataFrame([("doc00001.txt", "One"), ("other", "x")], "filename string, title string")
    assert rows(search.search(four, "a", titles)) == [(0, "doc00001.txt", "One"), (1, "doc00002.txt", search.NO_TITLE)]
    assert rows(search.search(four, "c"), "title") == [(None,)]


def test_lookup_is_pushed_down(spark, four, tmp_path):
    four.save(f"{tmp_path}/ix")
    plan = index.Index.load(spark, f"{tmp_path}/ix").postings.where("term = 'a'").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,a)" in plan and "positions" not in plan.split("ReadSchema")[1]


def test_zipf(spark):
    lists = spark.createDataFrame([("a", [0, 2, 5]), ("b", [1]), ("c", [3, 4]), ("d", []), ("b", [0, 1])], "token string, positions array<int>")
    rank = zipf.zipf_rank(zipf.frequency_of_lists(lists))
    assert rows(rank) == [(1, "a", 3), (2, "b", 3), (3, "c", 2)]
    line = zipf.zipf_regression(rank).first()
    fitted = zipf.zipf_fit(rank).orderBy("rank").first()["fitted"]
    assert fitted == pytest.approx(line["intercept"])
    assert zipf.zipf_regression(rank, 1).first()["slope"] is None
    assert zipf.zipf_regression(rank, 2).first()["r_squared"] == 1.0
    assert rows(sinks.plot_lines(rank, 2)) == [(1, 3, "a"), (2, 3, "b")]


def test_ordering_without_single_task(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1009 AS x", "id % 3 AS v")
    got = ordering.running_total(ordering.ranked(df, ["x"], "n"), ["x"], "v", "before").orderBy("x").collect()
    assert [r["n"] for r in got] == list(range(1, 1001))
    total = 0
    for r in got:
        assert r["before"] == total
        total += r["v"]
    assert ordering.ranked(df.limit(0), ["x"], "n").count() == 0
