from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from termloom.operators import compact, skew

from .conftest import rows

POSTINGS = "segment_no int, term string, doc_id int, term_freq int, positions array<int>, term_id int"


@pytest.fixture(scope="module")
def skewed(spark):
    r = random.Random(3)
    data = []
    for d in range(400):
        data.append((0, "hot", d, 1, [d % 5], 9))
        for t in r.sample(range(300), 2):
            data.append((0, f"t{t}", d, None if d % 9 == 0 else 1, [3, 4] if d % 9 == 0 else None, 9))
    data += [(1, "hot", 5, 0, [1, 2, 3], 9), (1, "hot", 7, 1, [7 % 5], 9), (0, None, 1, 1, [0], 9), (0, "none", None, 2, None, 9), (0, "empty", 3, None, None, 9)]
    return data, spark.createDataFrame(data, POSTINGS)


def test_totals_equal_brute_force(spark, skewed):
    data, df = skewed
    cards, n = defaultdict(dict), defaultdict(int)
    for _, term, doc, freq, pos, _ in data:
        if term is None:
            continue
        n[term] += 1
        p = pos or []
        old = cards[term].get(doc, (0, 0, 0))
        cards[term][doc] = tuple(map(max, old, (freq if (freq or 0) > 0 else len(p), len(p), sum(p))))
    vocabulary = spark.createDataFrame([(0, "hot", 1, 300, 0), (0, "hot", 1, None, 0), (1, "hot", 1, 2, 0), (0, None, 1, 1, 0)], "segment_no int, term string, term_id int, doc_freq int, postings_offset bigint")
    got = {r["term"]: r for r in skew.term_totals(df, vocabulary, n_tasks=8).collect()}
    assert got.keys() == cards.keys()
    for t, docs in cards.items():
        r = got[t]
        assert r["n_rows"] == n[t] and r["cards"] == sum(d is not None for d in docs)
        assert (r["occurrences"], r["n_positions"], r["position_sum"]) == tuple(map(sum, zip(*docs.values())))
    assert got["hot"]["stated_cards"] == 302 and got["hot"]["n_shards"] > 1 and got["t1"]["stated_cards"] is None
    assert rows(skew.dominant_terms(skew.term_totals(df))) == [("hot",)]


def test_tasks_are_balanced(spark, skewed):
    _, df = skewed
    where = skew.plan_placement(df, "term", 8)
    assert 1 <= where.n_heavy <= 8 / skew.HEAVY_SHARE
    sizes = where.place(df.select("term", "doc_id"), "term", "doc_id").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 2 * df.count() / 8


def test_join_equals_plain_join(spark, skewed):
    _, df = skewed
    dim = df.where("term IS NOT NULL AND term <> 't1'").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    fact = df.select("term", "doc_id")
    for how in ("inner", "left"):
        assert rows(skew.fragment_replicate_join(fact, dim, "term", "doc_id", how, 6)) == rows(fact.join(dim, "term", how).select("term", "doc_id", "n"))
    with pytest.raises(ValueError):
        skew.fragment_replicate_join(fact, dim.withColumn("doc_id", F.lit(1)), "term", "doc_id")


def test_empty_postings(spark):
    none = spark.createDataFrame([], POSTINGS)
    assert skew.term_totals(none).count() == 0
    assert skew.fragment_replicate_join(none, spark.createDataFrame([], "term string, n int"), "term", "doc_id").count() == 0
    only_null = spark.createDataFrame([(0, None, 1, 1, [0], 0)], POSTINGS)
    assert skew.term_totals(only_null).count() == 0


def test_first_fit_decreasing():
    def plain(sizes, capacity):
        free, out = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            need = min(sizes[i], capacity)
            for b, f in enumerate(free):
                if f >= need:
                    break
            else:
                b = len(free)
                free.append(capacity)
            free[b] -= need
            out[i] = b
        return out

    r = random.Random(1)
    for n in (0, 1, 2, 7, 100):
        sizes = [r.randint(0, 120) for _ in range(n)]
        assert compact.first_fit_decreasing(sizes, 100) == plain(sizes, 100)


BODIES = [
    ("T\n\nx y\n", "a"), ("﻿T\r\n\r\nx y \t\r\n\r\n", "b"), ("T\n\nx y", None), ("T\n\nx  y", "c"), ("", "d"), (None, "e"), (" \n \n", "f"), ("T\rx", "g"), ("T\nx \n", "h"),
    ("﻿", "i"), ("big" * 500, "j"),
]


def files_of(spark):
    data = [(i + 1, n, None if b is None else len(b), b, None, 7) for i, (b, n) in enumerate(BODIES)]
    return spark.createDataFrame(data, "file_no bigint, name string, n_bytes int, body string, digest string, bin int")


def test_compaction(spark, tmp_path):
    done = compact.compact(files_of(spark), f"{tmp_path}/c", target_bytes=64, shard_files=3)
    assert rows(compact.same_records(done.listing())) == [(1, 2), (1, 3), (2, 3), (8, 9)]
    kept = done.records()
    assert rows(kept, "file_no", "record") == [(1, "T\n\nx y"), (11, "big" * 500), (4, "T\n\nx  y"), (8, "T\nx")]
    report = done.report().collect()
    assert sum(r["records"] for r in report) == 4
    assert rows(done.placement(), "file_no") == [(1,), (11,), (4,), (8,)]
    assert all(r["record_bytes"] <= 64 or r["records"] == 1 for r in report)
    assert rows(compact.open_compaction(spark, f"{tmp_path}/c").records()) == rows(kept)


def test_repeated_rows(spark, tmp_path):
    """Rows of one file_no with the same record are one file; other records of that number are kept too."""
    data = [(1, "b", "T\nx"), (1, "a", "T\r\nx"), (1, "a", "T\r\nx"), (2, "c", "T\nx\n"), (2, "c", "T\nx\n"), (3, "d", "one"), (3, "d", "two"), (4, "e", "two"), (5, None, ""), (5, None, "")]
    files = spark.createDataFrame(data, "file_no bigint, name string, body string")
    done = compact.compact(files, f"{tmp_path}/c", target_bytes=64)
    assert rows(compact.same_records(done.listing())) == [(1, 2), (3, 4)]
    assert rows(done.listing(), "file_no", "name", "n_bytes") == [(1, "a", 4), (2, "c", 4), (3, "d", 3), (3, "d", 3), (4, "e", 3), (5, None, 0)]
    assert rows(done.records(), "file_no", "name", "record") == [(1, "a", "T\nx"), (3, "d", "one"), (3, "d", "two")]


def test_uncommitted_is_refused(spark, tmp_path, monkeypatch):
    with pytest.raises(compact.CompactionError):
        compact.open_compaction(spark, f"{tmp_path}/nothing")
    real_checks, calls = compact._checks, []

    def altered(df):
        calls.append(1)
        out = real_checks(df)
        return out.withColumn("records", F.col("records") + 1) if len(calls) == 2 else out

    monkeypatch.setattr(compact, "_checks", altered)
    with pytest.raises(compact.CompactionError):
        compact.compact(files_of(spark), f"{tmp_path}/c")
    with pytest.raises(compact.CompactionError):
        compact.open_compaction(spark, f"{tmp_path}/c")


def test_no_files(spark, tmp_path):
    done = compact.compact(files_of(spark).limit(0), f"{tmp_path}/c")
    assert done.records().count() == 0 and compact.same_records(done.listing()).count() == 0


def test_a_record_that_a_third_of_the_files_hold(spark):
    files = [(i, f"f{i}", "same" if i % 3 == 0 else f"own {i % 200}") for i in range(300)]
    df = spark.createDataFrame(files + files[:5], "file_no bigint, name string, body string")
    done = compact.compact(df)
    groups = {}
    for i, _, body in files:
        groups.setdefault(body, []).append(i)
    assert rows(compact.record_groups(done.listing())) == sorted(((i, min(g)) for g in groups.values() if len(g) > 1 for i in g), key=repr)
    assert rows(compact.same_records(done.listing())) == sorted(((a, b) for g in groups.values() for a in g for b in g if a < b), key=repr)
    assert rows(done.records(), "file_no") == sorted(((min(g),) for g in groups.values()), key=repr)
