from __future__ import annotations

import os
import sys

import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_every_sql_twin_has_a_query():
    assert contract.oracle_sql().keys() <= contract.queries().keys()


def test_core_needs_no_added_package(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("termloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "termloom.llm.queries", None)
    monkeypatch.setitem(sys.modules, "termloom.llm.oracle", None)
    assert "tokens" in contract.queries() and "p1_found" not in contract.queries()


@needs_data
def test_entry(spark):
    got = contract.entry(spark)
    assert got.columns == ["doc_id", "filename", "title"] and got.count() > 0


@needs_data
@pytest.mark.parametrize("name", ["docids", "index_stats", "bool_nested", "zipf_top_n", "dedupe_sha1", "status_histogram", "query_probes", "token_probes", "verify_damaged", "postings_file", "corpus_files", "queue_steps", "p2_found", "p3_totals"])
def test_equals_sql_twin(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("documents", "pages", "postings", "vocabulary", "file_info", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    df = contract.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(columns).collect()))) == sorted(map(repr, result.fetchall()))


def test_package_is_shipped_once(spark):
    from termloom.session import ship

    ship(spark)
    before = list(spark.sparkContext._python_includes)
    ship(spark)
    assert spark.sparkContext._python_includes == before and any(f.startswith("termloom-") for f in before)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from termloom import session

    class Conf:
        def get(self, key, default):
            return default

    class Java:
        def sc(self):
            return self

        def getCheckpointDir(self):
            return self

        def isDefined(self):
            return False

    class Context:
        master, _jsc = "yarn", Java()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session(), "x")
