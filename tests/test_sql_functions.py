from __future__ import annotations

from termloom.functions import stem_ru
from termloom.functions.sql import register_functions
from termloom.streaming import ingest
from termloom.streaming.progress import ProgressLog

from .test_text import STEMS


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql("SELECT tokenize('Don''t stop—Й7') t, word_count_of(' a b  c ') n, clean_text(' a \n\n== x ==\nb') c, nfkc('ﬁ') f").first()
    assert row["t"] == ["don't", "stop", "й7"] and row["n"] == 3 and row["c"] == "a\nb" and row["f"] == "fi"
    assert [r[0] for r in spark.sql("SELECT boolean_match(t, q) FROM VALUES (array('a'), 'a AND NOT b'), (array('a','b'), 'a AND NOT b'), (NULL, 'NOT a'), (array('a'), ')'), (array('a'), NULL) AS v(t, q)").collect()] == [True, False, True, None, None]
    words = spark.createDataFrame([(w,) for w in [*STEMS, None]], "term string")
    stem_ru.with_stem(words).selectExpr("term", "stem", "stem_ru(term) AS other").createOrReplaceTempView("stems")
    assert spark.sql("SELECT * FROM stems WHERE NOT stem <=> other").count() == 0


def test_progress_log(spark, tmp_path):
    import json
    import time

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"title": "t", "text": "a b c", "fetched_at": "2026-01-01T00:00:00Z"}))
    seen = ProgressLog()
    spark.streams.addListener(seen)
    try:
        ingest.stream_ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", min_words=1).awaitTermination()
        for _ in range(100):
            if any(p.ended for p in seen.queries.values()):
                break
            time.sleep(0.1)
        assert sum(p.rows_in for p in seen.queries.values()) == 1 and all(p.failed is None for p in seen.queries.values())
    finally:
        spark.streams.removeListener(seen)
