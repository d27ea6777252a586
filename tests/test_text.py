from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from termloom.functions import clean, stem_ru, text

from .conftest import rows

STEMS = {
    "программирование": "программирован", "программа": "программ", "программист": "программист", "обучение": "обучен",
    "обучать": "обуча", "обученный": "обученн", "книга": "книг", "книги": "книг", "книгой": "книг", "большой": "больш",
    "большая": "больш", "большие": "больш", "делать": "дела", "делал": "дел", "делающий": "делающ", "красивый": "красив",
    "красивая": "красив", "красиво": "красив", "быстро": "быстро", "быстрый": "быстрый", "быстрее": "быстре", "машина": "маш",
    "машины": "маш", "машинный": "машинн", "python": "python", "я": "я", "новейшего": "нов", "новейше": "нов", "новость": "новос",
    "": "",
}


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_stems(spark):
    got = stem_ru.with_stem(spark.createDataFrame([(w,) for w in [*STEMS, None]], "term string"))
    assert {r["term"]: r["stem"] for r in got.collect()} == STEMS | {None: None}


def brute_stem(w: str) -> str:
    v = stem_ru.VOWELS
    at = [i for i, c in enumerate(w) if c in v]
    rv = at[0] + 1 if at else len(w)
    r1 = next((i + 1 for i in at if i >= 1), len(w))
    r2 = next((i + 1 for i in at if i >= r1 + 1), len(w))

    def strip(word, endings, least):
        for e in endings:
            if word.endswith(e) and len(word) - len(e) >= least:
                return word[: len(word) - len(e)]
        return word

    out = strip(w, stem_ru.ENDINGS, rv)
    for endings, region in stem_ru.LATER:
        out = strip(out, endings, rv if region == "rv" else r2)
    return out


def test_stems_equal_brute_force(spark):
    import random

    r = random.Random(5)
    words = ["".join(r.choice("аеиопвёстнйьюшющмгл") for _ in range(r.randint(1, 12))) for _ in range(800)]
    words += [w + e for w in ("нов", "прост", "ден", "крепк") for e in ("ость", "остьи", "остейш", "ейше", "остейшей", "ост")]
    got = stem_ru.with_stem(spark.createDataFrame([(w,) for w in words], "term string"))
    wrong = [(r["term"], r["stem"], brute_stem(r["term"])) for r in got.collect() if r["stem"] != brute_stem(r["term"])]
    assert not wrong


def test_stem_log_and_tokens(spark):
    tokens = spark.createDataFrame([(1, 0, "книга"), (1, 1, "книга"), (2, 0, "книга"), (2, 1, "я"), (2, 2, None)], "doc_id bigint, pos int, term string")
    assert rows(stem_ru.stem_log(tokens)) == [("книга", "книг"), ("книга", "книг")]
    assert rows(stem_ru.stem_log(tokens, distinct=True)) == [("книга", "книг")]
    assert rows(stem_ru.stem_tokens(tokens)) == [(1, 0, "книг"), (1, 1, "книг"), (2, 0, "книг"), (2, 1, "я")]


CASES = [
    ("Hello, World", {}, [("hello", 0), ("world", 1)]),
    ("state-of–the—art", {}, [("state", 0), ("of", 1), ("the", 2), ("art", 3)]),
    ("state-of-the-art", {"keep_hyphens": True}, [("state-of-the-art", 0)]),
    ("a–b", {"keep_hyphens": True}, [("a", 0), ("b", 1)]),
    ("Rock’n'roll dogs' 'x", {}, [("rock’n'roll", 0), ("dogs'", 1), ("x", 2)]),
    ("ﬁ Ⅳ ½", {}, [("fi", 0), ("iv", 1), ("1", 2), ("2", 3)]),
    ("7 cats 8", {"keep_numbers": False}, [("cats", 1), ("8", 2)]),
    ("7 cats 8", {"keep_numbers": False, "strict_numbers": True}, [("cats", 1)]),
    ("7-up", {"keep_numbers": False}, [("7", 0), ("up", 1)]),
    ("7\nup", {"keep_numbers": False}, [("up", 1)]),
    ("", {}, []),
    (None, {}, []),
]


@pytest.mark.parametrize("given,options,expected", CASES)
def test_tokenize(spark, given, options, expected):
    got = text.tokenize(docs(spark, given), **options).orderBy("pos").collect()
    assert [(r["term"], r["pos"]) for r in got] == expected


def test_stopwords_keep_gaps_and_match_exactly(spark):
    stop = spark.createDataFrame([("the",)], "word string")
    assert rows(text.tokenize(docs(spark, "the cat the"), stopwords=stop), "term", "pos") == [("cat", 1)]
    assert rows(text.tokenize(docs(spark, "The"), lowercase=False, stopwords=stop), "term", "pos") == [("The", 0)]


def test_ascii_tokenizer(spark):
    got = text.tokenize_ascii(docs(spark, "Ab_1 ж c" + "x" * 300, None))
    assert rows(got, "pos", "term") == [(0, "ab_1"), (1, ("c" + "x" * 300)[:255])]


def test_extra_columns_and_empty_table(spark):
    df = docs(spark, "a b").selectExpr("*", "1 AS pos", "'z' AS term")
    assert rows(text.tokenize(df), "doc_id", "pos", "term") == [(0, 0, "a"), (0, 1, "b")]
    assert text.tokenize(docs(spark, "a").limit(0)).count() == 0


def test_clean_lines(spark):
    given = "  text  \n\n== H ==\r\n{{tpl}}\n[[File:x]]\n[[Категория:x]]\n[[Category:x]]\n two words\u2028\u00a0three"
    got = docs(spark, given).select(clean.clean_text(F.col("text"))).first()[0]
    assert got == "text\ntwo words\nthree"
    kept = clean.clean(docs(spark, given, None, "", "one"), min_words=2)
    assert rows(kept, "doc_id", "word_count") == [(0, 4)]


def test_names_and_numbers(spark):
    df = spark.createDataFrame([("doc00012.txt",), ("doc7.tokens",), ("x.txt",), (None,)], "n string")
    assert [r[0] for r in df.select(text.document_number(df["n"])).collect()] == [12, 7, -1, -1]


def test_dedupe_and_ids(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None)], "doc_id bigint, sha1 string")
    assert rows(clean.dedupe(df), "doc_id") == [(1,), (2,), (4,), (5,)]
    old = spark.createDataFrame([("b",), (None,)], "sha1 string")
    kept = clean.dedupe(df, old)
    assert rows(clean.assign_ids(kept, "doc_id", 10), "doc_id", "new_id") == [(1, 10), (4, 11), (5, 12)]
    assert clean.dedupe(df.limit(0)).count() == 0
