from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from termloom.llm import lookalike, mixing, relevance, subjects, term_counts

from ..conftest import rows

POSTINGS = "segment_no int, term string, doc_id int, term_freq int, positions array<int>, score double, doc_freq int"


@pytest.fixture(scope="module")
def index_rows(spark):
    r = random.Random(2)
    data = []
    for d in range(120):
        data.append((0, "hot", d, 1 + d % 3, None, 0.0, 0))
        for t in r.sample(range(80), 3):
            data.append((0, f"t{t}", d, r.choice([None, 0, 2]), [1, 2], 0.0, 0))
    data += [(1, "hot", 4, 1, None, 0.0, 0), (0, None, 5, 1, None, 0.0, 0), (0, "lost", None, 1, None, 0.0, 0), (0, "void", 6, None, None, 0.0, 0), (0, "once", 999, 3, None, 0.0, 0)]
    return data, spark.createDataFrame(data, POSTINGS)


def cards_of(data):
    cards = {}
    for _, t, d, f, p, *_ in data:
        if t is not None and d is not None:
            cards[d, t] = max(cards.get((d, t), 0), f if (f or 0) > 0 else len(p or []))
    return cards


def test_scores_equal_brute_force(index_rows):
    data, df = index_rows
    cards = cards_of(data)
    freq, length = Counter(t for _, t in cards), defaultdict(int)
    for (d, _), f in cards.items():
        length[d] += f
    mean = sum(length.values()) / len(length)
    got = {(r["doc_id"], r["term"]): r for r in relevance.term_scores(df).collect()}
    assert got.keys() == cards.keys()
    for (d, t), f in cards.items():
        w = math.log(1 + (len(length) - freq[t] + 0.5) / (freq[t] + 0.5))
        assert got[d, t]["score"] == pytest.approx(w * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length[d] / mean)))
        assert got[d, t]["doc_freq"] == freq[t] and got[d, t]["doc_length"] == length[d]
    assert got[6, "void"]["score"] == 0
    assert rows(relevance.distinctive_terms(relevance.term_scores(df))) == sorted(((d, t) for (d, t), f in cards.items() if f >= 3 and freq[t] <= 5), key=repr)
    assert relevance.term_scores(df.limit(0)).count() == 0


def test_term_counts_equal_brute_force(spark, index_rows):
    data, df = index_rows
    cards = cards_of(data)
    runs = spark.createDataFrame([(0, 1, "hot", 9), (0, 1, "hot", 9), (1, 1, "hot", 3), (0, 2, "once", 2), (0, 2, "only", 1), (0, 3, None, 7)], "run_no int, token_rank bigint, token string, frequency bigint")
    vocabulary = spark.createDataFrame([(0, "hot", 1, 5, 0), (0, "hot", 1, None, 0), (1, "hot", 1, 2, 0), (0, "vonly", 1, 1, 0)], "segment_no int, term string, term_id int, doc_freq int, postings_offset bigint")
    got = {r["term"]: r for r in term_counts.term_counts(df, runs, vocabulary).collect()}
    assert got.keys() == {t for _, t in cards} | {"only", "vonly", "once"}
    for t in {t for _, t in cards}:
        mine = {d: f for (d, u), f in cards.items() if u == t}
        assert (got[t]["records"], got[t]["occurrences"]) == (len(mine), sum(mine.values()))
    assert got["hot"]["run_frequency"] == 12 and got["hot"]["stated_records"] == 7 and got["only"]["records"] == 0
    assert rows(term_counts.marked_terms(term_counts.term_counts(df, runs, vocabulary))) == [("hot", "common"), ("once", "rare"), ("only", "rare")]
    assert term_counts.term_counts(df.limit(0), runs.limit(0), vocabulary.limit(0)).count() == 0
    tiny = spark.createDataFrame([(0, "x", 1, 1, None, 0.0, 0)], POSTINGS)
    one = spark.createDataFrame([(0, 1, "x", 1)], "run_no int, token_rank bigint, token string, frequency bigint")
    assert rows(term_counts.marked_terms(term_counts.term_counts(tiny, one, vocabulary.limit(0)))) == [("x", "common"), ("x", "rare")]


# ----------------------------------------------------------------- look-alikes
TITLES = [
    (1, "Café Nova", "2026-01-01"), (2, "Cafe\u0301 Nova", "2026-01-01"), (3, "Саfé\u00a0Nova", None), (4, "Café Nova", "2026-01-01"), (5, "café Nova", "2026-01-01"),
    (6, "Зелёный", "2026-01-01"), (7, "Зеленый", "2026-01-01"), (8, None, "2026-01-01"), (9, "", "2026-01-01"), (10, "old", "2026-01-01"), (10, "Cаfé Nova", "2026-01-02"),
    (None, "Café Nova", None), (11, "x" * 50_000, None), (12, "х" * 50_000, None), (13, "Ｃafé Nova", "2026-01-01"), (13, "Ｃafé Nova", "2026-01-03"),
]


def test_same_looking_pages(spark):
    pages = spark.createDataFrame(TITLES, "id int, title string, processed_at string").selectExpr("id", "title", "cast(processed_at AS timestamp) AS processed_at", "1 AS class_id")
    group = {1: "a", 4: "a", 2: "b", 3: "c", 10: "d", 13: "e"}
    expected = [(a, b) for a in group for b in group if a < b and group[a] != group[b]] + [(11, 12)]
    assert rows(lookalike.same_looking_pages(pages)) == sorted(expected, key=repr)
    assert lookalike.same_looking_pages(pages.limit(0)).count() == 0


def test_normalise(spark):
    df = spark.createDataFrame([(1, "Nova"), (2, "Nоvа"), (3, "Nova"), (4, "ｘ\u200by"), (5, None), (6, "")], "id int, text string")
    assert rows(lookalike.normalise(df, "text"), "id", "text_normal") == [(1, "Nova"), (2, "Nova"), (3, "Nova"), (4, "xy"), (5, None), (6, "")] and lookalike.normalise(df.limit(0), "text").count() == 0
    hot = df.union(spark.createDataFrame([(i % 7, "Nоvа") for i in range(300)], "id int, text string"))
    assert rows(lookalike.normalise(hot, "text").groupBy("text", "text_normal").count().where("count > 1")) == [("Nova", "Nova", 2), ("Nоvа", "Nova", 301)]


def test_automaton():
    t = lookalike.Trie()
    for s in ("VI", "Ⅵ", "V\u00adІ", "VII", "vI", "VІ", "I"):
        t.add(s)
    reached = lambda s, bound=0: {t.ends[n]: c for n, c in lookalike.Automaton(s, bound).reach(t).items()}
    assert reached("VI") == reached("Ⅵ") == dict.fromkeys(("VI", "Ⅵ", "V\u00adІ", "VІ"), 0)
    assert reached("VI", 1) == dict.fromkeys(("VI", "Ⅵ", "V\u00adІ", "VІ"), 0) | dict.fromkeys(("VII", "vI", "I"), 1)
    assert reached("none") == {} and reached("X\u200bI", 1) == dict.fromkeys(("VI", "Ⅵ", "V\u00adІ", "VІ", "vI", "I"), 1)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@given(st.lists(st.text("aаbé\u0301e\u200bⅥVI", max_size=6), min_size=1, max_size=12), st.integers(0, 2))
def test_automaton_equals_edit_distance(spellings, bound):
    from termloom.llm.text import skeleton

    t = lookalike.Trie()
    for s in spellings:
        t.add(s)
    for s in spellings:
        want = {o: d for o in set(spellings) if (d := distance(skeleton(s), skeleton(o))) <= bound}
        assert {t.ends[n]: c for n, c in lookalike.Automaton(s, bound).reach(t).items()} == want


def test_classes_come_from_the_trie(spark):
    """Anagrams share a signature; only the traversal keeps them apart."""
    words = ["abc", "cab", "аbc", "ca\u200bb", "bca"]
    assert len({lookalike.signature(w) for w in words}) == 1
    df = spark.createDataFrame([(w,) for w in words], "text string")
    want = [("abc", "abc"), ("bca", "bca"), ("ca\u200bb", "cab"), ("cab", "cab"), ("аbc", "abc")]
    assert rows(lookalike.spelling_classes(df, "text"), "spelling", "class_id") == sorted(want, key=repr)
    whole = rows(lookalike.spelling_classes(df, "text"))
    assert rows(lookalike.spelling_classes(df, "text", block_strings=2)) == whole


def test_many_spellings_of_one_title(spark):
    import itertools

    same = ["".join(p) + "x" for p in itertools.product(*[("a", "а"), ("c", "с"), ("e", "е"), ("o", "о", "ο"), ("p", "р")] * 2)][:1500]
    df = spark.createDataFrame([(w, 1) for w in same] + [("other", 1)] * 3, "text string, n int")
    got = lookalike.spelling_classes(df, "text", block_strings=200).collect()
    assert {(r["class_id"], r["n_spellings"]) for r in got} == {(min(same), 1500), ("other", 1)}
    assert rows(lookalike.normalise(df, "text").select("text_normal").distinct()) == [(same[0],), ("other",)]


# ---------------------------------------------------------------------- mixing
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=12), st.integers(1, 400))
def test_pfair_deviates_less_than_a_block(parts, n):
    weights = {f"s{i}": p / sum(parts) for i, p in enumerate(parts)}
    blocks = {s: math.floor(w * n) + 1 for s, w in weights.items()}
    slots = mixing.pfair_slots(weights, blocks)
    assert Counter(s for s, _ in slots) == blocks
    seen = Counter()
    for t, (s, j) in enumerate(slots, 1):
        seen[s] += 1
        assert j == seen[s]
        if t <= n:  # as long as no source has run out
            assert all(abs(seen[k] - w * t) < 1 + 1e-6 for k, w in weights.items() if all(seen[x] < blocks[x] for x in blocks))


def mix_tables(spark):
    r = random.Random(4)
    docs = []
    for i in range(600):
        source = r.choice(["Big ", "big", "\tBIG", "small", None, "other"]) if i % 40 else "small"
        docs.append((i, " ".join(["слово", "w0rd", "½x"][: r.randint(0, 3)] * r.randint(1, 4)) if i % 50 else None, source, 1))
    targets = [("big", 0.5, 2), ("small", 0.3, 3), ("absent", 0.15, 2), ("other", 0.05, 1)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, source string, size int"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), docs


def test_mix(spark):
    import regex

    df, targets, docs = mix_tables(spark)
    size = defaultdict(int)
    for _, t, s, _ in docs:
        if s is not None:
            size[s.strip().lower()] += len(regex.findall(r"[\p{L}\p{N}]+", t or ""))
    total = sum(size.values())
    sizes = mixing.written_sizes(df)
    plan = {r["source"]: r for r in mixing.source_plan(sizes, targets).collect()}
    assert plan["big"]["size"] == size["big"] and plan["small"]["factor"] == pytest.approx(0.3 * total / size["small"])
    assert plan["absent"]["outcome"] == "short" and plan["other"]["outcome"] == "enough"
    everything = {n: {(r["doc_id"], r["copy"]) for r in mixing.mix(sizes, targets, n, 4).collect()} for n in (1, 7, 50, 2048)}
    assert len({frozenset(x) for x in everything.values()}) == 1
    mixed = mixing.mix(sizes, targets, n_blocks=50, n_chunks=4)
    taken = mixed.collect()
    assert len({(r["doc_id"], r["copy"]) for r in taken}) == len(taken)
    got = defaultdict(int)
    for r in taken:
        got[r["source"]] += r["size"]
        assert r["copy"] < plan[r["source"]]["repeats"]
    for s in ("big", "small", "other"):
        assert plan[s]["planned_size"] <= got[s] + 1e-6 < plan[s]["planned_size"] + 12
    report = {r["source"]: r for r in mixing.mix_report(sizes, targets, mixed).collect()}
    assert sum(r["actual_share"] for r in report.values()) == pytest.approx(1) and report["absent"]["taken_rows"] == 0
    assert report["small"]["copies"] == math.ceil(report["small"]["repeats"])
    expected = [(s, r["outcome"]) for s, r in plan.items() if r["outcome"] != "enough"]
    assert rows(mixing.outcomes(mixing.mix_report(sizes, targets, mixed))) == sorted(expected, key=repr)


def test_mix_of_nothing(spark):
    df, targets, _ = mix_tables(spark)
    none = mixing.written_sizes(df.limit(0))
    assert mixing.mix(none, targets).count() == 0 and mixing.mix(mixing.written_sizes(df), targets.limit(0)).count() == 0
    assert rows(mixing.outcomes(mixing.mix_report(none, targets, mixing.mix(none, targets)))) == [("absent", "short"), ("big", "short"), ("other", "short"), ("small", "short")]


# -------------------------------------------------------------------- subjects
NOUNS = {"law": "court statute appeal witness lawsuit verdict".split(), "music": "violin choir melody orchestra rhythm opera".split(), "sport": "match league goal trainer stadium final".split()}


def corpus(n=240, seed=6):
    r = random.Random(seed)
    names = list(NOUNS)
    docs, truth = [], {}
    for i in range(n):
        a, b = r.sample(names, 2)
        two = i % 6 == 0
        sents = []
        for k in range(12):
            w = r.sample(NOUNS[b if two and k % 2 else a], 2)
            sents.append(f"The {w[0]} depends on the {w[1]} and in part on the weather of the day.")
        sents[3] = "Entry was 20 coins or 5 notes a head for all who came."
        docs.append((i, "Title\n\n" + " ".join(sents)))
        truth[i] = {a, b} if two else {a}
    return docs, truth


def test_subjects_on_held_out_documents(spark):
    docs, truth = corpus()
    docs += [(1000, None), (1001, ""), (1002, "T\n\n" + "\n".join(f"{i};court;violin" for i in range(40))), (1003, "T\n\nEntry was 20 coins or 5 notes a head for all who came.")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, subject string")
    labels = spark.createDataFrame([(i, s) for i in range(0, 240, 3) for s in truth[i]] * 2 + [(99999, "law"), (None, "law"), (1, None), (4, "cooking")], "doc_id bigint, subject string")
    known = spark.createDataFrame([(i, s) for i, s in enumerate([*NOUNS, None])], "subject_id int, subject string")
    got = defaultdict(set)
    for r in subjects.document_subjects(df, labels, known).collect():
        got[r["doc_id"]].add(r["subject"])
    held_out = [i for i in range(240) if i % 3]
    assert sum(got[i] == truth[i] for i in held_out) >= 0.95 * len(held_out)
    assert not any(got[i] for i in (1000, 1001, 1002, 1003))


def test_subjects_without_labels(spark):
    df = spark.createDataFrame(corpus(12)[0], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, subject string")
    known = spark.createDataFrame([(1, "law")], "subject_id int, subject string")
    assert subjects.document_subjects(df, labels, known).count() == 0
    assert subjects.document_subjects(df.limit(0), labels, known.limit(0)).count() == 0
