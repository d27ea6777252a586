from __future__ import annotations

import random

import pytest

from termloom.llm import leakage, markup, quality, subjects
from termloom.llm.text import fold_word, plain, skeleton

from ..conftest import rows

PROSE = "The court depends on the statute and in part on the appeal. By the end of 1914 the fine had become a familiar sight. "


def docs(spark, *texts):
    data = [(i, t, "x", [1]) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id bigint, text string, kinds string, words array<int>")


# ---------------------------------------------------------------- characters
def test_skeleton():
    same = ["Café Nova-1", "Cafe\u0301 Nova-1", "Саfé Νоvа-1", "Ｃａｆé\u2009Nova‐1", "Ca\u00adfé\u00a0No\u200bva\u20111"]
    assert len({skeleton(s) for s in same}) == 1
    for a, b in (("ё", "е"), ("й", "и"), ("A", "a"), ("x y", "xy"), ("«a»", '"a"'), ("к", "k")):
        assert skeleton(a) != skeleton(b)
    assert skeleton("Ⅵ") == skeleton("VI") and skeleton("е\u0308") == skeleton("ё") == skeleton("ë")


def test_fold_word():
    assert fold_word("НОЧЬ") == fold_word("ночь") == fold_word("HOЧЬ")
    assert fold_word("Für") == fold_word("fur") and plain("a\u200bｂ") == "ab"


# --------------------------------------------------------------------- markup
KINDS = [
    ("<p>x</p>", ["html"]), ("a &nbsp; b", ["html"]), ("&lt;div&gt;x&lt;/div&gt;", ["html"]), ("<!-- todo -->", ["html"]), ("x<BR>y", ["html"]),
    ("# Head\nx", ["markdown"]), ("a **b** c", ["markdown"]), ("```py\nload(x)\n```", ["markdown"]), ("[a](http://b)", ["markdown"]),
    ("| a | b |\n|---|:--|\n| 1 | 2 |", ["markdown"]), ("- [x] done", ["markdown"]), ("a ~~b~~ __c__", ["markdown"]), ("use `x` here", ["markdown"]),
    ("== H ==", ["wiki"]), ("[[a|b]]", ["wiki"]), ("{{Box\n| a = 1\n}}", ["wiki"]), ("'''x'''", ["wiki"]), ("{| class=\"w\"\n|-\n| 1\n|}", ["wiki"]), ("[https://a.b c]", ["wiki"]),
    ("\\section{A}", ["latex"]), ("{\\it x}", ["latex"]), ("$\\alpha_7 \\le x$", ["latex"]), ("\\(x_{1} > y\\)", ["latex"]), ("a.~\\ref{t}", ["latex"]),
    ("If x < 5 and y > 3", []), ("20 $ or 5 $ a head", []), ("note [4] and {1, 2, 3} and [4; 9]", []), ("file report_final_2 kept", []), ("- a\n- b\n* c\n• d", []),
    ("5 * 3 metres, ~10 degrees, 2^10 = 1024, # and & signs", []), ("1. a\n2) b", []), ("a | b | c", []), ("", []), ("Smith & sons; x", []),
    ("<b>x</b> and \\emph{y}", ["html", "latex"]), ("**x** and [[y]]", ["markdown", "wiki"]),
]


@pytest.mark.parametrize("text,expected", KINDS)
def test_kinds(text, expected):
    assert markup.kinds(text) == expected


def test_clean_keeps_structure():
    html = markup.clean("<h2 id=s>Head</h2><p>One <b>two</b>&nbsp;three.</p><ul><li>a<li>b</ul><pre><code>if x &lt; 3:\n    y</code></pre>")
    assert "## Head" in html and "One two three." in html.replace("\xa0", " ") and "- a\n- b" in html and "```\nif x < 3:\n    y\n```" in html and "<" not in html.replace("x < 3", "")
    tex = markup.clean("\\section{Head}\n{\\it a} \\emph{b}\\footnote{see 2}\n\\[ x^{2} \\]\n\\begin{itemize}\n\\item a\n\\end{itemize}")
    assert "## Head" in tex and "$$ x^{2} $$" in tex and "- a" in tex and "\\" not in tex and "a b" in tex
    wiki = markup.clean("== Head ==\n[[a|b]] '''c'''\n{{Box\n| d = 1\n}}\n[[Category:x]]\n{| class=\"w\"\n! A\n|-\n| 1\n|}")
    assert "## Head" in wiki and "b c" in wiki and "d: 1" in wiki and "Box" not in wiki and "Category" not in wiki and "{|" not in wiki
    md = markup.clean("# Head\n**a** [b](http://c) `d`\n```py\n**raw**\n```\n* x")
    assert "# Head" in md and "a b d" in md and "**raw**" in md and "- x" in md


def test_no_span_is_too_long_and_no_nesting_too_deep():
    code = "a   b\n**x** {{y}}\n" * 60_000
    got = markup.clean(f"<b>z</b> <pre>{code}</pre>")
    assert got == "z \n```\n" + code.strip("\n") + "\n```"
    formula = "x_{1} + " * 1_300 + "y"
    for text in (f"a $${formula}$$ b", f"a ${formula}$ b", f"a \\[{formula}\\] b"):
        assert markup.kinds(text) == ["latex"] and formula in markup.clean(text)
    assert markup.clean("<script>" + "x < 3; " * 20_000 + "</script>a<!--" + "b " * 9_000 + "-->") == "a"
    assert markup.clean("{{t|" * 10 + "deep" + "}}" * 10) == "deep" and markup.clean("{{t|" * 50_000 + "deep" + "}}" * 50_000) == "deep"
    assert markup.clean("\\emph{" * 50_000 + "deep" + "}" * 50_000) == "deep" and markup.clean("[[File:a.jpg|thumb|A [[b|c]] d]]") == "A c d"


def test_each_language_only_where_it_was_found():
    assert markup.clean("This is **bold** in C:\\Users\\bob\\notes today.") == "This is bold in C:\\Users\\bob\\notes today."
    assert markup.clean("<b>a</b> **e \\x") == "a **e \\x" and markup.clean("[[c|d]]x **e \\x {y}") == "dx **e \\x {y}"
    assert markup.clean("\\emph{a} \\unknown {1, 2} M\\\"uller 5 \\% \\ldots") == "a \\unknown {1, 2} Müller 5 % …"
    assert markup.clean("**a** \ue0000\ue000 `**b** [[c]]`") == "a \ue0000\ue000 **b** [[c]]"


def test_values_and_cells_stay():
    assert markup.clean("{{Box\n| name = Jena\n| of = [[a|b]] c\n| none =\n}}\nText {{lang|la|homo}}.").split("\n") == ["name: Jena", "of: b c", "", "Text la homo."]
    assert markup.clean('{|\n|+ Cap\n! A !! B\n|-\n| style="x" | 1 || 2\n|-\n| 3\n| 4\n5\n|}\nafter') == "Cap\nA | B\n1 | 2\n3 | 4 5\nafter"
    assert markup.clean("\\begin{tabular}{ll} a & b \\\\ c & d \\end{tabular}") == "a | b \n c | d"
    assert markup.clean("<table><tr><td>1</td> <td>2</td></tr><tr><th>3<th>4</table>") == "1 | 2\n\n3 | 4"
    assert markup.clean("{| open\n| x\n[[y]]") == "{| open\n| x\ny"


UNPAIRED = [
    "__a ", "\n", " \n", "**a ", "\\[ x ", "$a_b ", "<!-- ", "<pre> ", "[[a ", "{{a ", "== a ", "'''a ", "| ", "`a ", "!. ", "<a ", "\\begin{align} ", "- [ ] ", " ",
    "{{a|b=", "[[a|", "\\emph{", "{\\it ", "\\cmd[", "$$ x ", "\\( x\n\n", "<ref>", "<nowiki>", "<td>", "```x\n", "\n| a=b ", "a=b", "\n== a", "}} ]] ", "``` ` ``", "{|\n", "\n|}", "<h2>\n",
]


@pytest.mark.parametrize("unit", UNPAIRED)
def test_unpaired_marks_take_linear_time(unit):
    import time

    text = "<b>x</b> **y** [[z]] \\emph{w}\n" + unit * (200_000 // len(unit))
    start = time.process_time()
    markup.clean(text)
    quality.measure("T\n\n" + text)
    assert time.process_time() - start < 8


def test_clean_table_operator(spark):
    long = "<p>" + "word " * 200_000 + "</p>"
    got = {r["doc_id"]: r for r in markup.clean_documents(docs(spark, "plain", None, "", long, "plain")).collect()}
    assert [list(got[i]["kinds"]) for i in range(5)] == [[], [], [], ["html"], []]
    assert got[0]["clean_text"] == "plain" and got[1]["clean_text"] is None and got[2]["clean_text"] == "" and "<" not in got[3]["clean_text"]
    assert rows(markup.markup_kinds(markup.clean_documents(docs(spark, "a **b** [[c]]")))) == [(0, "markdown"), (0, "wiki")]
    assert markup.clean_documents(docs(spark, "x").limit(0)).count() == 0


# -------------------------------------------------------------------- quality
NOT_PROSE = {
    "list": "\n".join(f"{i}. Gisejull ({1800 + i})" for i in range(30)),
    "bullets": "\n".join("• Gedul Kural" for _ in range(30)),
    "table": "\n".join(f"{1900 + i};87.55;63.29;80.61" for i in range(30)),
    "index": "\n".join(f"der Kredit, {i}, {i + 30}, 311" for i in range(30)),
    "navigation": "\n".join("Help Edit Catalogue Sections Top" for _ in range(30)),
    "encoded": "\n".join("8b7acd7c9be349df4fbce9dfd96be7ecd37ac21358e45100382e69ff167a695b" for _ in range(20)),
    "gibberish": "mgpzhsfzvp kttgxfvsqj wtczc dxpgdnhnvcbl dlwrps " * 20,
}
PROSES = {
    "plain": PROSE * 6,
    "broken lines": (PROSE * 6).replace(" the ", "\nthe "),
    "html": "".join(f"<p>{PROSE}</p>\n" for _ in range(5)),
    "short list": PROSE * 5 + "\n- one\n- two\n- three",
    "wide letters": (PROSE * 5).replace("e", "ｅ").replace("o", "о"),
    "russian": "Такая форма иска встречается редко, поэтому суд изучается отдельно. Кодекс зависит от штрафа и отчасти от иска. " * 5,
}


@pytest.mark.parametrize("name", NOT_PROSE)
def test_not_prose(name):
    m = dict(zip(quality.COLUMNS, quality.measure("Title\n\n" + NOT_PROSE[name])))
    assert m["prose_share"] < 0.5 and m["kind"] != "prose"
    one = dict(zip(quality.COLUMNS, quality.measure(f"Title\n\n{PROSE}\n{NOT_PROSE[name]}")))
    assert one["prose_share"] < 0.5


@pytest.mark.parametrize("name", PROSES)
def test_prose(name):
    m = dict(zip(quality.COLUMNS, quality.measure("Title\n\n" + PROSES[name])))
    assert m["prose_share"] > 0.8 and m["kind"] == "prose"


MENUS = {
    "en": "Help Menu More Edit Talk\nHome About More Search Login Top\n",
    "ru": "Меню Ещё Правка Печать\nПомощь Поиск Ещё Войти Разделы\n",
    "de": "Start Nur Neu Über Hilfe\nMehr Noch Oben Suche Anmelden\n",
}


@pytest.mark.parametrize("lang", MENUS)
@pytest.mark.parametrize("mark", ["", "…", "\n"])
def test_repeated_menu(lang, mark):
    """Lines, paragraphs or 3-grams that repeat without sentences are no prose, whatever their labels."""
    menu = "".join(f"{line}{mark}\n" for line in MENUS[lang].splitlines()) * 12
    for body in (menu, f"{PROSE}\n{menu}", menu.replace("\n", " ")):
        assert dict(zip(quality.COLUMNS, quality.measure("T\n\n" + body)))["prose_share"] < 0.5


SALAD = "Ziwi Jotuth Tobozem die Währung Wohoru Zelistad das Spektrum Jusam der Markt Bawa das Tal die Weide Kebill der Kredit Gebith die Messung Banill "


@pytest.mark.parametrize("end", [" ", ". "])
def test_articles_alone_are_no_prose(end):
    salad = (SALAD.strip() + end) * 12
    short = " ".join(f"der Fürst Zihu{a} das Tal Bawa{b}{end}" for a in "abcdefgh" for b in "klmn")
    for body in (salad, short, f"Für die Prüfung der Währung sind meist mindestens 27 Schritte nötig.\n{salad}"):
        m = dict(zip(quality.COLUMNS, quality.measure("T\n\n" + body)))
        assert m["common_word_share"] > 0.15 and m["prose_share"] < 0.5 and m["kind"] == "junk"
        assert not subjects.sentences("T\n\n" + body)[0]


def test_sentences_with_articles_alone():
    """They count in a body of prose and as a body; prose without sentence ends stays prose."""
    bare = "The lemma determines the theorem. "
    assert all(good for *_, good in quality.pieces(PROSE + bare)) and quality.pieces(bare)[0][3]
    run_on = "we were in the harbour before it was light and there they had left some boats which nobody wanted because of the storm that came over night"
    assert quality.pieces(run_on)[0][3]


FOREIGN = {
    "fr": "Le tribunal a rendu sa décision au début de l'année, après de longs débats entre les parties. Les avocats avaient présenté plusieurs arguments sur la validité du contrat. La cour a finalement rejeté la demande et condamné le plaignant aux dépens. ",
    "es": "La ciudad fue fundada por los romanos en el siglo primero y conserva todavía parte de sus murallas. Durante muchos años fue un centro importante de comercio, pero su población disminuyó después de la guerra. ",
    "it": "La città sorge sulla riva destra del fiume, ai piedi di una collina coperta di boschi. Nel medioevo era famosa per la lavorazione della lana, che veniva esportata in tutta Europa. ",
}


@pytest.mark.parametrize("lang", FOREIGN)
def test_prose_of_other_languages(lang):
    assert dict(zip(quality.COLUMNS, quality.measure("T\n\n" + FOREIGN[lang])))["kind"] == "prose"
    menu = "Accueil\nNos dossiers et plus\nQui sommes nous\nContact et plan\n" * 30
    names = "\n".join(f"{a} {b}." for a in "Paris Lyon Nice Lille Metz Brest".split() for b in "Nord Sud Est Ouest Haut Bas".split())
    for other in (menu, menu.replace("\n", ". "), names, "la le du de et un. " * 60):
        assert dict(zip(quality.COLUMNS, quality.measure(f"T\n\n{FOREIGN[lang]}\n{other}")))["prose_share"] < 0.5


def test_menu_of_function_words():
    menu = "Home and the news\nAbout us and you\nHelp for all of you\nContact or find us\n" * 50
    for body in (menu, menu.replace("\n", " "), menu.replace("\n", ". ")):
        assert dict(zip(quality.COLUMNS, quality.measure("T\n\n" + body)))["prose_share"] < 0.5


def test_one_line_is_a_body():
    assert quality.measure(PROSE)[-1] == "prose" and quality.measure("Title\n \n")[1] == 1 and quality.split_title("a\n\nb") == ("a", "\nb")


def test_statistics():
    m = dict(zip(quality.COLUMNS, quality.measure("T\n\nThe cat sat.\nThe cat sat.\nA1 %")))
    assert m["n_words"] == 8 and m["n_lines"] == 3 and m["punctuated_line_share"] == pytest.approx(2 / 3)
    assert m["duplicate_line_share"] == pytest.approx(12 / 28) and m["digit_share"] == pytest.approx(1 / 23) and m["symbol_share"] == pytest.approx(3 / 23)
    assert m["top_ngram_share"] > 0 and m["mean_word_length"] == pytest.approx((3 * 6 + 2 + 1) / 8)


def test_quality_operator(spark):
    long = "T\n\n" + PROSE * 3000
    got = {r["doc_id"]: r for r in quality.text_quality(docs(spark, "T\n\n" + PROSE, None, "", " \n ", long, "T\n\n" + NOT_PROSE["table"])).collect()}
    assert got[1]["kind"] == got[2]["kind"] == got[3]["kind"] == "empty" and got[4]["kind"] == "prose"
    pages = spark.createDataFrame(
        [(1, 0, 22, "2026-01-01"), (1, 0, 99, "2026-01-02"), (2, 4, None, None), (3, 5, -1, None), (9, None, 5, None)], "id int, doc_id int, word_count int, processed_at string"
    ).selectExpr("id", "doc_id", "word_count", "cast(processed_at AS timestamp) AS processed_at", "1 AS kind")
    q = quality.text_quality(docs(spark, "T\n\n" + PROSE, None, "", " \n ", long, "T\n\n" + NOT_PROSE["table"]))
    assert rows(quality.compare_word_counts(q, pages.select("id", "doc_id", "word_count", "processed_at")), "doc_id", "word_count_state") == [
        (0, "outdated"), (1, "missing"), (2, "missing"), (3, "missing"), (4, "missing"), (5, "impossible")
    ]
    assert rows(quality.not_prose(q)) == [(5,)]
    assert quality.text_quality(docs(spark, "x").limit(0)).count() == 0


# -------------------------------------------------------------------- leakage
def brute_leaks(texts, items, n):
    out = set()
    words = {i: [fold_word(w) for w in leakage.words_of(t)] for i, t in items}
    for d, t in texts:
        own = [fold_word(w) for w in leakage.words_of(t)]
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        out |= {(d, i) for i, w in words.items() if any(tuple(w[k : k + n]) in grams for k in range(len(w) - n + 1))}
    return out


def test_leaks_equal_brute_force(spark):
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(14)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(3, 30)))) for i in range(25)]
    texts = []
    for d in range(120):
        body = r.choices([*vocabulary, "zz"], k=r.randint(0, 60))
        if d % 3 == 0:
            w = r.choice(items)[1].split()
            a = r.randrange(len(w))
            body[5:5] = w[a : a + r.randint(8, 14)]
        texts.append((d, " ".join(body)))
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    table = spark.createDataFrame(items, "item_id bigint, text string")
    expected = sorted(brute_leaks(texts, items, 6))
    assert expected
    assert rows(leakage.find_leaks(df, table, 6, 3), "doc_id", "item_id") == sorted(expected, key=repr)
    assert rows(leakage.find_leaks(df, table, 6, 6, max_block_words=40), "doc_id", "item_id") == sorted(expected, key=repr)


ITEM = "Ferryman Gimul carried 2993 guests yet one ancient ticket once reached Nijevar. Question: how many deeds are named and who is it?"


def test_leaks_put_marks_and_signs_aside(spark):
    words = ITEM.split()
    hidden = [
        ITEM.upper(), ITEM.replace(" ", "\n"), ITEM.replace("a", "а").replace("o", "ο"), " ".join(f"<b>{w}</b>" for w in words), ITEM.replace("e", "e\u00ad"),
        " ".join(words[:10]), ITEM.replace(".", ";"), " ".join(f"[[x|{w}]]" if w.isalpha() else w for w in words),
    ]
    clear = [" ".join(words[:9]), " ".join(sorted(words)), None, "", "word " * 50_000]
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (None, ITEM), (3, "short")], "item_id bigint, text string")
    got = leakage.find_leaks(docs(spark, *hidden, *clear), items)
    assert rows(got, "doc_id", "item_id") == [(i, 1) for i in range(len(hidden))]
    assert leakage.find_leaks(docs(spark, ITEM), items.limit(0)).count() == 0
    assert leakage.find_leaks(docs(spark, ITEM).limit(0), items).count() == 0


def test_tiles_cover_reordered_parts(spark):
    w = ITEM.split()
    text = " ".join(w[11:]) + " zzz " + " ".join(w[:11])
    row = leakage.find_leaks(docs(spark, text), spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")).first()
    assert row["tiles"] == 2 and row["covered_words"] == row["item_words"] == len(w) and row["coverage"] == 1.0 and row["longest_run"] == 11


def test_texts_of_one_item_and_blocks(spark):
    """The best of an item's texts counts; blocks give what one block gives."""
    items = spark.createDataFrame([(1, ITEM), (1, "other words that stand here for the same item id and are not found"), (2, ITEM + " and more"), (3, "x y z")], "item_id bigint, text string")
    df = docs(spark, ITEM, "nothing", None, ITEM + " and more of it")
    whole = rows(leakage.find_leaks(df, items, min_coverage=0.5))
    assert [x[:2] for x in whole] == [(0, 1), (0, 2), (3, 1), (3, 2)]
    assert rows(leakage.find_leaks(df, items, min_coverage=0.5, max_block_words=3)) == whole


def test_tiles_do_not_overlap():
    item = [1, 2, 3, 1, 2, 3, 1, 2, 3]
    ix = leakage.ItemIndex([(1, "a b c a b c a b c")], 3)
    assert leakage.leaks_of("a b c a b c x a b c".split(), ix, 3)[0][1:4] == (6, 2, 9)
    assert leakage.seed_hashes(item, 3)[0] == leakage.seed_hashes(item, 3)[3]


def test_reordered_clauses(spark, tmp_path):
    """Clauses of 5 to 9 words in another order are found by coverage, and are no case of p8_found."""
    from termloom.llm import queries

    item = "the old miller counted seven barrels twice while grey geese crossed the frozen harbour slowly before anyone lit the second brass lantern"
    w = item.split()
    moved = f"Now {' '.join(w[15:])}. Then {' '.join(w[7:15])}, so {' '.join(w[:7])}."
    far = f"Now {' '.join(w[15:20])}."
    docs(spark, moved, item + ". Again " + " ".join(w[:7]), far).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    got = queries.p8_leaks(spark, str(tmp_path))
    assert rows(got, "doc_id", "longest_run", "tiles", "covered_words") == [(0, 8, 3, 22), (1, 22, 1, 22)]
    assert rows(queries.p8_found(spark, str(tmp_path))) == [(1, 1)]


def test_short_tiles_count_for_coverage():
    ix = leakage.ItemIndex([(1, "a b c d e f g h i j k l m n o p")], 5)
    assert leakage.leaks_of("a b c d e f g h i j x l m n o p".split(), ix, 10)[0][1:4] == (10, 2, 15)
