"""SQL twins of this subpackage's queries, for DuckDB on the same tables."""

from __future__ import annotations

import unicodedata

# rows as they should read; repeated (term, doc_id) rows merged
CARDS = """
cards AS (
  SELECT doc_id, term,
         max(greatest(CASE WHEN term_freq > 0 THEN term_freq ELSE coalesce(len(positions), 0) END, 0))::BIGINT AS tf
  FROM postings WHERE term IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id, term
)"""

SIZES = r"""
sizes AS (
  SELECT lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) AS source,
         coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}]+')), 0)::BIGINT AS size
  FROM documents WHERE source IS NOT NULL
),
plan AS (
  SELECT t.source, t.target_share, t.max_repeats, coalesce(s.documents, 0)::BIGINT AS documents, coalesce(s.size, 0)::BIGINT AS size,
         CASE WHEN s.size > 0 THEN t.target_share * (SELECT sum(size) FROM sizes) / s.size END AS factor
  FROM (SELECT lower(trim(source)) AS source, sum(target_share) AS target_share, max(max_repeats) AS max_repeats FROM mix_targets GROUP BY 1) t
  LEFT JOIN (SELECT source, count(*) AS documents, sum(size) AS size FROM sizes GROUP BY source) s USING (source)
),
judged AS (
  SELECT *, CASE WHEN (factor IS NULL AND target_share > 0) OR factor > max_repeats THEN 'short'
                 WHEN factor > 1 THEN 'repeat' ELSE 'enough' END AS outcome
  FROM plan
)"""

COUNTS = """
postings_of AS (
  SELECT term, doc_id, max(CASE WHEN term_freq > 0 THEN term_freq ELSE coalesce(len(positions), 0) END)::BIGINT AS tf
  FROM postings WHERE term IS NOT NULL AND doc_id IS NOT NULL GROUP BY term, doc_id
),
counted AS (SELECT term, count(*)::BIGINT AS records, sum(tf)::BIGINT AS occurrences FROM postings_of GROUP BY term),
runs AS (
  SELECT term, sum(frequency)::BIGINT AS run_frequency
  FROM (SELECT DISTINCT run_no, token AS term, frequency FROM token_freq WHERE token IS NOT NULL) GROUP BY term
),
stated AS (
  SELECT term, sum(df)::BIGINT AS stated_records
  FROM (SELECT segment_no, term, max(doc_freq) AS df FROM vocabulary WHERE term IS NOT NULL GROUP BY segment_no, term) GROUP BY term
),
joined AS (
  SELECT term, coalesce(occurrences, 0)::BIGINT AS occurrences, coalesce(records, 0)::BIGINT AS records, run_frequency, stated_records,
         coalesce(run_frequency <= 2, false) AS is_rare,
         coalesce(records, 0) > 0.5 * (SELECT count(DISTINCT doc_id) FROM postings) AS is_common
  FROM counted FULL JOIN runs USING (term) FULL JOIN stated USING (term)
)"""

# Characters drawn alike, an own table: Latin letters with the others drawn like them. DuckDB
# composes but knows no compatibility forms, so those that occur are listed as well.
ALIKE = {
    "a": "аα", "c": "с", "d": "ԁ", "e": "е", "h": "һ", "i": "іι", "j": "ј", "l": "ӏ", "o": "оο", "p": "рρ", "q": "ԛ", "s": "ѕ", "v": "ν", "w": "ԝ", "x": "х", "y": "у",
    "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ",
}
ACCENTED = "éёüöäйÉЁÜÖÄЙ"
DASHES = "‐‑﹣－"
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
JOINED = {"Ⅰ": "I", "Ⅱ": "II", "Ⅲ": "III", "Ⅳ": "IV", "Ⅴ": "V", "Ⅵ": "VI", "Ⅶ": "VII", "Ⅷ": "VIII", "Ⅸ": "IX", "Ⅹ": "X", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff"}


def _quoted(s: str) -> str:
    return s.replace("'", "''")


def _plain(column: str) -> str:
    """Without invisible characters, with plain spaces, hyphens and letter forms."""
    sql = f"regexp_replace({column}, '[\\x{{ad}}\\x{{200b}}-\\x{{200f}}\\x{{2060}}-\\x{{2064}}\\x{{feff}}\\x{{fe00}}-\\x{{fe0f}}]', '', 'g')"
    sql = f"regexp_replace({sql}, '[\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', ' ', 'g')"
    for k, v in JOINED.items():
        sql = f"replace({sql}, '{k}', '{v}')"
    return f"nfc_normalize(translate({sql}, '{_quoted(WIDE)}{DASHES}', '{_quoted(NARROW)}{'-' * len(DASHES)}'))"


def _form(column: str) -> str:
    """The same for all strings that look the same: accents are taken apart, as
    their letters may be look-alikes, and composed again."""
    sql = _plain(column)
    for k in ACCENTED:
        sql = f"replace({sql}, '{unicodedata.normalize('NFC', k)}', '{unicodedata.normalize('NFD', k)}')"
    return f"nfc_normalize(translate({sql}, '{''.join(ALIKE.values())}', '{''.join(k * len(v) for k, v in ALIKE.items())}'))"


CASED = {"b": "вβ", "e": "ε", "z": "ζ", "h": "нη", "k": "кκ", "m": "мμ", "v": "ν", "t": "тτ", "y": "υ", "x": "χ"}  # small letters whose capitals look alike


def _words(column: str) -> str:
    """Words of a text for matching, by plain replacements of markup."""
    sql = f"regexp_replace({_plain(column)}, '[\\x{{300}}-\\x{{36f}}]', '', 'g')"
    for pattern, by in (
        (r"(?is)<(script|style|head)\b[^<>]*>.*?</(script|style|head)\s*>|<!--.*?-->", ""),
        (r"(?i)</?(?:br|hr|p|div|ul|ol|li|table|tr|td|th|h[1-6]|pre)(?:\s[^<>]*|\s*/)?>|&[a-zA-Z]+;|&#\d+;", " "),
        (r"</?[a-zA-Z][^<>]*>", ""),
        (r"\[\[(?:Category|Категория|Kategorie):[^\[\]]*\]\]|\\(?:footnote|cite|label)\{[^{}]*\}|[~ ]?\\(?:eq)?ref\{[^{}]*\}", ""),
        (r"\[\[(?:[^\[\]]*\|)?([^\[\]|]*)\]\]", r"\1"),
        (r"\[https?://[^\s\]]+ ?([^\]\n]*)\]|!?\[([^\[\]\n]*)\]\([^()\s]+\)", r"\1\2"),
        (r"\\(?:emph|textbf|textit)\{([^{}]*)\}|\{\\it ([^{}]*)\}", r"\1\2"),
        (r"\\[a-zA-Z]+", " "),
        (r"\*\*|~~|'''''|'''|''|`", ""),
    ):
        sql = f"regexp_replace({sql}, '{_quoted(pattern)}', '{by}', 'g')"
    small = "".join(v for t in (ALIKE, CASED) for k, v in t.items() if k.islower())
    latin = "".join(k * len(v) for t in (ALIKE, CASED) for k, v in t.items() if k.islower())
    folded = f"translate(translate(strip_accents(lower({sql})), '{small}', '{latin}'), 'n', 'v')"
    return rf"regexp_extract_all({folded}, '[\p{{L}}\p{{N}}]+')"


def _markup() -> str:
    """CTEs that end in ``marked`` (doc_id, html, latex, markdown, wiki)."""
    from .markup import COMMANDS, TAGS

    tag = rf"</?(?:{'|'.join(sorted(TAGS, key=len, reverse=True))})(?:\s[^<>]*|\s*/)?>"
    entity = "&(?:[a-zA-Z][a-zA-Z0-9]{1,30}|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});"
    held = r"<pre\b[^<>]*>.*?</pre\s*>|<script\b[^<>]*>.*?</script\s*>|<style\b[^<>]*>.*?</style\s*>|<!--.*?-->|<!\[CDATA\[.*?\]\]>|<!DOCTYPE[^<>]*>"
    latex = rf"\\(?:{'|'.join(COMMANDS)})(?:[^a-zA-Z]|$)|\\[a-zA-Z]+\{{|(?:^|[^\\])\\\[.*?\S.*?\\\]|\\\(.*?\S.*?\\\)|\$\$[^$]*[^$\s][^$]*\$\$"
    letter, word = r"\p{L}", r"\p{L}\p{N}_"
    markdown = "|".join(
        (
            r"^ {0,3}#{1,6} +\S", r"^ {0,3}(?:```|~~~)", r"\*\*[^\s*](?:[^*\n]*[^\s*])?\*\*", r"~~\S(?:[^~\n]*\S)?~~",
            rf"(?:^|[^{word}*])\*{letter}(?:[^*\n]*{letter})?\*(?:[^{word}*]|$)", rf"(?:^|[^{word}])_{letter}(?:[^_\n]*{letter})?_(?:[^{word}]|$)",
            rf"(?:^|[^{word}])__[^\s_](?:[^\n]*?[^\s_])?__(?:[^{word}]|$)", r"(?:^|[^`])`[^`\n]+`(?:[^`]|$)", r"!?\[[^\[\]\n]*\]\([^()\s]+\)",
            r"^ {0,3}\[[^\]\n]+\]:\s+\S+://", r"^[ \t]*(?:\|[ \t]*)?:?-{3,}:?[ \t]*\|[-:| ]*$", r"^[ \t]*[-*+] \[[ xX]\] ", r"^ {0,3}>+ \S",
        )
    )
    wiki = (
        r"\[\[[^\[\]\n]+\]\]|\{\{[^{}]+\}\}|^[ \t]*\{\||^\|\}[ \t]*$|'''?[^\s'][^'\n]*'''?|^ *={2,6}[^=\n].*?={2,6}(?: |$)"
        r"|\[https?://[^\s\]]+(?: [^\]\n]*)?\]|</?(?:ref|nowiki|gallery)\b[^<>]*>|__(?:NO)?(?:TOC|EDITSECTION)__|#(?:REDIRECT|ПЕРЕНАПРАВЛЕНИЕ)"
    )
    return f"""
bared AS (
  SELECT doc_id, regexp_matches(text, '(?is){tag}|{entity}|{held}') AS html,
         regexp_replace(regexp_replace(text, '(?is){held}', ' ', 'g'), '(?i){tag}|{entity}', ' ', 'g') AS outside
  FROM documents WHERE text IS NOT NULL
),
marked AS (
  SELECT doc_id, html,
         regexp_matches(outside, '(?s){latex}') OR len(list_filter(regexp_extract_all(outside, '\\$[^$\\s](?:[^$\\n]*[^$\\s])?\\$'), lambda x: regexp_matches(x, '\\\\[a-zA-Z]|[_^]\\{{?\\w'))) > 0 AS latex,
         regexp_matches(regexp_replace(outside, '(?ms)^ {{0,3}}```[^\\n]*\\n.*?^ {{0,3}}```[ \\t]*$', '```', 'g'), '(?m){markdown}') AS markdown,
         regexp_matches(regexp_replace(outside, '(?ms)^ {{0,3}}```[^\\n]*\\n.*?^ {{0,3}}```[ \\t]*$', '```', 'g'), '(?m){_quoted(wiki)}') AS wiki
  FROM bared
)"""


SCRIPTS = (
    r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]", r"[\x{250}-\x{2c1}\x{370}-\x{373}\x{376}-\x{377}\x{37b}-\x{3ff}]", r"[\x{400}-\x{481}\x{48a}-\x{52f}]"
)


def oracle_sql() -> dict[str, str]:
    return {
        "p1_scores": f"""
WITH {CARDS},
df AS (SELECT term, count(*)::BIGINT AS doc_freq FROM cards GROUP BY term),
len AS (SELECT doc_id, sum(tf)::BIGINT AS doc_length FROM cards GROUP BY doc_id),
coll AS (SELECT count(*) AS n, avg(doc_length) AS avglen FROM len)
SELECT doc_id::BIGINT AS doc_id, term, tf AS term_freq, doc_freq, doc_length,
       round(ln(1 + (n - doc_freq + 0.5) / (doc_freq + 0.5)) * tf * 2.2
             / (tf + 1.2 * (1 - 0.75 + 0.75 * (CASE WHEN avglen > 0 THEN doc_length / avglen ELSE 0 END))), 6) AS score
FROM cards JOIN df USING (term) JOIN len USING (doc_id), coll""",
        "p1_found": f"""
WITH {CARDS}, df AS (SELECT term, count(*) AS n FROM cards GROUP BY term)
SELECT doc_id, term FROM cards JOIN df USING (term) WHERE tf >= 3 AND n <= 5""",
        "p4_word_counts": r"""
WITH latest AS (
  SELECT doc_id::BIGINT AS doc_id, arg_max(word_count, (coalesce(processed_at, TIMESTAMPTZ 'epoch'), id)) FILTER (true) AS wc,
         max_by({'w': word_count}, (coalesce(processed_at, TIMESTAMPTZ 'epoch'), id)).w::BIGINT AS page_word_count
  FROM pages WHERE doc_id IS NOT NULL GROUP BY doc_id
),
measured AS (
  SELECT doc_id, CASE WHEN text IS NULL OR NOT regexp_matches(text, '\S') THEN 0
    ELSE len(regexp_extract_all(CASE WHEN regexp_matches(substr(text, instr(text, chr(10)) + 1), '\S') THEN substr(text, instr(text, chr(10)) + 1) ELSE text END, '[^\s\x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) END::BIGINT AS n_words
  FROM documents
)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, page_word_count,
       CASE WHEN page_word_count IS NULL THEN 'missing' WHEN page_word_count < 1 THEN 'impossible'
            WHEN page_word_count = coalesce(n_words, 0) THEN 'equal' ELSE 'outdated' END AS word_count_state
FROM measured LEFT JOIN latest USING (doc_id)""",
        "p5_found": f"""
WITH {_markup()}
SELECT doc_id, kind FROM (
  SELECT doc_id, 'html' AS kind FROM marked WHERE html UNION ALL SELECT doc_id, 'latex' FROM marked WHERE latex
  UNION ALL SELECT doc_id, 'markdown' FROM marked WHERE markdown UNION ALL SELECT doc_id, 'wiki' FROM marked WHERE wiki
)""",
        "p6_found": f"""
WITH latest AS (
  SELECT id, max_by(title, (coalesce(processed_at, TIMESTAMPTZ 'epoch'), coalesce(title, ''))) AS title FROM pages WHERE id IS NOT NULL GROUP BY id
),
formed AS (SELECT id, title, {_form('title')} AS form FROM latest WHERE title IS NOT NULL)
SELECT a.id AS page_a, b.id AS page_b FROM formed a JOIN formed b ON a.form = b.form AND a.id < b.id AND a.title <> b.title""",
        "p6_tokens": f"""
WITH own AS (SELECT page_id, pos, text FROM title_tokens WHERE NOT normalize_unicode),
spelled AS (SELECT text, count(*) AS n, {_plain('text')} AS plain, {_form('text')} AS form FROM own WHERE text IS NOT NULL GROUP BY text),
odd AS (
  SELECT *, len(list_filter(range(1, least(len(text), len(plain)) + 1), lambda i: substr(text, i, 1) <> substr(plain, i, 1))) + abs(len(text) - len(plain))
         + 2 * len(list_filter(string_split(plain, ' '), lambda w: {' + '.join(f"regexp_matches(w, '{x}')::INT" for x in SCRIPTS)} > 1)) AS oddness
  FROM spelled
),
chosen AS (SELECT form, arg_min(plain, (oddness, -n, text)) AS text_normal FROM odd GROUP BY form)
SELECT o.page_id, o.pos, o.text, c.text_normal FROM own o LEFT JOIN odd USING (text) LEFT JOIN chosen c USING (form)""",
        "p7_counts": f"""
WITH {COUNTS}
SELECT term, occurrences, records, run_frequency, stated_records,
       concat_ws(',', CASE WHEN is_rare THEN 'rare' END, CASE WHEN is_common THEN 'common' END) AS marks
FROM joined""",
        "p7_found": f"""
WITH {COUNTS}
SELECT term, 'rare' AS mark FROM joined WHERE is_rare UNION ALL SELECT term, 'common' FROM joined WHERE is_common""",
        "p8_found": f"""
WITH own AS (SELECT doc_id, {_words('text')} AS w FROM documents),
items AS (SELECT item_id, {_words('text')} AS w FROM eval_items),
runs AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM items)),
held AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 9], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM own))
SELECT DISTINCT doc_id, item_id FROM held JOIN runs USING (run)""",
        "p9_balance": f"""
WITH {SIZES}
SELECT source, outcome, CASE WHEN factor > 0 THEN ceil(least(factor, max_repeats::DOUBLE)) ELSE 0 END::BIGINT AS copies, true AS reached, true AS exact FROM judged""",
        "p9_plan": f"""
WITH {SIZES}
SELECT source, documents, size, round(factor, 6) AS factor,
       round(coalesce(least(factor, max_repeats::DOUBLE), 0) * size, 3) AS planned_size, outcome FROM judged""",
        "p9_found": f"WITH {SIZES} SELECT source, outcome FROM judged WHERE outcome IN ('repeat', 'short')",
    }
