"""SQL twins of the core queries, for DuckDB on the same tables."""

from __future__ import annotations

import unicodedata

from .functions.stem_ru import ENDINGS, LATER, VOWELS
from .operators.crawl import MAX_ATTEMPTS
from .queries import MAX_NUMBERED, MIN_WORDS, ROOTS, SEARCHES, STOPWORDS

WORD = r"[\p{L}\p{Nd}_][\p{L}\p{Nd}_''’]*"
HYPHENATED = r"[\p{L}\p{Nd}_][\p{L}\p{Nd}_''’\-]*"


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _cut(text: str, pattern: str = WORD) -> str:
    return f"""
cut AS (SELECT doc_id, regexp_extract_all({text}, '{pattern}') AS t FROM documents),
tok AS (SELECT doc_id, unnest(range(len(t)))::BIGINT AS pos, unnest(t) AS term FROM cut)"""


TOK = _cut("lower(text)")
NUMBERED = """
docs AS (SELECT doc_id AS doc_num, row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, printf('doc%05d.txt', doc_id) AS filename FROM documents)"""
INDEX = f"""{TOK},{NUMBERED},
own AS (SELECT d.doc_id, t.pos, t.term FROM tok t JOIN docs d ON t.doc_id = d.doc_num),
post AS (SELECT term, doc_id, count(*) AS tf FROM own WHERE pos > 0 GROUP BY term, doc_id)"""
SEARCH = f"""{TOK},{NUMBERED},
held AS (SELECT DISTINCT d.doc_id, t.term FROM tok t JOIN docs d ON t.doc_id = d.doc_num WHERE t.pos > 0)"""
RANKS = f"""{TOK},
freq AS (SELECT term AS token, count(*) AS frequency FROM tok GROUP BY term),
ranks AS (SELECT row_number() OVER (ORDER BY frequency DESC, token) AS rank, token, frequency FROM freq)"""
QUEUE = """
queue AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(processed_at, TIMESTAMPTZ 'epoch') DESC) AS n FROM pages) WHERE n = 1
)"""
MEMBERS = """
named AS (
  SELECT replace(replace(category, 'Category:', ''), 'Категория:', '') AS cat, split_part(text, chr(10), 1) AS title
  FROM documents WHERE category IS NOT NULL
),
subs AS (
  SELECT DISTINCT split_part(cat, ' ', 1) AS cat, cat AS sub FROM named
  UNION SELECT DISTINCT cat, split_part(cat, ' ', 1) FROM named
)"""
REACHED = f"""
walk AS (
  SELECT unnest([{_list(ROOTS)}]) AS cat, 0 AS depth
  UNION
  SELECT s.sub, w.depth + 1 FROM walk w JOIN subs s ON s.cat = w.cat WHERE w.depth < 5
),
reached AS (SELECT cat, min(depth)::BIGINT AS depth FROM walk GROUP BY cat)"""

# sets of documents by word, combined as each search says
_HAS = {w: f"SELECT doc_id FROM held WHERE term = '{w}'" for w in ("the", "of", "der", "die", "und", "zzzzqq")}
_ALL = "SELECT doc_id FROM docs"
FOUND = {
    "bool_and": f"({_HAS['the']}) INTERSECT ({_HAS['of']})",
    "bool_or": f"({_HAS['die']}) UNION ({_HAS['of']})",
    "bool_not": f"({_ALL}) EXCEPT ({_HAS['the']})",
    "bool_nested": f"(({_HAS['the']}) UNION ({_HAS['der']})) EXCEPT (({_HAS['of']}) UNION ({_HAS['und']}))",
    "bool_not_and": f"({_HAS['of']}) EXCEPT ({_HAS['the']})",
    "bool_precedence": f"({_HAS['der']}) UNION (({_HAS['the']}) EXCEPT ({_HAS['of']}))",
    "bool_unknown": f"({_HAS['the']}) EXCEPT ({_HAS['zzzzqq']})",
    "bool_double_not": f"({_HAS['the']}) INTERSECT ({_ALL})",
}
assert FOUND.keys() == SEARCHES.keys()


def _stem(source: str, word: str) -> str:
    """CTEs that end in ``stemmed`` (word, stem) over a CTE with a column of words."""
    sql = f"""
s0 AS (
  SELECT {word} AS word, {word} AS stem,
         coalesce(nullif(length(regexp_extract({word}, '^[^{VOWELS}]*[{VOWELS}]')), 0), length({word})) AS rv,
         coalesce(nullif(length(regexp_extract({word}, '(?s)^.[^{VOWELS}]*[{VOWELS}].[^{VOWELS}]*[{VOWELS}]')), 0), length({word})) AS r2
  FROM {source}
)"""
    steps = [(ENDINGS, "rv"), *LATER]
    for i, (endings, region) in enumerate(steps):
        fits = f"list_filter([{_list(endings)}], lambda s: suffix(stem, s) AND length(stem) - length(s) >= {region})[1]"
        sql += f",\ns{i + 1} AS (SELECT word, left(stem, length(stem) - coalesce(length({fits}), 0)) AS stem, rv, r2 FROM s{i})"
    return sql + f",\nstemmed AS (SELECT word, stem FROM s{len(steps)})"


# Stems of the probes, worked out by hand from the rules.
STEMS = (
    "программирование программирован, программа программ, программист программист, обучение обучен, обучать обуча, обученный обученн, книга книг, книги книг, "
    "книгой книг, большой больш, большая больш, большие больш, делать дела, делал дел, делающий делающ, красивый красив, красивая красив, красиво красив, "
    "быстро быстро, быстрый быстрый, быстрее быстре, машина маш, машины маш, машинный машинн, python python, я я, новейшего нов, новейше нов, новость новос"
)


def _pairs(listed: str) -> str:
    return ", ".join("('{}', '{}')".format(*pair.split()) for pair in listed.split(", "))


LINES = r"""string_split_regex(text, '\r\n|[\n\r\x0B\f\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]')"""
_SPACE = r"\s\x0B\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CLEANED = rf"""
lines AS (
  SELECT doc_id, list_transform({LINES}, lambda x: regexp_replace(x, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')) AS l
  FROM documents WHERE text IS NOT NULL AND text <> ''
),
cleaned AS (
  SELECT doc_id, array_to_string(list_filter(l, lambda x: x <> '' AND NOT starts_with(x, '==') AND NOT starts_with(x, '{{{{')
           AND NOT starts_with(x, '[[File:') AND NOT starts_with(x, '[[Категория:') AND NOT starts_with(x, '[[Category:')), chr(10)) AS body
  FROM lines
),
counted AS (SELECT doc_id, body, len(regexp_extract_all(body, '[^{_SPACE}]+'))::BIGINT AS word_count FROM cleaned)"""

RECORDS = r"""
bodies AS (
  SELECT file_no, name, regexp_replace(regexp_replace(regexp_replace(replace(replace(CASE WHEN body[1] = chr(65279) THEN body[2:] ELSE body END,
         chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\t\x0B\f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+(\n|\z)', '\1', 'g'), '\n+\z', ''), '^$', '') AS record
  FROM file_info WHERE file_no IS NOT NULL
),
held AS (SELECT file_no, name, record FROM bodies WHERE record <> '')"""

TOTALS = """
cleaned AS (
  SELECT term, doc_id, CASE WHEN term_freq > 0 THEN term_freq ELSE coalesce(len(positions), 0) END AS freq,
         coalesce(len(positions), 0) AS np, coalesce(list_sum(positions), 0) AS ps
  FROM postings WHERE term IS NOT NULL
),
cards AS (SELECT term, doc_id, count(*) AS n_rows, max(freq) AS freq, max(np) AS np, max(ps) AS ps FROM cleaned GROUP BY term, doc_id),
per AS (
  SELECT term, sum(n_rows)::BIGINT AS n_rows, count(doc_id)::BIGINT AS cards, sum(freq)::BIGINT AS occurrences,
         sum(np)::BIGINT AS n_positions, sum(ps)::BIGINT AS position_sum FROM cards GROUP BY term
),
stated AS (
  SELECT term, sum(df)::BIGINT AS stated_cards
  FROM (SELECT segment_no, term, max(doc_freq) AS df FROM vocabulary WHERE term IS NOT NULL GROUP BY segment_no, term) GROUP BY term
)"""


def _unfolded() -> str:
    """Tokens after compatibility composition. DuckDB composes but does not unfold
    compatibility forms: a table of them, made by Unicode's rule, does."""
    forms = [(c, unicodedata.normalize("NFKD", c)) for c in map(chr, (*range(0xA0, 0x3400), *range(0xF900, 0xFFFF))) if unicodedata.normalize("NFKC", c) != unicodedata.normalize("NFC", c)]
    values = ", ".join("('{}', '{}')".format(c, n.replace("'", "''")) for c, n in forms)
    return f"""
forms AS (SELECT * FROM (VALUES {values}) t(c, n)),
signs AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS place FROM documents),
unfolded AS (SELECT doc_id, nfc_normalize(string_agg(coalesce(n, s.c), '' ORDER BY place)) AS text FROM signs s LEFT JOIN forms f ON f.c = s.c GROUP BY doc_id),
cut AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS t FROM unfolded),
tok AS (SELECT doc_id, unnest(range(len(t)))::BIGINT AS pos, unnest(t) AS term FROM cut)"""


def oracle_sql() -> dict[str, str]:
    select = "SELECT doc_id, pos, term FROM tok"
    pair = lambda g: f"regexp_extract_all(lower(text), '(?s)({WORD})(.?)', {g})"
    numbers = f"""
cut AS (SELECT doc_id, {pair(1)} AS t, {pair(2)} AS a FROM documents),
tok AS (SELECT doc_id, unnest(range(len(t)))::BIGINT AS pos, unnest(t) AS term, unnest(a) AS after FROM cut)"""
    sql = {
        "tokens": f"WITH {TOK} {select}",
        "tokens_no_lowercase": f"WITH {_cut('text')} {select}",
        "tokens_keep_hyphens": f"WITH {_cut('lower(text)', HYPHENATED)} {select}",
        "tokens_remove_numbers": f"WITH {numbers} {select} WHERE NOT (regexp_full_match(term, '[0-9]+') AND after NOT IN ('', '-', '‐', '‑', '‒', '–', '—', '―', '−'))",
        "tokens_strict_numbers": f"WITH {TOK} {select} WHERE NOT regexp_full_match(term, '[0-9]+')",
        "tokens_stopwords": f"WITH {TOK} {select} WHERE term NOT IN ({_list(STOPWORDS)})",
        "ascii_tokens": f"WITH {_cut('text', '[0-9A-Za-z_]+')} SELECT doc_id, pos, left(lower(term), 255) AS term FROM tok",
        "doc_term_positions": f"WITH {TOK} SELECT doc_id, term, term || ' ' || string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS value FROM tok GROUP BY doc_id, term",
        "postings": f"WITH {TOK} SELECT term, doc_id, count(*) AS term_freq, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions FROM tok WHERE pos > 0 GROUP BY term, doc_id",
        "postings_all_positions": f"WITH {TOK} SELECT term, doc_id, count(*) AS term_freq, min(pos) AS first_position FROM tok GROUP BY term, doc_id",
        "postings_of_tokens": f"WITH {TOK} SELECT term, doc_id, count(*) AS term_freq FROM tok WHERE pos > 0 GROUP BY term, doc_id",
        "vocabulary": f"""
WITH {INDEX},
v AS (SELECT term, count(*) AS doc_freq, min(doc_id) AS first, sum(12 + 4 * tf) + 4 AS bytes FROM post GROUP BY term)
SELECT term, row_number() OVER (ORDER BY first, term) - 1 AS term_id, doc_freq,
       coalesce(sum(bytes) OVER (ORDER BY term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS postings_offset FROM v""",
        "posting_bytes": f"WITH {INDEX} SELECT term, (4 + sum(12 + 4 * tf))::BIGINT AS bytes FROM post GROUP BY term",
        "docids": f"WITH {NUMBERED} SELECT doc_id, filename FROM docs",
        "index_stats": f"""
WITH {INDEX}
SELECT (SELECT count(*) FROM documents) AS num_documents, count(DISTINCT term) AS num_terms, count(*) AS total_postings,
       sum(tf)::BIGINT AS total_positions FROM post""",
        "term_lookup": f"WITH {INDEX} SELECT doc_id, tf AS term_freq, tf AS n_positions FROM post WHERE term = 'the'",
        "verify_index": "SELECT '' AS rule, '' AS subject WHERE false",
        "verify_damaged": f"""
WITH {INDEX}, last AS (SELECT max(doc_id) AS last FROM docs)
SELECT 'doc_freq' AS rule, 'the' AS subject UNION ALL SELECT 'offset', 'und' UNION ALL SELECT 'term_known', 'der'
UNION ALL SELECT 'term_freq', 'of/' || min(doc_id) FROM post WHERE term = 'of'
UNION ALL SELECT 'document_known', term || '/' || doc_id FROM post, last WHERE doc_id = last
UNION ALL SELECT 'stats', '{{"num_documents":' || (SELECT count(*) FROM docs) || ',"num_terms":' || count(DISTINCT term) || ',"total_postings":' || count(*) || ',"total_positions":' || sum(tf)::BIGINT || '}}' FROM post""",
        "probe_terms": f"""
WITH {INDEX},
asked AS (SELECT unnest(['the', 'und', 'zzzzqq']) AS term),
held AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS nth, count(*) OVER (PARTITION BY term) AS df FROM post WHERE term IN (SELECT term FROM asked))
SELECT term, coalesce(df, 0) AS doc_freq, nth, doc_id, tf AS term_freq, tf AS n_positions FROM asked LEFT JOIN (SELECT * FROM held WHERE nth <= 3) USING (term)""",
        "printed_results": f"""
WITH {SEARCH},
found AS (
  SELECT d.doc_id, d.filename, split_part(t.text, chr(10), 1) AS title FROM docs d JOIN documents t ON t.doc_id = d.doc_num
  WHERE d.doc_id IN ((({_HAS['the']}) INTERSECT ({_HAS['of']})) EXCEPT ({_HAS['der']}))
)
SELECT 0::BIGINT AS n, 'Найдено документов: ' || count(*) AS line FROM found UNION ALL SELECT 1, ''
UNION ALL SELECT row_number() OVER (ORDER BY doc_id) + 1, doc_id || chr(9) || filename || chr(9) || title FROM found""",
        "query_probes": """
SELECT * FROM (VALUES ('a AND b', '(a AND b)', '1'), ('a OR b AND c', '(a OR (b AND c))', '0,1'), ('(a OR b) AND NOT c', '((a OR b) AND NOT c)', '0,1,2'),
  ('NOT NOT a', 'NOT NOT a', '0,1'), ('NOT a AND b', '(NOT a AND b)', '2'), ('a b', 'a', '0,1'), ('a && b', 'a', '0,1'), ('!a', 'a', '0,1'),
  ('AND a', '(() AND a)', ''), ('a OR', '(a OR ())', '0,1'), ('NOT', 'NOT ()', '0,1,2,3'), ('(a OR b', '(a OR b)', '0,1,2'), ('(a b) AND c', 'a', '0,1'),
  ('zzz', 'zzz', ''), ('NOT zzz', 'NOT zzz', '0,1,2,3'), ('A and B', '(a AND b)', '1'), ('(((c)))', 'c', '3')) t(query, tree, docs)""",
        "token_probes": """
SELECT probe, pos::BIGINT AS pos, term FROM (VALUES ('plain', 0, 'hello'), ('plain', 1, 'world'), ('hyphens', 0, 'state'), ('hyphens', 1, 'of'), ('hyphens', 2, 'the'), ('hyphens', 3, 'art'),
  ('kept', 0, 'state-of-the-art'), ('kept', 1, 'a'), ('kept', 2, 'b'), ('quotes', 0, 'rock’n''roll'), ('quotes', 1, 'dogs' || chr(39)), ('quotes', 2, 'x'),
  ('forms', 0, 'fi'), ('forms', 1, 'iv'), ('forms', 2, '1'), ('forms', 3, '2'), ('forms', 4, 'ab'), ('numbers', 1, 'cats'), ('numbers', 2, '8'),
  ('flushed', 0, '7'), ('flushed', 1, 'up'), ('strict', 1, 'up'), ('case', 0, 'The'), ('case', 1, 'Ёж')) t(probe, pos, term)""",
        "corpus_files": r"""
SELECT doc_id AS doc_num, printf('doc%05d.txt', doc_id) AS filename, split_part(text, chr(10), 1) AS title,
       sha1(split_part(text, chr(10), 1) || chr(10) || chr(10) || regexp_replace(substr(text, length(split_part(text, chr(10), 1)) + 2), '\A\n', '')) AS sha1
FROM documents""",
        "token_files": f"WITH {TOK} SELECT doc_id AS doc_num, term AS token, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions FROM tok GROUP BY doc_id, term",
        "token_file_postings": f"WITH {TOK} SELECT term, doc_id, count(*) AS term_freq FROM tok WHERE pos > 0 GROUP BY term, doc_id",
        "token_file_ranks": f"WITH {RANKS} SELECT rank, token, frequency FROM ranks",
        "stemmed_token_files": f"""
WITH {TOK}, terms AS (SELECT DISTINCT term FROM tok), {_stem('terms', 'term')},
lists AS (SELECT doc_id, term, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions FROM tok GROUP BY doc_id, term)
SELECT doc_id AS doc_num, stem, positions FROM lists JOIN stemmed ON word = term""",
        "metadata_file": rf"""
SELECT doc_id, '"' || split_part(text, chr(10), 1) || '", a' AS title, NULL::VARCHAR AS source_url, len(regexp_extract_all(text, '[^{_SPACE}]+'))::BIGINT AS word_count FROM documents""",
        "metadata_titles": """
SELECT printf('doc%05d.tokens', doc_id) AS filename, split_part(text, chr(10), 1) AS title FROM documents
UNION ALL SELECT printf('doc%05d.txt', doc_id), split_part(text, chr(10), 1) FROM documents""",
        "api_members": f"""
WITH {MEMBERS}
SELECT cat, 0::BIGINT AS ns, title FROM named UNION ALL SELECT split_part(cat, ' ', 1), 14, 'Категория:' || cat FROM named
UNION ALL SELECT cat, 14, 'Category:' || split_part(cat, ' ', 1) FROM named""",
        "api_extracts": "SELECT doc_id, split_part(text, chr(10), 1) AS title, sha1(text) AS sha1, 'http://wiki/' || doc_id AS source_url FROM documents",
        "backoffs": """
SELECT attempts::BIGINT AS attempts, asked, CASE asked WHEN '7' THEN 7 WHEN '0.5' THEN 0.5 ELSE least(2.0 ** attempts, 60) END::DOUBLE AS seconds
FROM (SELECT unnest([0, 1, 5, 6, 9]) AS attempts), (SELECT unnest([NULL, '7', 'soon', '0.5']) AS asked)""",
        "dedupe_existing": """
SELECT min(doc_id) AS doc_id, sha1(text) AS sha1 FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL
  AND sha1(text) NOT IN (SELECT sha1(text) FROM documents WHERE text IS NOT NULL AND lang IS NULL) GROUP BY sha1(text)""",
        "stream_numbered": f"""
WITH {CLEANED}, n AS (SELECT count(DISTINCT body) AS n FROM counted WHERE word_count >= {MIN_WORDS})
SELECT i AS doc_id, printf('doc%05d.txt', i) AS filename FROM (SELECT unnest(range(1, least(n, {MAX_NUMBERED}) + 1)) AS i FROM n)""",
        "stopword_file": f"SELECT unnest([{_list(STOPWORDS)}]) AS word",
        "docids_file": f"WITH {NUMBERED} SELECT doc_id, filename FROM docs",
        "postings_file": f"WITH {INDEX} SELECT term, doc_id, count(*) AS term_freq, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions FROM own WHERE pos > 0 GROUP BY term, doc_id",
        "postings_file_lookup": f"WITH {INDEX} SELECT doc_id, tf AS term_freq, tf AS n_positions FROM post WHERE term = 'the'",
        "zipf_file": f"WITH {RANKS} SELECT rank, token, frequency FROM ranks",
        "tokens_nfkc": f"WITH {_unfolded()} SELECT doc_id, pos, term FROM tok",
        "sql_tokenize": f"WITH {_unfolded()} SELECT doc_id, pos, term FROM tok",
        "sql_clean_text": f"WITH {CLEANED} SELECT doc_id, sha1(body) AS sha1, word_count FROM counted",
        "sql_stem": f"WITH {TOK}, terms AS (SELECT DISTINCT term FROM tok), {_stem('terms', 'term')} SELECT word, stem FROM stemmed",
        "sql_boolean_match": f"WITH {SEARCH} SELECT doc_num AS doc_id FROM docs WHERE doc_id IN ({FOUND['bool_nested']})",
        "bool_with_titles": f"""
WITH {SEARCH}
SELECT d.doc_id, d.filename, split_part(t.text, chr(10), 1) AS title
FROM docs d JOIN documents t ON t.doc_id = d.doc_num
WHERE d.doc_id IN ((({_HAS['the']}) INTERSECT ({_HAS['of']})) EXCEPT ({_HAS['der']}))""",
        "bool_by_sets": f"WITH {SEARCH} SELECT doc_id FROM ({FOUND['bool_nested']})",
        "search_many": f"WITH {SEARCH} " + " UNION ALL ".join(f"SELECT '{k}' AS query_id, doc_id FROM ({v})" for k, v in FOUND.items()),
        "zipf_rank": f"WITH {RANKS} SELECT rank, token, frequency FROM ranks",
        "zipf_top_n": f"WITH {RANKS} SELECT rank, frequency, token FROM ranks WHERE rank <= 100",
        "zipf_fit": f"""
WITH {RANKS}, line AS (SELECT regr_slope(ln(frequency), ln(rank)) AS a, regr_intercept(ln(frequency), ln(rank)) AS b FROM ranks)
SELECT rank, token, frequency, round(ln(rank), 6) AS log_rank, round(ln(frequency), 6) AS log_frequency, round(a * ln(rank) + b, 6) AS fitted FROM ranks, line""",
        "stem_words": f"SELECT * FROM (VALUES {_pairs(STEMS)}) t(word, stem)",
        "stem_log": f"""
WITH {TOK}, terms AS (SELECT DISTINCT term FROM tok), {_stem('terms', 'term')}
SELECT t.term AS original, s.stem FROM (SELECT DISTINCT doc_id, term FROM tok) t JOIN stemmed s ON s.word = t.term WHERE s.stem <> t.term""",
        "stem_log_distinct": f"""
WITH {TOK}, terms AS (SELECT DISTINCT term FROM tok), {_stem('terms', 'term')}
SELECT word AS original, stem FROM stemmed WHERE stem <> word""",
        "stemmed_vocabulary": f"""
WITH {TOK}, terms AS (SELECT DISTINCT term FROM tok), {_stem('terms', 'term')}
SELECT s.stem AS term, count(DISTINCT t.doc_id) AS doc_freq FROM tok t JOIN stemmed s ON s.word = t.term WHERE t.pos > 0 GROUP BY s.stem""",
        "stemmed_tokens": f"""
WITH {TOK}, terms AS (SELECT DISTINCT term FROM tok), {_stem('terms', 'term')}
SELECT s.stem AS term, count(*) AS frequency FROM tok t JOIN stemmed s ON s.word = t.term GROUP BY s.stem""",
        "clean_docs": f"WITH {CLEANED} SELECT doc_id, word_count, sha1(body) AS sha1 FROM counted WHERE word_count >= {MIN_WORDS}",
        "dedupe_sha1": """
WITH firsts AS (SELECT min(doc_id) AS doc_id, sha1(text) AS sha1 FROM documents WHERE text IS NOT NULL GROUP BY sha1(text))
SELECT doc_id, sha1, row_number() OVER (ORDER BY doc_id) AS new_id FROM firsts""",
        "document_titles": f"""
WITH {QUEUE}
SELECT d.doc_id, split_part(d.text, chr(10), 1) AS title, p.page_title
FROM documents d LEFT JOIN (SELECT doc_id, min(title) AS page_title FROM queue WHERE doc_id IS NOT NULL GROUP BY doc_id) p ON p.doc_id = d.doc_id""",
        "status_histogram": f"WITH {QUEUE} SELECT status::BIGINT AS status, count(*) AS pages FROM queue GROUP BY status",
        "status_all": f"""
WITH {QUEUE} SELECT s::BIGINT AS status, count(id) AS pages FROM (SELECT unnest([0, 1, 2, 3]) AS s) LEFT JOIN (SELECT * FROM queue WHERE status <> 2) ON status = s GROUP BY s
UNION ALL SELECT NULL, count(*) FROM queue WHERE status IS NULL HAVING count(*) > 0""",
        "queue_steps": f"""
WITH {QUEUE}, chosen AS (SELECT id FROM queue WHERE status IN (0, 3) AND attempts < {MAX_ATTEMPTS} ORDER BY attempts, id LIMIT 50),
tried AS (SELECT *, attempts + 1 AS tries FROM queue WHERE id IN (SELECT id FROM chosen))
SELECT id::BIGINT AS id, title, (CASE tries WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END)::BIGINT AS status, tries::BIGINT AS attempts, CASE tries WHEN 1 THEN NULL WHEN 2 THEN 'lost' ELSE last_error END AS last_error FROM tried
UNION ALL SELECT id, title, CASE status WHEN 2 THEN 0 ELSE status END, attempts, last_error FROM queue WHERE id NOT IN (SELECT id FROM chosen)
UNION ALL SELECT max(id) + 1, 'a title that no page has', 0, 0, NULL FROM queue""",
        "event_log": f"""
WITH {QUEUE}, failed AS (SELECT '{{"id":' || id || '}}' AS details FROM queue WHERE status = 3), waiting AS (SELECT '{{"id":' || id || '}}' AS details FROM queue WHERE status = 0)
SELECT row_number() OVER (ORDER BY details) AS id, 'failed' AS event_type, 'a page failed' AS message, details FROM failed
UNION ALL SELECT (SELECT count(*) FROM failed) + row_number() OVER (ORDER BY details), 'new', 'a page waits', details FROM waiting""",
        "requeued_pages": f"WITH {QUEUE} SELECT (CASE status WHEN 2 THEN 0 ELSE status END)::BIGINT AS status, count(*) AS pages FROM queue GROUP BY 1",
        "crawl_stats": f"""
WITH {QUEUE}
SELECT count(*) AS pages, count(*) FILTER (status = 0) AS new, count(*) FILTER (status = 1) AS done, count(*) FILTER (status = 2) AS in_progress,
       count(*) FILTER (status = 3) AS failed, count(doc_id) AS saved, count(*) FILTER (starts_with(last_error, 'skipped')) AS skipped,
       count(*) FILTER (status = 3 AND attempts >= {MAX_ATTEMPTS}) AS failed_for_good FROM queue""",
        "page_queue_top": f"""
WITH {QUEUE}
SELECT id::BIGINT AS id, title, attempts::BIGINT AS attempts FROM queue WHERE status IN (0, 3) AND attempts < {MAX_ATTEMPTS} ORDER BY attempts, id LIMIT 50""",
        "page_claim": f"""
WITH {QUEUE}, chosen AS (SELECT id FROM queue WHERE status IN (0, 3) AND attempts < {MAX_ATTEMPTS} ORDER BY attempts, id LIMIT 50)
SELECT id::BIGINT AS id, (CASE WHEN id IN (SELECT id FROM chosen) THEN 2 ELSE status END)::BIGINT AS status,
       (attempts + CASE WHEN id IN (SELECT id FROM chosen) THEN 1 ELSE 0 END)::BIGINT AS attempts FROM queue""",
        "event_counts": "SELECT event_type, count(*) AS events, count(*) FILTER ((props::JSON->>'$.k')::INT >= 50) AS upper_half FROM events GROUP BY event_type",
        "category_bfs": f"WITH RECURSIVE {MEMBERS},{REACHED} SELECT cat, depth FROM reached",
        "category_pages": f"WITH RECURSIVE {MEMBERS},{REACHED} SELECT DISTINCT title FROM named JOIN reached USING (cat)",
        "category_depth": f"WITH RECURSIVE {MEMBERS},{REACHED} SELECT cat, depth FROM reached WHERE depth <= 1",
        "stream_dedupe": f"WITH {CLEANED} SELECT DISTINCT sha1(body) AS sha1, word_count FROM counted WHERE word_count >= {MIN_WORDS}",
        "p2_found": f"WITH {RECORDS} SELECT a.file_no AS file_a, b.file_no AS file_b FROM held a JOIN held b ON a.record = b.record AND a.file_no < b.file_no",
        "p2_compact": f"WITH {RECORDS} SELECT file_no, name, record FROM held h WHERE file_no IN (SELECT min(file_no) FROM held GROUP BY record)",
        "p3_totals": f"""
WITH {TOTALS}
SELECT term, n_rows, round(n_rows / (SELECT count(*) FROM postings), 9) AS row_share, cards, occurrences, n_positions, position_sum, stated_cards
FROM per LEFT JOIN stated USING (term)""",
        "p3_found": "SELECT term FROM postings WHERE term IS NOT NULL GROUP BY term HAVING count(*) > 0.02 * (SELECT count(*) FROM postings)",
    }
    for name, where in (("zipf_regression", ""), ("zipf_regression_top_n", "WHERE rank <= 100")):
        regr = ", ".join(f"round(regr_{f}(ln(frequency), ln(rank)), 6) AS {c}" for f, c in (("slope", "slope"), ("intercept", "intercept"), ("r2", "r_squared")))
        sql[name] = f"WITH {RANKS} SELECT {regr} FROM ranks {where}"
    for name in ("vocabulary", "index_stats"):
        sql[{"vocabulary": "vocabulary_file", "index_stats": "stats_file"}[name]] = sql[name]
    for name, found in FOUND.items():
        sql[name] = f"WITH {SEARCH} SELECT doc_id, filename FROM docs WHERE doc_id IN ({found})"
    return sql
