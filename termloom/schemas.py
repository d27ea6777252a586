"""Schemas of the engine's tables and files."""

from __future__ import annotations

DOCUMENTS = "doc_num int, filename string, title string, text string"
METADATA = "doc_id int, title string, source_url string, word_count int"
TOKENS = "doc_id bigint, pos int, term string"
TOKEN_LISTS = "doc_num int, token string, positions array<int>"
POSTINGS = "term string, doc_id bigint, term_freq int, positions array<int>"
VOCABULARY = "term string, term_id bigint, doc_freq bigint, postings_offset bigint"
DOCIDS = "doc_id bigint, filename string"
STATS = "num_documents bigint, num_terms bigint, total_postings bigint, total_positions bigint"
RANKED = "rank bigint, token string, frequency bigint"
PAGES = (
    "id int, title string, status int, sha1 string, word_count int, source_url string, doc_id int, attempts int, "
    "last_error string, discovered_at timestamp, processed_at timestamp"
)
CATEGORIES = "cat string, status int, discovered_at timestamp"
EVENTS = "id bigint, timestamp timestamp, event_type string, message string, details string"
API_MEMBERS = "query struct<categorymembers:array<struct<ns:int,title:string>>>, `continue` map<string,string>"
API_EXTRACTS = "query struct<pages:map<string,struct<title:string,extract:string,fullurl:string>>>"
