"""Per-document text statistics and the split of prose from everything else.

``measure(text)`` works on one text; ``text_quality(df)`` runs it over a whole
table in one narrow pass (no shuffle), ``compare_word_counts`` sets the word
count of the crawl queue against the measured one.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import markup
from .text import plain

# Frequent function words of the three corpus languages.
COMMON_WORDS = {
    "ru": "и в во не на что с со как по из за к ко у о об от до для но а или же ли бы то так это его её их он она оно они "
    "мы вы я при под над без после перед между через среди около если чем тем когда где который которая которое которые "
    "которых том этот эта эти той тех был была было были есть ещё уже только даже также хотя такая такой такое такие поэтому потому "
    "иногда обычно часто почти очень",
    "en": "the a an of and to in is was were are be been that it its this these those with as at by for from on or not but "
    "which who whom has have had than then there their they he she his her you we i if when where how what between under "
    "into about before after because although without over up out no yet can does do more most still often only one",
    "de": "der die das den dem des ein eine einer eines einem einen und oder aber nicht kein keine ist sind war waren wird "
    "werden wurde hat haben hatte in im an am auf aus bei beim mit nach von vom vor zu zum zur über unter für durch gegen "
    "ohne um als wie wenn dass daß ob weil obwohl sich es er sie wir ihr man noch nur auch so sehr dann etwa seit bis zwischen",
}
COMMON = frozenset(w for words in COMMON_WORDS.values() for w in words.split())
# Articles stand in lists of nouns too, so they do not count as words that connect others.
CONNECTING = COMMON - set("the a an der die das den dem des ein eine einer eines einem einen".split())

MIN_WORDS = 4  # shorter pieces are judged with what follows them
MIN_COMMON = 0.05  # least share of common words in a sentence of prose
MAX_DIGITS = 0.15  # most digits among a piece's characters
MIN_LETTERS = 0.6  # least share of letters among the characters that are no white space
MAX_BARE = 16  # most words of a sentence with no common words but articles
WORDS_A_KIND = 20  # a piece needs one connecting word, and another one for each so many words
MAX_KINDS = 5  # most different connecting words asked for
MAX_SENTENCE = 60  # longest sentence; a longer piece is judged like one without an end
MIN_LOOSE = 0.1  # least share of connecting words where there is no sentence end
MAX_REPEATED_LINES = 0.3  # from these shares on a body is repetitive
MAX_REPEATED_PARAGRAPHS = 0.3
MAX_REPEATED_PIECES = 0.5
MAX_TOP_NGRAM = 0.18
MIN_REPEATED_WORDS = 6  # of a repeated piece of a repetitive body
MIN_REPEATED_KINDS = 4  # different connecting words of the repeated pieces of a repetitive body
MAX_COVERAGE = 0.3  # most 3-grams of a piece without an end that occur in it again
MAX_VOWELLESS = 0.4  # most words without a vowel
PROSE_SHARE = 0.5
SHORT_WORD = 3  # letters; in most languages many function words have no more
SHORT_SHARES = (0.15, 0.75)  # of short words in a sentence of a language without a list of function words
MIN_RUNNING = 0.6  # words of such a sentence that do not begin with a capital

_edge = ".,:;!?\"'«»„“”()[]{}—–-…*_"
_end = re.compile(r"(?<=[.!?…])[\"'»”“)\]]*\s+")
_vowels = frozenset("aeiouyäöüéаеёиоуыэюяіｅａı")
_letters = re.compile(r"[^\W\d_]+")
_bullet = re.compile(r"^\s*(?:[-*+•·–—]|\(?\d{1,4}[.)]|\(?[a-zа-я][.)])\s+", re.I)
_ENDS = frozenset(".!?…:;")
_closers = "\"'»”“)]"
_encoded = re.compile(r"(?<![^\s])(?=\S*\d)[0-9A-Za-z+/=_-]{24,}(?![^\s])")
_numbers = re.compile(r"\d+")

COLUMNS = {
    "n_chars": "bigint", "n_words": "bigint", "mean_word_length": "double", "symbol_share": "double",
    "digit_share": "double", "common_word_share": "double", "n_lines": "bigint", "punctuated_line_share": "double",
    "bullet_line_share": "double", "duplicate_line_share": "double", "duplicate_paragraph_share": "double",
    "top_ngram_share": "double", "encoded_share": "double", "prose_share": "double", "kind": "string",
}
SCHEMA = ", ".join(f"{k} {v}" for k, v in COLUMNS.items())


def split_title(text: str) -> tuple[str, str]:
    """Title line and body of a document (first line, blank line, the rest). A text
    of one line has no title: the line is its body."""
    head, _, rest = text.partition("\n")
    return (head, rest) if rest.strip() else ("", text)


def is_ended(text: str) -> bool:
    """Whether a piece or line ends like a sentence."""
    return text.rstrip(_closers)[-1:] in _ENDS


def _repeated(items: list[str]) -> float:
    total = sum(map(len, items))
    if not total:
        return 0.0
    return sum(len(k) * (n - 1) for k, n in Counter(items).items()) / total


def repetition(body: str, lines: list[str], words: list[str]) -> tuple[float, float, float]:
    """Shares of a body's characters in repeated lines, in repeated paragraphs and
    in its most frequent 3-gram."""
    top = 0.0
    if len(words) >= 3:
        gram, times = Counter(zip(words, words[1:], words[2:])).most_common(1)[0]
        top = min(1.0, times * (sum(map(len, gram)) + 2) / len(body)) if times > 1 else 0.0
    return _repeated(lines), _repeated([x for x in (p.strip() for p in body.split("\n\n")) if x]), top


def coverage(words: list[str]) -> float:
    """Share of the 3-grams that occur more than once."""
    grams = Counter(zip(words, words[1:], words[2:]))
    return sum(n for n in grams.values() if n > 1) / max(1, len(words) - 2)


def is_prose(piece: str, words: list[str], common: int, kinds: int, connected: bool = True, repetitive: bool = False) -> bool:
    """A piece is prose if it has function words, and of different kinds the longer
    it is, is mostly letters and its words can be spoken. ``kinds``: different
    connecting words.

    A short sentence may have articles alone in a body that is ``connected``: most
    of its words lie in pieces with other function words, or it is no longer itself. A piece without a sentence end or longer than a sentence
    must be dense in connecting words and not repeat itself; so must a sentence be
    dense in them and have two kinds where the body is ``repetitive``."""
    n = len(words)
    if common < MIN_COMMON * n:
        return False
    if len("".join(_numbers.findall(piece))) > MAX_DIGITS * len(piece):
        return False
    loose = n > MAX_SENTENCE or not is_ended(piece)
    if kinds < min(MAX_KINDS, 1 + n // WORDS_A_KIND) and (loose or kinds or not connected or n > MAX_BARE):
        return False
    if (loose or repetitive) and sum(map(CONNECTING.__contains__, words)) < MIN_LOOSE * n:
        return False
    if repetitive and (loose or kinds < 2):
        return False
    if loose and coverage(words) > MAX_COVERAGE:
        return False
    letters = MIN_LETTERS * (len(piece) - piece.count(" "))
    if len("".join(filter(str.isalpha, words))) < letters and len("".join(_letters.findall(piece))) < letters:
        return False
    long = [w for w in words if len(w) > 2]
    return not long or sum(map(_vowels.isdisjoint, long)) <= MAX_VOWELLESS * len(long)


def is_foreign_prose(piece: str, words: list[str]) -> bool:
    """The same for a sentence of a body that has few words of COMMON: what tells
    sentences of other languages from lists of names, codes and junk is the end, the
    length, running words in lower case, short words among longer ones, letters and
    vowels. Scripts without spaces between words are not judged so."""
    n = len(words)
    if not MIN_WORDS <= n <= MAX_SENTENCE or not is_ended(piece):
        return False
    short = sum(len(w) <= SHORT_WORD and w.isalpha() for w in words)
    if not SHORT_SHARES[0] * n <= short <= SHORT_SHARES[1] * n:
        return False
    if sum(not w.lstrip(_edge)[:1].isupper() for w in piece.split()) < MIN_RUNNING * n:
        return False
    if len("".join(_numbers.findall(piece))) > MAX_DIGITS * len(piece):
        return False
    if sum(map(len, _letters.findall(piece))) < MIN_LETTERS * (len(piece) - piece.count(" ")):
        return False
    spoken = [unicodedata.normalize("NFKD", w) for w in words if len(w) > 2 and w[0] < "\u0530"]
    return sum(map(_vowels.isdisjoint, spoken)) <= MAX_VOWELLESS * len(spoken)


def split_pieces(body: str) -> Iterator[tuple[str, list[str]]]:
    """Sentence-like pieces of a body without markup and their words.

    Lines are joined first, so hard line breaks do not matter; a piece of fewer
    than MIN_WORDS words is taken together with the next one."""
    short = ""
    parts = _end.split(" ".join(body.split()))
    last = len(parts) - 1
    for i, part in enumerate(parts):
        part = f"{short} {part}" if short else part
        if part.count(" ") < MIN_WORDS - 1 and i < last:
            short = part
            continue
        short = ""
        if part:
            yield part, [w for x in part.lower().split() if (w := x.strip(_edge))]


def judged(body: str) -> tuple[list[tuple[str, list[str], int, bool]], list[str], list[str], tuple[float, float, float]]:
    """Pieces of a body without markup as (piece, words, number of common words,
    prose?), its lines and words, and the repetition that took part in judging."""
    parts = list(split_pieces(body))
    lines = [x for x in (line.strip() for line in body.split("\n")) if x]
    words = [w for _, own in parts for w in own]
    repeated = repetition(body, lines, words)
    twice, twice_paragraphs, top = repeated
    # a phrase is dominant in boilerplate where not only it, but much else comes again
    dominant = top > MAX_TOP_NGRAM and coverage(words) > MAX_COVERAGE
    again = _repeated([part for part, _ in parts])
    repetitive = twice > MAX_REPEATED_LINES or twice_paragraphs > MAX_REPEATED_PARAGRAPHS or again > MAX_REPEATED_PIECES or dominant
    kinds = [len(CONNECTING.intersection(own)) for _, own in parts]
    connected = len(words) <= MAX_BARE or sum(len(own) for (_, own), k in zip(parts, kinds) if k) > len(words) / 2
    boilerplate: set[str] = set()
    if repetitive:
        times = Counter(part for part, _ in parts)
        if len({w for part, own in parts if times[part] > 1 for w in own} & CONNECTING) < MIN_REPEATED_KINDS:
            boilerplate = {part for part, n in times.items() if n > 1}
        else:  # labels, however they are ended
            boilerplate = {part for part, own in parts if times[part] > 1 and len(own) < MIN_REPEATED_WORDS}
    common = [sum(map(COMMON.__contains__, own)) for _, own in parts]
    foreign = not repetitive and sum(common) < MIN_COMMON * len(words)
    out = []
    for (part, own), k, n in zip(parts, kinds, common):
        good = part not in boilerplate and is_prose(part, own, n, k, connected, repetitive)
        out.append((part, own, n, good or foreign and is_foreign_prose(part, own)))
    return out, lines, words, repeated


def pieces(body: str) -> list[tuple[str, list[str], int, bool]]:
    """Sentence-like pieces of a body without markup: (piece, words, number of
    common words, prose?)."""
    return judged(body)[0]


def prepared_body(text: str) -> str:
    """Body with characters brought to plain forms and markup removed."""
    return markup.clean(plain(split_title(text)[1]))


def measure(text: str | None) -> tuple:
    """Values of COLUMNS for a text; a NULL or empty text has zero counts, NULL
    shares and kind ``empty``."""
    if text is None or not text.strip():
        return (0, 0, None, None, None, None, 0, None, None, None, None, None, None, None, "empty")
    raw = split_title(text)[1]
    body = markup.clean(plain(raw))
    found, lines, words, (twice, twice_paragraphs, top) = judged(body)
    in_common = in_prose = total = 0
    for piece, _, common, good in found:
        in_common += common
        total += len(piece)
        in_prose += len(piece) * good
    n = len(words)
    signs = "".join(body.split())
    dense = len(signs)
    if not n or not dense:
        return (len(raw), len(raw.split()), None, None, None, None, 0, None, None, None, None, None, None, None, "empty")
    signs = _letters.sub("", signs)
    letters = dense - len(signs)
    digits = sum(map(len, _numbers.findall(signs)))
    symbols = 1 - (letters + digits) / dense
    digit = digits / dense
    common = in_common / n
    ended = sum(map(is_ended, lines)) / len(lines)
    bullets = sum(bool(_bullet.match(x)) for x in lines) / len(lines)
    encoded = sum(map(len, _encoded.findall(body))) / len(body)
    prose = in_prose / total
    if prose >= PROSE_SHARE:
        kind = "prose"
    elif encoded > 0.4:
        kind = "encoded"
    elif bullets > 0.5:
        kind = "list"
    elif twice > 0.15 and digit < 0.05 and symbols < 0.15:
        kind = "navigation"
    elif digit > 0.15 and letters > 0.25 * dense and symbols > 0.1 and sum("," in x for x in lines) > 0.5 * len(lines):
        kind = "index"
    elif digit > 0.3:
        kind = "table"
    else:
        kind = "junk"
    return (
        len(raw), len(raw.split()), sum(map(len, words)) / n, symbols, digit, common, len(lines), ended,
        bullets, twice, twice_paragraphs, top, encoded, prose, kind,
    )


def text_quality(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the key and COLUMNS. Narrow: no shuffle, only the
    key and the text are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([measure(t) for t in b["_t"]], columns=list(COLUMNS))
            out.insert(0, "_k", b["_k"].values)
            yield out

    kind = df.schema[key].dataType.simpleString()
    return (
        df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
        .mapInPandas(run, f"_k {kind}, {SCHEMA}")
        .withColumnRenamed("_k", key)
    )


def compare_word_counts(quality: DataFrame, pages: DataFrame) -> DataFrame:
    """Statistics with the crawl queue's word count beside them.

    Of several deliveries of a page the latest ``processed_at`` counts.
    word_count_state: ``missing`` (no page or NULL), ``impossible`` (below 1),
    ``equal`` or ``outdated``."""
    latest = (
        pages.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max_by("word_count", F.struct(F.coalesce("processed_at", F.lit(0).cast("timestamp")), "id")).alias("page_word_count"))
    )
    stated = F.col("page_word_count")
    state = (
        F.when(stated.isNull(), "missing")
        .when(stated < 1, "impossible")
        .when(stated == F.col("n_words"), "equal")
        .otherwise("outdated")
    )
    return quality.join(latest, "doc_id", "left").withColumn("word_count_state", state)


def not_prose(quality: DataFrame) -> DataFrame:
    """Documents whose body is by more than half of its characters not prose."""
    return quality.where(F.col("prose_share") < PROSE_SHARE).select("doc_id")
