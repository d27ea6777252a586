"""Markup residue: which kinds of markup a text carries, and the clean text.

``kinds(text)`` reports the kinds; ``clean(text)`` converts HTML, Markdown, wiki
and LaTeX to plain text in which structure stays visible in one notation:
``# heading``, ``- item``, fenced code blocks, ``$formula$`` and ``a | b`` rows.

Each language is rewritten only where its kind was found. No span has a greatest
length and no nesting a greatest depth: texts are scanned from left to right, an end
mark is looked for once (``Ahead``), and nested constructs are kept on a stack, so a
text of unpaired marks takes time in proportion to its length and stays text.

Left out with its content: comments, scripts, styles, HTML heads, references, notes
and citations, wiki categories, and a picture's file name and size. Everything else
stays, a template's values as ``name: value`` lines and an unknown LaTeX command
without an argument as it stands.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names.
TAGS = (
    "a abbr article aside b blockquote body br button caption center cite code col colgroup dd del div dl dt em "
    "figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li "
    "link main mark meta nav nobr noscript ol option p pre q s samp script section select small span strike strong "
    "style sub sup svg table tbody td textarea tfoot th thead title tr tt u ul var video wbr"
).split()
# LaTeX commands; another backslash word counts only with an argument.
COMMANDS = (
    "begin end documentclass usepackage title author section subsection subsubsection paragraph chapter part emph "
    "textbf textit texttt textsc underline it bf tt em item cite ref eqref label footnote url href caption "
    "includegraphics frac sqrt sum prod int lim infty alpha beta gamma delta epsilon lambda mu pi sigma omega theta "
    "le ge leq geq neq approx times cdot ldots dots left right mathbf mathrm mathcal par noindent"
).split()
# HTML elements that begin and end a line.
BLOCKS = frozenset(
    "article aside blockquote body br caption center dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr html main nav ol p section table tbody tfoot thead title tr ul".split()
)
# LaTeX commands that switch a font, that are left out with their argument, and
# whose second argument is the text; environments of tables; accents.
SWITCHES = frozenset("it bf tt em sc rm sf sl par noindent centering small large".split())
DROPPED = frozenset("cite citep citet ref eqref label footnote footnotemark begin end usepackage documentclass includegraphics bibliography bibliographystyle vspace hspace".split())
SECOND = frozenset("href textcolor colorbox".split())
TABULAR = frozenset("tabular tabular* tabularx longtable array".split())
ACCENTS = {'"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307"}
LEVELS = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
# Wiki name spaces of pictures and categories.
PICTURES = ("file", "image", "файл", "изображение", "datei", "bild")
CATEGORIES = ("category", "категория", "kategorie")


class Ahead:
    """First match of a pattern from a place on. Places ascend, so the text is
    searched once for each pattern, however often an end mark is missing."""

    def __init__(self, text: str):
        self.text = text
        self.held: dict[re.Pattern, re.Match | None] = {}

    def find(self, pattern: re.Pattern, at: int) -> re.Match | None:
        if pattern in self.held:
            m = self.held[pattern]
            if m is None or m.start() >= at:
                return m
        m = self.held[pattern] = pattern.search(self.text, at)
        return m


# ------------------------------------------------- spans that are held together
_OPENINGS = {
    "html": r"(?P<comment><!--|<!\[CDATA\[)|<(?P<raw>pre|script|style|head)\b[^<>]*>",
    "markdown": r"^ {0,3}(?P<fence>`{3,}|~{3,})[^\n]*(?:\n|\Z)|(?<!`)(?P<tick>`+)(?!`)",
    "wiki": r"<(?P<wiki>nowiki|ref)\b[^<>]*(?<!/)>",
    "latex": r"\\begin\{(?P<env>verbatim|lstlisting|equation|align|gather|multline|displaymath)(?P<star>\*?)\}|(?<!\\)\\(?P<slash>[\[(])|(?P<dollar>\$\$?)",
}
_blank_line = re.compile(r"\n[ \t]*\n")
_formula = re.compile(r"\\[a-zA-Z]|(?<![^\W_]{2})[_^]\{?\w")
_command_in = re.compile(r"\\[a-zA-Z]")


@lru_cache(64)
def _opening(languages: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(_OPENINGS[x] for x in languages), re.M | re.I)


@lru_cache(256)
def _literal(mark: str) -> re.Pattern:
    return re.compile(re.escape(mark))


@lru_cache(64)
def _end_tag(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>", re.I)


@lru_cache(256)
def _fence_end(mark: str) -> re.Pattern:
    return re.compile(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", re.M)


@lru_cache(256)
def _tick_end(mark: str) -> re.Pattern:
    return re.compile(rf"(?<!`){mark}(?!`)")


def spans(text: str, languages: tuple[str, ...]) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, what, body) of the spans that no other rule may look into, from
    left to right and none inside another. what: comment, raw element's name,
    fence, tick, nowiki, ref, code (a verbatim environment), display or inline."""
    opening = _opening(languages)
    ahead = Ahead(text)
    at = 0
    while m := opening.search(text, at):
        at = body = m.end()
        kind = m.lastgroup if m.lastgroup != "star" else "env"
        mark = m[kind]
        what = kind
        if kind == "comment":
            end = ahead.find(_literal("-->" if mark == "<!--" else "]]>"), body)
        elif kind in ("raw", "wiki"):
            what = mark.lower()
            end = ahead.find(_end_tag(what), body)
        elif kind == "fence":
            end = ahead.find(_fence_end(mark), body)
            if end is None:  # an open fence goes on to the end
                yield m.start(), len(text), what, text[body:]
                return
        elif kind == "tick":
            end = ahead.find(_tick_end(mark), body)
            line = ahead.find(_literal("\n"), body)
            if end is None or end.start() == body or (line is not None and line.start() < end.start()):
                continue
        else:
            if kind == "env":
                what = "code" if mark in ("verbatim", "lstlisting") else "display"
                end = ahead.find(_literal(f"\\end{{{mark}{m['star']}}}"), body)
            else:
                what = "display" if mark in ("[", "$$") else "inline"
                end = ahead.find(_literal({"[": "\\]", "(": "\\)"}.get(mark, mark)), body)
            if end is None:
                continue
            if what != "code":
                blank = ahead.find(_blank_line, body)
                if blank is not None and blank.start() < end.start():  # a formula has no blank line
                    continue
            if mark == "$":
                inside = text[body : end.start()]
                # tight signs around an index or power, or a command: not two prices
                tight = inside and not inside[0].isspace() and not inside[-1].isspace() and not text[end.end() : end.end() + 1].isdigit()
                if not (_formula.search(inside) if tight else _command_in.search(inside) and "\n" not in inside):
                    continue
            elif what != "code" and not text[body : end.start()].strip():
                continue
        if end is None:
            continue
        yield m.start(), end.end(), what, text[body : end.start()]
        at = end.end()


def without(text: str, languages: tuple[str, ...], dropped: frozenset[str] | None = None) -> str:
    """The text with a space for each span, or for those of ``dropped``."""
    out, last = [], 0
    for start, end, what, _ in spans(text, languages):
        if dropped is None or what in dropped:
            out += [text[last:start], " "]
            last = end
    return "".join(out) + text[last:]


# ----------------------------------------------------------------------- kinds
_tag = re.compile(r"<(/?)(%s)(?:\s[^<>]*|\s*/)?>" % "|".join(sorted(TAGS, key=len, reverse=True)), re.I)
_entity = re.compile(r"&(?:[a-zA-Z][a-zA-Z0-9]{1,30}|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});")
_doctype = re.compile(r"<!DOCTYPE[^<>]*>", re.I)
_markup_span = frozenset(("comment", "pre", "script", "style"))
_md = re.compile(
    r"^ {0,3}#{1,6} +\S"  # heading
    r"|^ {0,3}(?:```|~~~)"  # fence
    r"|\*\*(?=[^\s*])[^*\n]*[^\s*]\*\*|~~(?=\S)[^~\n]*\S~~"
    r"|(?<![\w*])\*(?=[^\W\d_])[^*\n]*[^\W\d_]\*(?![\w*])|(?<!\w)_(?=[^\W\d_])[^_\n]*[^\W\d_]_(?!\w)"
    r"|(?<!`)`[^`\n]+`(?!`)"
    r"|!?\[[^\[\]\n]*\]\([^()\s]+\)|^ {0,3}\[[^\]\n]+\]:\s+\S+://"
    r"|^[ \t]*(?:\|[ \t]*)?:?-{3,}:?[ \t]*\|[-:| ]*$"  # table rule
    r"|^[ \t]*[-*+] \[[ xX]\] "  # task list
    r"|^ {0,3}>+ \S",
    re.M,
)
_double = re.compile(r"(?P<open>(?<![\w_])__(?=[^\s_]))|(?P<close>(?<=[^\s_])__(?![\w_]))|\n")
_wiki = re.compile(
    r"\[\[[^\[\]\n]+\]\]|\{\{[^{}]+\}\}|^[ \t]*\{\|.*$|^\|\}[ \t]*$|'''?(?=[^\s'])[^'\n]+'''?"
    r"|^ *(={2,6})[^=\n].*?\1(?: |$)|\[https?://[^\s\]]+(?: [^\]\n]*)?\]|</?(?:ref|nowiki|gallery)\b[^<>]*>|__(?:NO)?(?:TOC|EDITSECTION)__|#(?:REDIRECT|ПЕРЕНАПРАВЛЕНИЕ)\b",
    re.M,
)
_latex = re.compile(r"\\(?:%s)(?![a-zA-Z])|\\[a-zA-Z]+\{" % "|".join(sorted(COMMANDS, key=len, reverse=True)))
_hint = re.compile(r"[<&\\#*_~`\[\]{}'|=>$]")


def doubled(text: str) -> Iterator[tuple[int, int]]:
    """Places of the two marks of each ``__strong__`` run; runs end with the line."""
    opened = None
    for m in _double.finditer(text):
        if m["close"] and opened is not None and m.start() > opened + 2:
            yield opened, m.start()
            opened = None
        elif m["open"]:
            opened = m.start() if opened is None else opened
        elif not m["close"]:
            opened = None


def kinds(text: str) -> list[str]:
    """Kinds of markup in the text, of html, latex, markdown and wiki."""
    if not text or not _hint.search(text):
        return []
    found = []
    outside = text
    if "<" in text or "&" in text:
        if _tag.search(text) or _entity.search(text) or _doctype.search(text) or "<!" in text and any(s[2] == "comment" for s in spans(text, ("html",))):
            found.append("html")
            outside = _doctype.sub(" ", without(text, ("html",), _markup_span))
            outside = _entity.sub(" ", _tag.sub(" ", outside))
    if ("\\" in outside or "$" in outside) and (_latex.search(outside) or next(spans(outside, ("latex",)), None)):
        found.append("latex")
    bare = outside
    if "```" in outside:
        parts, last = [], 0
        for start, end, what, _ in spans(outside, ("markdown",)):
            if what == "fence":
                parts += [outside[last:start], "```\n"]
                last = end
        bare = "".join(parts) + outside[last:]
    if _md.search(bare) or "__" in bare and next(doubled(bare), None):
        found.append("markdown")
    if _wiki.search(bare):
        found.append("wiki")
    return found


# ---------------------------------------------------------------- cleaning
Rope = list  # strings and ropes, in order


def flat(rope: Rope) -> str:
    """The text of a rope, without recursion."""
    out: list[str] = []
    todo = [iter(rope)]
    while todo:
        for x in todo[-1]:
            if isinstance(x, str):
                out.append(x)
            else:
                todo.append(iter(x))
                break
        else:
            todo.pop()
    return "".join(out)


def clean_html(t: str) -> str:
    """Tags replaced by the notation; entities are not touched."""
    out: list[str] = []
    last = cells = 0
    level = ""  # of the open heading
    glued = False  # white space next is dropped
    for m in _tag.finditer(t):
        piece = t[last : m.start()]
        last = m.end()
        if level:
            piece = " ".join(piece.split("\n"))
        out.append(piece.lstrip() if glued else piece)
        glued = False
        name, ends = m[2].lower(), bool(m[1])
        if name in ("td", "th"):
            if not ends:
                out.append(" | " if cells else "")
                cells += 1
            glued = True
        elif name == "li" and not ends:
            out.append("\n- ")
            glued = True
        elif name in BLOCKS:
            level = name[1] if not ends and name[0] == "h" and name[1:].isdigit() else ""
            out.append("\n" + "#" * int(level) + " " if level else "\n")
            cells = 0
            glued = bool(level) or name in ("tr", "table")
    piece = t[last:]
    out.append(piece.lstrip() if glued and last else piece)
    return "".join(out)


_wiki_mark = re.compile(r"\[\[|\]\]|\{\{|\}\}|\|")


def _shown(mark: str, parts: list[Rope]) -> Rope:
    """What stays of a link or template, given its parts between the bars."""
    first = parts[0][0] if parts[0] and isinstance(parts[0][0], str) else ""
    if mark == "[[":
        space = first.partition(":")[0].strip().lower() if ":" in first else ""
        if space in CATEGORIES or space in PICTURES and len(parts) == 1:
            return []
        return parts[-1]
    values: Rope = []
    for part in parts[1:]:
        head = part[0] if part and isinstance(part[0], str) else ""
        name, equals, rest = head.partition("=")
        name = name.strip()
        if equals and "\n" not in name:
            if len(part) == 1 and not rest.strip():
                continue
            label = f"{name}: " if name and not name.isdigit() else ""
            values += ["\n", label, rest.strip() if len(part) == 1 else rest.lstrip(), *part[1:]]
        elif part:
            values += [" " if values else "", part]
    return values


def clean_templates(t: str) -> str:
    """Links as their labels, templates as their values, at any depth; marks
    without a partner stay."""
    frames: list[tuple[str, list[Rope]]] = [("", [[]])]
    last = 0
    for m in _wiki_mark.finditer(t):
        parts = frames[-1][1]
        if m.start() > last:
            parts[-1].append(t[last : m.start()])
        last = m.end()
        mark = m[0]
        if mark == "|":
            if len(frames) > 1:
                parts.append([])
            else:
                parts[-1].append("|")
        elif mark in ("[[", "{{"):
            frames.append((mark, [[]]))
        elif len(frames) > 1 and frames[-1][0] == ("[[" if mark == "]]" else "{{"):
            frames.pop()
            frames[-1][1][-1].append(_shown("[[" if mark == "]]" else "{{", parts))
        else:
            parts[-1].append(mark)
    rope: Rope = []
    for mark, parts in frames:
        rope.append(mark)
        for i, part in enumerate(parts):
            rope += ["|", part] if i else [part]
    rope.append(t[last:])
    return flat(rope)


_attributes = re.compile(r'\s*[\w-]+\s*=\s*(?:"[^"]*"|[^\s"|]+)(?:\s+[\w-]+\s*=\s*(?:"[^"]*"|[^\s"|]+))*\s*\|(?!\|)')
_wiki_heading = re.compile(r" *(={2,6})(?=[^=\n])")


def _heading_line(line: str) -> str:
    m = _wiki_heading.match(line)
    if not m:
        return line
    mark = m[1]
    at = line.find(mark, m.end() + 1)
    while at >= 0 and line[at + len(mark) : at + len(mark) + 1] not in ("", " "):
        at = line.find(mark, at + 1)
    if at < 0:
        return line
    rest = line[at + len(mark) + 1 :]
    return "#" * len(mark) + " " + line[m.end() : at].strip() + "\n" + rest


def clean_wiki_lines(t: str) -> str:
    """Headings and tables; a table's rows become ``a | b`` lines."""
    lines = t.split("\n")
    ends = [i for i, x in enumerate(lines) if x.startswith("|}")]
    last_end = ends[-1] if ends else -1
    out: list[str] = []
    cells: list[list[str]] | None = None  # of the row of the open table

    def row() -> None:
        if cells:
            out.append(" | ".join(" ".join(c).strip() for c in cells))

    for i, line in enumerate(lines):
        if cells is None:
            if line.lstrip(" \t").startswith("{|") and i < last_end:
                cells = []
            else:
                out.append(_heading_line(line))
        elif line.startswith("|}"):
            row()
            cells = None
            if line[2:].strip():
                out.append(line[2:])
        elif line.startswith(("|-", "|+")):
            row()
            cells = []
            if line[1] == "+":
                out.append(line[2:].strip())
        elif line[:1] in ("|", "!"):
            for cell in re.split(r"\|\||!!" if line[0] == "!" else r"\|\|", line[1:]):
                bare = _attributes.match(cell)
                cells.append([cell[bare.end() :].strip() if bare else cell.strip()])
        elif cells:
            cells[-1].append(line)
        else:
            out.append(line)
    row()
    return "\n".join(out)


_external = re.compile(r"\[https?://[^\s\]]+ ?([^\]\n]*)\]")
_reference = re.compile(r"<ref\b[^<>]*/>|</?(?:ref|nowiki|gallery)\b[^<>]*>", re.I)


def clean_wiki(t: str) -> str:
    t = _external.sub(r"\1", clean_templates(t))
    t = re.sub(r"'''''|'''|''", "", t)
    return _reference.sub("", clean_wiki_lines(t))


_tex_mark = re.compile(r"\\([a-zA-Z]+\*?)|\\(.)|[{}&]", re.S)
_optional = re.compile(r"\[[^\[\]{}]*\]")
_argument = re.compile(r"\{([^{}\n]*)\}")
_letter = re.compile(r"\{([a-zA-Z])\}|([a-zA-Z])")


def clean_latex(t: str) -> str:
    """Commands replaced by the text of their arguments, at any depth; braces that
    belong to no command and unknown commands without an argument stay."""
    frames: list[tuple[str, Rope]] = [("", [])]
    at = tables = 0
    while m := _tex_mark.search(t, at):
        rope = frames[-1][1]
        if m.start() > at:
            rope.append(t[at : m.start()])
        at = m.end()
        if m[0] == "&":
            rope.append(" | " if tables else "&")
        elif m[0] == "{":
            frames.append(("{", []))
        elif m[0] == "}":
            if len(frames) == 1:
                rope.append("}")
                continue
            name, inner = frames.pop()
            outer = frames[-1][1]
            if name == "{":
                outer += ["{", inner, "}"]
            elif name in LEVELS:
                outer += ["\n", "#" * LEVELS[name], " ", inner, "\n"]
            elif name in SECOND and t[at : at + 1] == "{":
                frames.append(("", []))
                at += 1
            elif name not in DROPPED:
                outer.append(inner)
                if name and name != "{switch" and t[at : at + 1] == "{":  # its next argument
                    outer.append("/" if name == "frac" else " ")
                    frames.append(("", []))
                    at += 1
        elif m[2] is not None:
            sign = m[2]
            base = _letter.match(t, at) if sign in ACCENTS else None
            if base:
                rope.append(unicodedata.normalize("NFC", (base[1] or base[2]) + ACCENTS[sign]))
                at = base.end()
            elif sign in "%&$#_{}":
                rope.append(sign)
            elif sign == "\\":
                rope.append("\n" if tables else " ")
            elif sign in ",;:! ":
                rope.append(" ")
            elif sign != "-":
                rope.append(m[0])
        else:
            name = m[1].rstrip("*")
            end = at
            while option := _optional.match(t, end):
                end = option.end()
            if name in ("begin", "end"):
                argument = _argument.match(t, at)
                if argument:
                    at = argument.end()
                    if argument[1] in TABULAR:
                        tables = max(0, tables + (1 if name == "begin" else -1))
                    while name == "begin" and (extra := _optional.match(t, at) or (_argument.match(t, at) if argument[1] in TABULAR else None)):
                        at = extra.end()
                else:
                    rope.append(m[0])
            elif name == "item":
                rope.append("- ")
                at = end
                while t[at : at + 1] in (" ", "\t"):
                    at += 1
            elif t[end : end + 1] == "{":
                if name in ("ref", "eqref") and rope and isinstance(rope[-1], str) and rope[-1][-1:] in ("~", " "):
                    rope[-1] = rope[-1][:-1]
                frames.append((name, []))
                at = end + 1
            elif name in SWITCHES:
                if frames[-1][0] == "{" and all(isinstance(x, str) and x.isspace() for x in rope):
                    frames[-1] = ("{switch", rope)
                if t[at : at + 1].isspace():
                    at += 1
            elif name in ("ldots", "dots"):
                rope.append("…")
            else:
                rope.append(m[0])
    whole: Rope = []
    for name, rope in frames:
        whole += ["{" if name else "", rope]
    whole.append(t[at:])
    return flat(whole)


_link = re.compile(r"!?\[([^\[\]\n]*)\]\([^()\s]+\)")
_strong = re.compile(r"\*\*([^*\n]+)\*\*|~~([^~\n]+)~~")
_slanted = re.compile(r"(?<![\w*])\*(?=[^\W\d_])([^*\n]*[^\W\d_])\*(?![\w*])|(?<!\w)_(?=[^\W\d_])([^_\n]*[^\W\d_])_(?!\w)")
_rule = re.compile(r"^[ \t]*(?:\|[ \t]*)?:?-{3,}:?[ \t]*\|[-:| ]*$\n?", re.M)
_bullet = re.compile(r"^([ \t]*)[-*+] (?:\[[ xX]\] )?", re.M)
_quote = re.compile(r"^ {0,3}>+ ?", re.M)


def clean_markdown(t: str) -> str:
    t = _strong.sub(lambda m: m[1] or m[2], _link.sub(r"\1", t))
    parts, last = [], 0
    for a, b in doubled(t):
        parts += [t[last:a], t[a + 2 : b]]
        last = b + 2
    t = "".join(parts) + t[last:]
    t = _rule.sub("", _slanted.sub(lambda m: m[1] or m[2], t))
    t = _quote.sub("", _bullet.sub(r"\1- ", t))
    lines = t.split("\n")
    for i, line in enumerate(lines):
        bare = line.strip(" \t")
        if len(bare) > 1 and bare[0] == bare[-1] == "|":
            lines[i] = bare[1:-1].strip()
    return "\n".join(lines)


def _free_sign(text: str) -> str:
    """A private character the text does not hold."""
    return next(c for c in map(chr, chain(range(0xE000, 0xF900), range(0xF0000, 0x110000))) if c not in text)


def clean(text: str | None, found: list[str] | None = None) -> str | None:
    """Text without markup; headings, lists, code blocks and formulas stay visible.

    A text without markup is returned as it is; NULL gives NULL. ``found``: its
    kinds, where they are known already."""
    found = (kinds(text) if text else []) if found is None else found
    if not found:
        return text
    t = text.replace("\r\n", "\n")
    sign = _free_sign(t)
    kept: list[str] = []
    out: list[str] = []
    last = 0

    def keep(s: str) -> str:
        kept.append(s)
        return f"{sign}{len(kept) - 1}{sign}"

    for start, end, what, body in spans(t, tuple(found)):
        out.append(t[last:start])
        last = end
        if what in ("pre", "fence", "code"):
            body = html.unescape(_tag.sub("", body)) if what == "pre" else body
            out.append("\n" + keep("```\n" + body.strip("\n") + "\n```") + "\n")
        elif what in ("tick", "nowiki"):
            out.append(keep(body))
        elif what == "display":
            out.append("\n" + keep(f"$$ {body.strip()} $$") + "\n")
        elif what == "inline":
            out.append(keep(f"${body if t[start] == '$' else body.strip()}$"))
    t = "".join(out) + t[last:]
    if "html" in found:
        t = html.unescape(clean_html(_doctype.sub("", t)))
        if "<" in t:  # escaped tags and comments
            t = clean_html(without(t, ("html",), frozenset(("comment",))))
    if "wiki" in found:
        t = clean_wiki(t)
    if "latex" in found:
        t = clean_latex(t)
    if "markdown" in found:
        t = clean_markdown(t)
    t = re.sub(r"[ \t\xa0]+", " ", t)
    t = re.sub(r"\n[ \t]*\n[ \t\n]*\n", "\n\n", t).strip()
    return re.sub(f"{sign}(\\d+){sign}", lambda m: kept[int(m[1])], t)


def clean_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, kinds, clean_text) of every document; narrow, one pass.

    kinds is empty where the text carries no markup; then clean_text is the text.
    A NULL text has no kinds and a NULL clean_text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [kinds(t) if t else [] for t in b["text"]]
            texts = [clean(t, k) for t, k in zip(b["text"], found)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "kinds": found, "clean_text": texts})

    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return source.mapInPandas(run, "doc_id bigint, kinds array<string>, clean_text string")


def markup_kinds(cleaned: DataFrame) -> DataFrame:
    """(doc_id, kind) for every kind of markup of a document."""
    return cleaned.select("doc_id", F.explode("kinds").alias("kind"))
