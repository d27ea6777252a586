"""The boolean query language: words, AND, OR, NOT, parentheses.

Grammar: or = and (OR and)*; and = not (AND not)*; not = NOT not | primary;
primary = word | '(' or ')'. NOT binds closest, then AND, then OR; there is no
implicit AND. The lenient mode forgives: signs that belong to no token vanish, a
missing operand is the empty set, a closing parenthesis may be missing, whatever
stands in its place is skipped, and what follows a whole expression is ignored. The
strict mode raises QueryError instead.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs of a word besides ASCII letters and digits; every character
# outside ASCII belongs to words as well.
WORD_SIGNS = "_-'"
KEYWORDS = {"and": "AND", "or": "OR", "not": "NOT"}


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Term:
    word: str


@dataclass(frozen=True)
class Not:
    part: Node | None


@dataclass(frozen=True)
class And:
    left: Node | None
    right: Node | None


@dataclass(frozen=True)
class Or:
    left: Node | None
    right: Node | None


Node = Term | Not | And | Or


def _ascii_lower(s: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in s)


def _full_fold(s: str) -> str:
    return unicodedata.normalize("NFKC", s).lower()


FOLDS: dict[str, Callable[[str], str]] = {"ascii": _ascii_lower, "full": _full_fold}


def lex(query: str, strict: bool = False, fold: str = "ascii") -> Iterator[tuple[str, str]]:
    """(kind, text) tokens; kind is TERM, AND, OR, NOT, ( or )."""
    word = ""
    for c in query + "\0":
        if c != "\0" and (not c.isascii() or c.isalnum() or c in WORD_SIGNS):
            word += c
            continue
        if word:
            kind = KEYWORDS.get(_ascii_lower(word))
            yield (kind, word) if kind else ("TERM", FOLDS[fold](word))
            word = ""
        if c in "()":
            yield c, c
        elif strict and c != "\0" and not c.isspace():
            raise QueryError(f"unexpected sign {c!r}")


def parse_query(query: str, strict: bool = False, fold: str = "ascii") -> Node:
    """Syntax tree of a query. An empty one, or one that starts with a closing
    parenthesis or is only a pair of them, is an error in either mode."""
    tokens = list(lex(query, strict, fold))
    at = 0

    def kind() -> str:
        return tokens[at][0] if at < len(tokens) else "END"

    def either() -> Node | None:
        nonlocal at
        left = both()
        while kind() == "OR":
            at += 1
            left = Or(left, both())
        return left

    def both() -> Node | None:
        nonlocal at
        left = negated()
        while kind() == "AND":
            at += 1
            left = And(left, negated())
        return left

    def negated() -> Node | None:
        nonlocal at
        if kind() == "NOT":
            at += 1
            return Not(negated())
        return primary()

    def primary() -> Node | None:
        nonlocal at
        if kind() == "TERM":
            at += 1
            return Term(tokens[at - 1][1])
        if kind() == "(":
            at += 1
            inner = either()
            if strict and kind() != ")":
                raise QueryError("missing )")
            at += 1
            return inner
        if strict:
            raise QueryError("missing operand")
        return None

    tree = either()
    if tree is None:
        raise QueryError("empty query")
    if strict and kind() != "END":
        raise QueryError(f"unexpected {tokens[at][1]!r}")
    return tree


def terms_of(node: Node | None) -> list[str]:
    """Distinct words of a tree in order of appearance."""
    match node:
        case None:
            return []
        case Term(word):
            return [word]
        case Not(part):
            return terms_of(part)
        case And(a, b) | Or(a, b):
            return list(dict.fromkeys(terms_of(a) + terms_of(b)))


def to_column(node: Node | None, flag: Callable[[str], Column]) -> Column:
    """One boolean expression; ``flag`` gives a word's never-NULL column."""
    match node:
        case None:
            return F.lit(False)
        case Term(word):
            return flag(word)
        case Not(part):
            return ~to_column(part, flag)
        case And(a, b):
            return to_column(a, flag) & to_column(b, flag)
        case Or(a, b):
            return to_column(a, flag) | to_column(b, flag)


def holds(node: Node | None, words: set[str]) -> bool:
    """Value of the tree for a document with these words."""
    match node:
        case None:
            return False
        case Term(word):
            return word in words
        case Not(part):
            return not holds(part, words)
        case And(a, b):
            return holds(a, words) and holds(b, words)
        case Or(a, b):
            return holds(a, words) or holds(b, words)


def print_query(node: Node | None) -> str:
    """A query that parses to the same tree."""
    match node:
        case None:
            return "()"
        case Term(word):
            return word
        case Not(part):
            return f"NOT {print_query(part)}"
        case And(a, b):
            return f"({print_query(a)} AND {print_query(b)})"
        case Or(a, b):
            return f"({print_query(a)} OR {print_query(b)})"


def explain_query(query: str | Node, strict: bool = False) -> str:
    """The tree, one node a line, two spaces for each level."""
    node = parse_query(query, strict) if isinstance(query, str) else query

    def lines(n: Node | None, depth: int) -> Iterator[str]:
        pad = "  " * depth
        match n:
            case None:
                yield pad + "EMPTY"
            case Term(word):
                yield f"{pad}TERM {word}"
            case Not(part):
                yield pad + "NOT"
                yield from lines(part, depth + 1)
            case And(a, b) | Or(a, b):
                yield pad + type(n).__name__.upper()
                yield from lines(a, depth + 1)
                yield from lines(b, depth + 1)

    return "\n".join(lines(node, 0))
