"""One form for texts that look the same.

A trie holds the spellings of the vocabulary by their own characters, a base with
its marks for one. A spelling is a weighted edit automaton over units: the parts of
its characters once compatibility forms are taken apart. An edge of the trie is read
unit by unit, so ``Ⅵ`` are the steps V and I; look-alikes are the same unit, invisible
characters none at all, and neither costs anything; any other edit costs ``EDIT``. A
traversal of the trie follows the automaton within a bound; what it reaches at cost 0
is the same to the eye, and of those spellings the canonical one is chosen. A spelling
that reaches no other is normalised by table.

Only distinct strings are compared, so a title that a third of all rows share is
one string. They are spread over tasks by a signature, the same for strings with the
same units in any order; each signature has a trie of its own. A signature of very
many spellings is split into shards, whose classes are brought together by a second
traversal over one spelling of each.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import fragment_replicate_join
from ..session import written
from .text import canonical, skeleton

EDIT = 1  # cost of a unit put in, left out or replaced
BLOCK_STRINGS = 50_000  # spellings of one signature in one trie, about
CLASS_SCHEMA = "spelling string, class_id string, canonical string, n_spellings int, matched boolean"
TRIE_SCHEMA = f"weight bigint, oddness int, normal string, {CLASS_SCHEMA}"


@lru_cache(100_000)
def _joins(c: str) -> bool:
    """Whether a character is a mark on the one before it."""
    return c > "˿" and unicodedata.combining(unicodedata.normalize("NFKD", c)[0]) > 0


@lru_cache(100_000)
def units(character: str) -> str:
    """What is read of a character with its marks: look-alikes have the same units,
    an invisible character has none."""
    return skeleton(character)


def characters(spelling: str) -> list[str]:
    """Characters of a string, marks with their base."""
    if spelling.isascii():
        return list(spelling)
    out: list[str] = []
    for c in spelling:
        if out and _joins(c):
            out[-1] += c
        else:
            out.append(c)
    return out


class Trie:
    """Spellings by their own characters."""

    __slots__ = ("next", "ends")

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.ends: dict[int, str] = {}

    def add(self, spelling: str) -> int:
        node = 0
        for c in characters(spelling):
            to = self.next[node].get(c)
            if to is None:
                to = self.next[node][c] = len(self.next)
                self.next.append({})
            node = to
        self.ends[node] = spelling
        return node


class Automaton:
    """Weighted edit automaton of a spelling. A state is the number of units read,
    with its least cost; states above ``bound`` are given up."""

    def __init__(self, spelling: str, bound: int = 0):
        self.units = "".join(map(units, characters(spelling)))
        self.bound = bound

    def start(self) -> dict[int, int]:
        return self._skipping({0: 0})

    def _skipping(self, states: dict[int, int]) -> dict[int, int]:
        """With the states reached by leaving units of the spelling out."""
        for place in sorted(states):
            cost = states[place] + EDIT
            while cost <= self.bound and place < len(self.units) and cost < states.get(place + 1, self.bound + 1):
                place += 1
                states[place] = cost
                cost += EDIT
        return states

    def step(self, states: dict[int, int], unit: str) -> dict[int, int]:
        """States after one unit of the vocabulary's spelling."""
        after: dict[int, int] = {}
        for place, cost in states.items():
            if place < len(self.units):
                change = cost if self.units[place] == unit else cost + EDIT
                if change <= self.bound:
                    after[place + 1] = min(change, after.get(place + 1, change))
            if cost + EDIT <= self.bound:
                after[place] = min(cost + EDIT, after.get(place, cost + EDIT))
        return self._skipping(after)

    def reach(self, trie: Trie) -> dict[int, int]:
        """Ends of the trie within the bound, and their cost. Branches without a
        state left are not entered."""
        found: dict[int, int] = {}
        todo = [(0, self.start())]
        while todo:
            node, states = todo.pop()
            if node in trie.ends and len(self.units) in states:
                found[node] = states[len(self.units)]
            for character, to in trie.next[node].items():
                after = states
                for unit in units(character):
                    after = self.step(after, unit)
                    if not after:
                        break
                if after:
                    todo.append((to, after))
        return found


def classes_of(spellings: list[str]) -> dict[str, str]:
    """The class of each spelling: the least of those it reaches at no cost. A
    class is traversed once, from its first spelling."""
    trie = Trie()
    node_of = {s: trie.add(s) for s in spellings}
    found: dict[str, str] = {}
    for s in sorted(node_of):
        if s not in found:
            for node in Automaton(s).reach(trie):
                found[trie.ends[node]] = s
    return found


class _Mixed(dict):
    def __missing__(self, unit: str) -> int:
        x = ord(unit) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
        x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        self[unit] = x ^ x >> 32
        return self[unit]


_mixed = _Mixed()


def signature(spelling: str) -> int:
    """A number of the units of a string, whatever their order."""
    read = skeleton(spelling) if spelling.isascii() else "".join(map(units, characters(spelling)))
    return (sum(map(_mixed.__getitem__, read)) & (1 << 64) - 1) - (1 << 63)


def oddness(spelling: str, plain: str) -> int:
    """Characters that table normalisation changes, and words that mix scripts."""
    odd = sum(a != b for a, b in zip(spelling, plain)) + abs(len(spelling) - len(plain))
    mixed = 0
    for word in plain.split(" "):
        scripts = {"latin" if c < "ɐ" else "greek" if c < "Ѐ" else "cyrillic" for c in word if c.isalpha()}
        mixed += len(scripts) > 1
    return odd + 2 * mixed


def _judged(held: list[tuple[str, int]]) -> list[tuple]:
    """Rows of TRIE_SCHEMA of the spellings of a block with their weights."""
    own = classes_of([s for s, _ in held]) if len(held) > 1 else {s: s for s, _ in held}
    judged = [(n, oddness(s, plain := canonical(s)), plain, s, own[s]) for s, n in held]
    count = Counter(own.values())
    best: dict[str, tuple] = {}
    for n, odd, plain, s, c in judged:
        best[c] = min(best.get(c, (odd, -n, s, plain)), (odd, -n, s, plain))
    return [(*row, best[row[-1]][-1], count[row[-1]], count[row[-1]] > 1) for row in judged]


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (block, shard, spelling, weight) sorted by block and shard, each with its own trie."""
    columns = ["weight", "oddness", "normal", "spelling", "class_id", "canonical", "n_spellings", "matched"]
    block, held, rows = None, [], []
    for b in batches:
        for key, s, n in zip(zip(b["block"], b["shard"]), b["spelling"], b["weight"]):
            if key != block:
                rows += _judged(held)
                block, held = key, []
                if len(rows) >= 10_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            held.append((s, int(n)))
    rows += _judged(held)
    if rows:
        yield pd.DataFrame(rows, columns=columns)


@F.pandas_udf(T.LongType())
def _signatures(s: pd.Series) -> pd.Series:
    return s.map(signature)


def _traversed(signed: DataFrame) -> DataFrame:
    return signed.repartition("block", "shard").sortWithinPartitions("block", "shard", "spelling").select("block", "shard", "spelling", "weight").mapInPandas(_gathered, TRIE_SCHEMA)


def spelling_classes(df: DataFrame, text: str, block_strings: int = BLOCK_STRINGS) -> DataFrame:
    """Every distinct non-NULL string of a column with its class.

    Columns: spelling, class_id (the least spelling of those that look the same),
    canonical, n_spellings (of the class), matched (whether the class has more
    than one). Canonical is the least odd spelling, then the most frequent, then
    the first in code-point order; always in its table-normalised form. The empty
    string is in a class with strings of nothing but invisible characters.
    Written to the shared folder."""
    distinct = df.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("spelling")).agg(F.count(F.lit(1)).alias("weight"))
    signed = written(distinct.withColumn("block", _signatures("spelling")), "signed")
    heavy = signed.groupBy("block").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_strings)
    heavy = written(heavy.select("block", F.ceil(F.col("_n") / block_strings).cast("int").alias("shards")), "heavy")
    columns = ["spelling", "class_id", "canonical", "n_spellings", "matched"]
    if heavy.isEmpty():
        return written(_traversed(signed.withColumn("shard", F.lit(0))).select(*columns), "classes")
    # a block's own shards, then one spelling of each class found in them
    shard = F.coalesce(F.pmod(F.xxhash64("spelling"), F.col("shards")), F.lit(0)).cast("int")
    first = written(_traversed(signed.join(heavy, "block", "left").withColumn("shard", shard)).drop("canonical", "n_spellings", "matched"), "classes")
    ones = first.where("spelling = class_id").select("spelling", "weight", _signatures("spelling").alias("block"), F.lit(0).alias("shard"))
    merged = _traversed(ones).select(F.col("spelling").alias("class_id"), F.col("class_id").alias("_class"))
    joined = fragment_replicate_join(first, merged, "class_id", "spelling", "inner")
    classes = written(joined.drop("class_id").withColumnRenamed("_class", "class_id"), "classes")
    order = F.struct("oddness", (-F.col("weight")).alias("weight"), "spelling")
    chosen = classes.groupBy("class_id").agg(F.min_by("normal", order).alias("canonical"), F.count(F.lit(1)).cast("int").alias("n_spellings"))
    whole = fragment_replicate_join(classes.select("spelling", "class_id"), chosen, "class_id", "spelling", "inner")
    return written(whole.withColumn("matched", F.col("n_spellings") > 1).select(*columns), "classes")


def normalise(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``<text>_normal``, the canonical spelling of the column; NULL
    stays NULL, and a column of that name is replaced. Rows of a frequent string
    are split over the tasks."""
    name = f"{text}_normal"
    df = df.drop(name)
    classes = spelling_classes(df, text).select(F.col("spelling").alias(text), F.col("canonical").alias(name))
    others = [c for c in df.columns if c != text]
    spread = df.withColumn("_spread", F.xxhash64(*others, F.spark_partition_id()))
    return fragment_replicate_join(spread, classes, text, "_spread").drop("_spread")


def latest_pages(pages: DataFrame) -> DataFrame:
    """One row (id, title) per page id: of repeated deliveries the last processed."""
    order = F.struct(F.coalesce(F.col("processed_at").cast("string"), F.lit("")), F.coalesce("title", F.lit("")))
    return pages.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by("title", order).alias("title"))


def same_looking_pages(pages: DataFrame) -> DataFrame:
    """(page_a, page_b), page_a < page_b: two pages with unequal titles that look
    the same. NULL titles have no partner.

    Spellings are paired first, and pages with an equal title are never compared;
    the pages of a spelling are then found by fragment-replicate joins, so a title
    that a third of all pages share is spread over the tasks."""
    latest = written(latest_pages(pages).where(F.col("title").isNotNull()), "pages")
    matched = spelling_classes(latest, "title").where("matched").select("spelling", "class_id")
    one = matched.select(F.col("spelling").alias("title_a"), "class_id")
    other = matched.select(F.col("spelling").alias("title_b"), "class_id")
    pairs = fragment_replicate_join(one, other, "class_id", "title_a", "inner").where("title_a < title_b").select("title_a", "title_b")
    a = latest.select(F.col("id").alias("a"), F.col("title").alias("title_a"))
    b = latest.select(F.col("id").alias("b"), F.col("title").alias("title_b"))
    half = fragment_replicate_join(a, pairs, "title_a", "a", "inner").select("a", "title_b")
    full = fragment_replicate_join(b, half, "title_b", "b", "inner")
    return full.select(F.least("a", "b").alias("page_a"), F.greatest("a", "b").alias("page_b"))
