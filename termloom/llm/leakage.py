"""Evaluation passages inside a training corpus, by greedy string tiling.

The items are indexed by the Karp-Rabin hashes of their word seeds; every
document is read once, its words are mapped to the items' words, and only where
enough consecutive words are known are seeds looked up. Shared seeds grow to
maximal common runs, which are marked longest first and without overlap (tiles),
so reordered passages are covered too.

The items are a stated query set held against all documents: they are sent to
the tasks in blocks of bounded size (MAX_BLOCK_WORDS). Where there are several, the
documents' words are written once, each block has a pass over them whose rows are
written, and its broadcast is given up before the next: neither the driver nor the
tasks hold more than one block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written, written_path
from . import markup
from .text import WORD, fold_word, plain

MIN_RUN = 10  # words of a run that makes a case
MIN_COVERAGE = 0.5  # share of an item's words in tiles that makes a case without such a run
SEED = 5  # words of a seed; at most MIN_RUN
MAX_BLOCK_WORDS = 2_000_000  # words of the items in one broadcast block
CACHE_WORDS = 200_000  # surface words remembered by a task

_BASE = 1_000_003
_MASK = (1 << 61) - 1

SCHEMA = "_k bigint, item_id bigint, longest_run int, tiles int, covered_words int, item_words int, coverage double"


def words_of(text: str | None) -> list[str]:
    """Runs of letters or digits of a text, markup and irregular characters put aside."""
    if not text:
        return []
    return WORD.findall(markup.clean(plain(text)))


def seed_hashes(ids: list[int], size: int) -> list[int]:
    """Rolling Karp-Rabin hashes of all windows of ``size`` ids."""
    n = len(ids) - size + 1
    if n < 1:
        return []
    high = pow(_BASE, size - 1, _MASK)
    h = 0
    for x in ids[:size]:
        h = (h * _BASE + x) % _MASK
    out = [h]
    for i in range(1, n):
        h = ((h - ids[i - 1] * high) * _BASE + ids[i + size - 1]) % _MASK
        out.append(h)
    return out


class ItemIndex:
    """Word ids and seed positions of a block of items."""

    def __init__(self, items: list[tuple[int, str]], seed: int):
        self.seed = seed
        self.ids: dict[str, int] = {}
        self.items = [item for item, _ in items]
        self.words: list[list[int]] = []
        self.seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for number, (_, text) in enumerate(items):
            seq = [self.ids.setdefault(fold_word(w), len(self.ids) + 1) for w in words_of(text)]
            self.words.append(seq)
            for at, h in enumerate(seed_hashes(seq, seed)):
                self.seeds[h].append((number, at))
        self.seeds = dict(self.seeds)
        self.cache: dict[str, int] = {}

    def map_words(self, words: list[str]) -> list[int]:
        """Item word ids of a document's words; 0 for words of no item."""
        cache, ids = self.cache, self.ids
        try:
            return [cache[w] for w in words]
        except KeyError:
            if len(cache) > CACHE_WORDS:
                cache.clear()
            for w in words:
                if w not in cache:
                    cache[w] = ids.get(fold_word(w), 0)
            return [cache[w] for w in words]


def known_stretches(ids: list[int], least: int) -> Iterator[list[int]]:
    """Maximal stretches of at least ``least`` known words."""
    start = 0
    for i, x in enumerate(ids):
        if not x:
            if i - start >= least:
                yield ids[start:i]
            start = i + 1
    if len(ids) - start >= least:
        yield ids[start:]


def tile(item: list[int], stretches: list[list[int]], seed_at: list[list[tuple[int, int]]], seed: int, least: int) -> list[int]:
    """Greedy string tiling of an item against the document's known stretches.

    seed_at: for each stretch the shared seeds as (place in stretch, place in
    item). Returns the lengths of the tiles, longest first; each word of either
    side belongs to one tile at most. Runs shorter than ``least`` are no tiles."""
    used_item = [False] * len(item)
    used = [[False] * len(s) for s in stretches]
    pending = [(k, a, b) for k, at in enumerate(seed_at) for a, b in at]
    lengths: list[int] = []
    while pending:
        found: list[tuple[int, int, int, int]] = []
        covered: set[tuple[int, int, int]] = set()
        alive = []
        for k, a, b in pending:
            s, u = stretches[k], used[k]
            if any(u[a : a + seed]) or any(used_item[b : b + seed]):
                continue
            alive.append((k, a, b))
            if (k, a, b) in covered:
                continue
            lo = 0
            while a - lo > 0 and b - lo > 0 and s[a - lo - 1] == item[b - lo - 1] and not u[a - lo - 1] and not used_item[b - lo - 1]:
                lo += 1
            hi = seed
            while a + hi < len(s) and b + hi < len(item) and s[a + hi] == item[b + hi] and not u[a + hi] and not used_item[b + hi]:
                hi += 1
            covered.update((k, a + d, b + d) for d in range(-lo, hi - seed + 1))
            if lo + hi >= least:
                found.append((lo + hi, k, a - lo, b - lo))
        if not found:
            break
        found.sort(key=lambda x: (-x[0], x[1], x[2], x[3]))
        longest = found[0][0]
        for length, k, a, b in found:
            if length < longest:
                break
            if any(used[k][a : a + length]) or any(used_item[b : b + length]):
                continue
            used[k][a : a + length] = [True] * length
            used_item[b : b + length] = [True] * length
            lengths.append(length)
        pending = alive
    return lengths


def leaks_of(words: list[str], index: ItemIndex, min_run: int, min_coverage: float | None = None) -> list[tuple]:
    """(item_id, longest_run, tiles, covered_words, item_words, coverage) of each
    item of which a document's words hold a run of at least ``min_run`` words, or, if
    ``min_coverage`` is given, tiles that cover that share of its words. Tiles
    are runs from the seed length up. Of several texts of an item the one with the
    longest run counts."""
    ids = index.map_words(words)
    seed = index.seed
    stretches = list(known_stretches(ids, seed))
    if not stretches:
        return []
    shared: dict[int, list[list[tuple[int, int]]]] = {}
    for k, s in enumerate(stretches):
        for a, h in enumerate(seed_hashes(s, seed)):
            for item, b in index.seeds.get(h, ()):
                if s[a : a + seed] == index.words[item][b : b + seed]:
                    shared.setdefault(item, [[] for _ in stretches])[k].append((a, b))
    out: dict[int, tuple] = {}
    for number in sorted(shared):
        item, words = index.items[number], index.words[number]
        lengths = tile(words, stretches, shared[number], seed, seed)
        if lengths and (lengths[0] >= min_run or min_coverage is not None and sum(lengths) >= min_coverage * len(words)):
            row = (item, lengths[0], len(lengths), sum(lengths), len(words), sum(lengths) / len(words))
            if item not in out or row[1:] > out[item][1:]:
                out[item] = row
    return list(out.values())


def item_blocks(items: DataFrame, max_words: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most ``max_words`` words, read one by one; an item
    longer than that is a block of its own. NULL ids and texts are left out, repeated rows
    count once and the texts of one id stay together."""
    rows = items.select(F.col("item_id").cast("bigint"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct().orderBy("item_id", "text")
    block: list[tuple[int, str]] = []
    held = 0
    for item, text in rows.toLocalIterator():
        n = len(text.split())
        if block and held + n > max_words and item != block[-1][0]:
            yield block
            block, held = [], 0
        block.append((item, text))
        held += n
    if block:
        yield block


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    min_run: int = MIN_RUN,
    seed: int = SEED,
    max_block_words: int = MAX_BLOCK_WORDS,
    min_coverage: float | None = None,
) -> DataFrame:
    """Every (document, item) where the document holds a run of at least
    ``min_run`` consecutive words of the item or, if ``min_coverage`` is given,
    runs of at least ``seed`` words in any order that cover that share of it.

    Columns: doc_id, item_id, longest_run, tiles, covered_words, item_words,
    coverage (share of the item's words that lie in tiles). Copies of a document
    are cases of their own; NULL or empty texts have none; no items give an
    empty result."""
    assert 1 <= seed <= min_run
    sc = documents.sparkSession.sparkContext
    source = documents.select(F.col("doc_id").cast("bigint").alias("_k"), F.col("text").alias("_t"))

    def tiled(block: Broadcast, rows: DataFrame, split: Callable[[str | None], list[str]]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = ItemIndex(block.value, seed)
            for b in batches:
                found = [(k, *x) for k, t in zip(b["_k"], b["_t"]) for x in leaks_of(split(t), index, min_run, min_coverage)]
                yield pd.DataFrame(found, columns=["_k", "item_id", "longest_run", "tiles", "covered_words", "item_words", "coverage"])

        return rows.mapInPandas(run, SCHEMA)

    blocks = item_blocks(items, max_block_words)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        result = source.sparkSession.createDataFrame([], SCHEMA)
    elif second is None:
        result = tiled(sc.broadcast(first), source, words_of)
    else:
        cleaned = written(source.mapInPandas(_written_words, "_k bigint, _t string"), "words")
        parts = []
        for block in chain((first, second), blocks):
            shared = sc.broadcast(block)
            parts.append(written_path(tiled(shared, cleaned, str.split), "leaks"))
            shared.destroy()
        result = source.sparkSession.read.schema(SCHEMA).parquet(*parts)
    return result.withColumnRenamed("_k", "doc_id")


def _written_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(_t=[" ".join(words_of(t)) for t in b["_t"]])
