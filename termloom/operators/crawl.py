"""The restartable work queue of a crawl, as tables and steps over them.

A step takes the queue's state and gives a new state; a micro-batch owns the pages
it was given, so no locks are needed, and pages left in progress by a crash are
queued again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import strip_category
from ..schemas import EVENTS
from ..session import hadoop_path, read_small, write_small, written_path

NEW, DONE, IN_PROGRESS, FAILED = 0, 1, 2, 3
MAX_ATTEMPTS = 3
ARTICLE, CATEGORY = 0, 14
STATUS_NAMES = {NEW: "new", DONE: "done", IN_PROGRESS: "in_progress", FAILED: "failed"}


def split_members(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles (cat, title) and subcategories (cat, sub); a NULL namespace is 0, others are ignored."""
    ns = F.coalesce("ns", F.lit(ARTICLE))
    articles = members.where(ns == ARTICLE).select("cat", "title")
    return articles, members.where(ns == CATEGORY).select("cat", strip_category(F.col("title")).alias("sub"))


def discover(members: DataFrame, roots: list[str], max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Breadth-first walk over category members (cat, ns, title).

    Returns pages (title) and categories (cat, depth) reached from ``roots``, which
    have depth 0; with ``max_depth`` subcategories of that depth are the last whose
    members are taken. Each round's frontier is written once, a table for each depth;
    together they are what was visited, and cycles end by the anti-join with them."""
    spark = members.sparkSession
    articles, subs = split_members(members)
    schema = "cat string, depth int"
    frontier = spark.createDataFrame([(r, 0) for r in dict.fromkeys(roots)], schema)
    paths: list[str] = []
    depth = 0
    while True:
        paths.append(written_path(frontier, "frontier"))
        frontier = spark.read.schema(schema).parquet(paths[-1])
        visited = spark.read.schema(schema).parquet(*paths)
        if frontier.isEmpty() or max_depth is not None and depth >= max_depth:
            break
        depth += 1
        following = subs.join(frontier, "cat", "left_semi").where("sub IS NOT NULL").select(F.col("sub").alias("cat")).distinct()
        frontier = following.join(visited, "cat", "left_anti").select("cat", F.lit(depth).alias("depth"))
    pages = articles.join(visited, "cat", "left_semi").where("title IS NOT NULL").select("title").distinct()
    return pages, visited


def enqueue(state: DataFrame, titles: DataFrame) -> DataFrame:
    """The queue with new pages for titles it does not hold; ids go on from the
    greatest one. Repeated and NULL titles are ignored."""
    return state.unionByName(new_pages(state, titles), allowMissingColumns=True)


def new_pages(state: DataFrame, titles: DataFrame) -> DataFrame:
    """The rows that ``enqueue`` adds; their ids have the queue's type, which must
    hold them (BIGINT beyond 2^31 pages): a greater one is an error, not another page."""
    from .ordering import ranked

    fresh = titles.where("title IS NOT NULL").select("title").distinct().join(state.select("title"), "title", "left_anti")
    top = state.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    numbered = ranked(fresh, ["title"], "_n").crossJoin(F.broadcast(top))
    number = F.col("_top").cast("bigint") + F.col("_n")
    kind = state.schema["id"].dataType
    fits = F.when(number.cast(kind) == number, number.cast(kind)).otherwise(F.raise_error(F.lit("the queue's ids are too narrow")).cast(kind))
    return numbered.select(fits.alias("id"), "title", F.lit(NEW).alias("status"), F.lit(0).alias("attempts"), F.current_timestamp().alias("discovered_at"))


def eligible(state: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    return state.where(F.col("status").isin(NEW, FAILED) & (F.col("attempts") < max_attempts))


def next_pages(state: DataFrame, n: int, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The ``n`` pages to try next: fewest attempts first, then by id."""
    return eligible(state, max_attempts).orderBy("attempts", "id").limit(n)


def claim(state: DataFrame, chosen: DataFrame) -> DataFrame:
    """The queue with the chosen pages in progress and one more attempt each."""
    marked = state.join(chosen.select("id", F.lit(True).alias("_c")), "id", "left")
    mine = F.coalesce("_c", F.lit(False))
    return marked.withColumns({"status": F.when(mine, IN_PROGRESS).otherwise(F.col("status")), "attempts": F.when(mine, F.col("attempts") + 1).otherwise(F.col("attempts"))}).select(*state.columns)


def apply_results(state: DataFrame, results: DataFrame) -> DataFrame:
    """The queue after results (id, status, sha1, word_count, source_url, doc_id,
    last_error); several results of a page count as the one with the greatest status."""
    columns = ["status", "sha1", "word_count", "source_url", "doc_id", "last_error"]
    one = results.groupBy("id").agg(F.max(F.struct(*columns)).alias("_r"))
    joined = state.join(one, "id", "left")
    new = {c: F.when(F.col("_r").isNotNull(), F.col(f"_r.{c}")).otherwise(F.col(c)) for c in columns}
    new["processed_at"] = F.when(F.col("_r").isNotNull(), F.current_timestamp()).otherwise(F.col("processed_at"))
    return joined.withColumns(new).select(*state.columns)


def requeue(state: DataFrame) -> DataFrame:
    """The queue after a restart: pages left in progress are new again."""
    return state.withColumn("status", F.when(F.col("status") == IN_PROGRESS, NEW).otherwise(F.col("status")))


class ConflictError(RuntimeError):
    """Another writer has taken the step first; nothing was changed."""


@dataclass
class StoredQueue:
    """A queue kept in a folder: a base table, tables of the rows that each step
    changed, and a log of small files that says which of them count. A step writes
    its rows and then its log entry, whose number only one writer can take, so it is
    there whole or not at all; a reader follows the log."""

    spark: SparkSession
    path: str

    @staticmethod
    def create(state: DataFrame, path: str) -> StoredQueue:
        """A new queue with these pages; raises ConflictError if there is one."""
        queue = StoredQueue(state.sparkSession, path)
        queue._commit(0, state, base=True)
        return queue

    def _entry(self, number: int) -> str:
        return f"{self.path}/log/{number:08d}.json"

    def log(self) -> list[dict]:
        """Entries of the log from the last base on: number, folder, base, schema."""
        fs, folder = hadoop_path(self.spark, f"{self.path}/log")
        if not fs.exists(folder):
            return []
        numbers = sorted(int(n[:8]) for f in fs.listStatus(folder) if (n := f.getPath().getName()).endswith(".json"))
        entries: list[dict] = []
        for n in reversed(numbers):
            entries.append(json.loads(read_small(self.spark, self._entry(n))))
            if entries[-1]["base"]:
                break
        return entries[::-1]

    def _commit(self, number: int, rows: DataFrame, base: bool = False) -> dict:
        folder = f"rows-{number:08d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        entry = {"number": number, "folder": folder, "base": base, "schema": rows.schema.json()}
        if not write_small(self.spark, self._entry(number), json.dumps(entry)):
            raise ConflictError(f"step {number} of {self.path} was taken")
        return entry

    def _read(self, entry: dict) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        return self.spark.read.schema(schema).parquet(f"{self.path}/{entry['folder']}")

    def state(self) -> DataFrame:
        """The queue as it is now. Only the changed rows are looked up in the base."""
        return self._at()[1]

    def _at(self) -> tuple[int, DataFrame]:
        entries = self.log()
        if not entries:
            raise FileNotFoundError(f"no queue in {self.path}")
        base = self._read(entries[0])
        if len(entries) == 1:
            return entries[-1]["number"], base
        steps = None
        for e in entries[1:]:
            rows = self._read(e).select(*base.columns).withColumn("_step", F.lit(e["number"]))
            steps = rows if steps is None else steps.unionByName(rows)
        last = steps.groupBy("id").agg(F.max_by(F.struct(*base.columns), "_step").alias("_p")).select("_p.*")
        return entries[-1]["number"], base.join(steps.select("id"), "id", "left_anti").select(*base.columns).unionByName(last)

    def claim(self, n: int, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
        """Takes the next ``n`` pages in one step and returns them as they now are."""
        number, state = self._at()
        chosen = next_pages(state, n, max_attempts)
        return self._read(self._commit(number + 1, claim(chosen, chosen)))

    def apply(self, results: DataFrame) -> None:
        """Results of claimed pages, in one step; results of unknown pages are ignored."""
        number, state = self._at()
        self._commit(number + 1, apply_results(state.join(results.select("id"), "id", "left_semi"), results))

    def requeue(self) -> None:
        """Pages left in progress are new again."""
        number, state = self._at()
        self._commit(number + 1, requeue(state.where(F.col("status") == IN_PROGRESS)))

    def enqueue(self, titles: DataFrame) -> None:
        number, state = self._at()
        nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in state.schema if f.name not in ("id", "title", "status", "attempts", "discovered_at")]
        self._commit(number + 1, new_pages(state, titles).select("*", *nulls).select(*state.columns))

    def compact(self) -> None:
        """A new base of all rows; readers of the old one are not disturbed."""
        number, state = self._at()
        self._commit(number + 1, state, base=True)


def status_histogram(state: DataFrame, all_statuses: bool = False) -> DataFrame:
    """(status, pages) of the statuses that occur, or of all of them, with 0."""
    counts = state.groupBy("status").agg(F.count(F.lit(1)).alias("pages"))
    if not all_statuses:
        return counts
    known = state.sparkSession.createDataFrame([(s,) for s in STATUS_NAMES], "status int")
    return known.join(counts, "status", "full").select("status", F.coalesce("pages", F.lit(0)).cast("bigint").alias("pages"))


def crawl_stats(state: DataFrame) -> DataFrame:
    """One row: pages, one column per status, saved (with a document), skipped, failed_for_good."""
    counts = {name: F.count_if(F.col("status") == code) for code, name in STATUS_NAMES.items()}
    return state.agg(
        F.count(F.lit(1)).alias("pages"),
        *[c.alias(name) for name, c in counts.items()],
        F.count_if(F.col("doc_id").isNotNull()).alias("saved"),
        F.count_if(F.col("last_error").startswith("skipped")).alias("skipped"),
        F.count_if((F.col("status") == FAILED) & (F.col("attempts") >= MAX_ATTEMPTS)).alias("failed_for_good"),
    )


def log_events(rows: DataFrame, event_type: str, message: str) -> DataFrame:
    """(timestamp, event_type, message, details) with the rows' columns as JSON."""
    return rows.select(F.current_timestamp().alias("timestamp"), F.lit(event_type).alias("event_type"), F.lit(message).alias("message"), F.to_json(F.struct(*rows.columns)).alias("details"))


def event_counts(events: DataFrame, flag: Column) -> DataFrame:
    """(event_type, events, flagged): events of each type and for how many ``flag`` holds."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_if(flag).alias("flagged"))


def append_events(events: DataFrame, path: str) -> None:
    """Appends events to the log at ``path``; ids go on from its greatest. One
    writer at a time."""
    from .ordering import ranked

    spark = events.sparkSession
    fs, folder = hadoop_path(spark, path)
    last = read_events(spark, path).agg(F.coalesce(F.max("id"), F.lit(0)).alias("n")).first()["n"] if fs.exists(folder) else 0
    ranked(events, ["timestamp", "event_type", "details"], "id", last + 1).select("id", "timestamp", "event_type", "message", "details").write.mode("append").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(id, timestamp, event_type, message, details) of an event log."""
    return spark.read.schema(EVENTS).parquet(path)


def backoff_seconds(attempts, retry_after=None, base: float = 1.0, most: float = 60.0):
    """Column of seconds to wait after so many attempts; ``retry_after`` counts where it is a number."""
    wait = F.least(F.lit(base) * F.pow(F.lit(2.0), attempts), F.lit(most))
    return wait if retry_after is None else F.coalesce(retry_after.try_cast("double"), wait)
