"""Per-key results without imbalance, where a few keys hold most of the rows.

Fragment-replicate by estimated load:

1. the load of every key is counted with map-side combining;
2. a key above its fair share of a task is split into proportionate shards by a
   second column, so rows that belong together stay in one shard;
3. shards of heavy keys and buckets of light keys are bin-packed to tasks,
   largest load first;
4. rows go straight to the task chosen for them, and the matching side is
   replicated to exactly the shards of its key.

What the driver sees is bounded by the number of tasks, not by the data: at most
``n_tasks`` keys can exceed a share of ``1 / n_tasks``, and light keys are only
seen as ``n_tasks * BUCKETS_PER_TASK`` buckets.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS_PER_TASK = 16
HEAVY_SHARE = 0.5  # a key with more than this part of a task's fair load is split

KEY, SHARD, TASK = "_key", "_shard", "_task"


@dataclass
class Placement:
    """Where the rows of each key go."""

    n_tasks: int
    n_buckets: int
    light: list[int]  # task of each bucket of light keys
    heavy: DataFrame  # _key, _shards, _tasks (task of each shard); at most n_tasks / HEAVY_SHARE rows
    n_heavy: int
    loads: list[int]  # estimated rows of each task

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.n_buckets)).cast("int")

    def light_task(self, key: Column) -> Column:
        # one literal, folded to an array once: building it from single literals is slow for many tasks
        tasks = F.split(F.lit(",".join(map(str, self.light))), ",").cast("array<int>")
        return F.element_at(tasks, self.bucket(key) + 1)

    def place(self, df: DataFrame, key: str, shard_by: str) -> DataFrame:
        """``df`` with the columns _shard and _task, distributed by _task. Rows
        of one key and one value of ``shard_by`` always share a shard; rows with
        a NULL key are dropped, a NULL in ``shard_by`` is a value like others."""
        df = df.where(F.col(key).isNotNull())
        if self.n_heavy:
            df = df.join(F.broadcast(self.heavy), F.col(key) == F.col(KEY), "left")
            shard = F.pmod(F.xxhash64(F.coalesce(F.col(shard_by).cast("string"), F.lit("\0"))), F.coalesce(F.col("_shards"), F.lit(1))).cast("int")
            df = df.withColumn(SHARD, shard)
            df = df.withColumn(TASK, F.coalesce(F.try_element_at(F.col("_tasks"), F.col(SHARD) + 1), self.light_task(F.col(key))))
            df = df.drop(KEY, "_shards", "_tasks")
        else:
            df = df.withColumn(SHARD, F.lit(0)).withColumn(TASK, self.light_task(F.col(key)))
        return df.repartitionById(self.n_tasks, F.col(TASK))

    def replicate(self, df: DataFrame, key: str) -> DataFrame:
        """``df``, the matching side, with a copy of each row for every shard of its key."""
        df = df.where(F.col(key).isNotNull())
        if self.n_heavy:
            df = df.join(F.broadcast(self.heavy), F.col(key) == F.col(KEY), "left")
            df = df.select("*", F.posexplode(F.coalesce(F.col("_tasks"), F.array(self.light_task(F.col(key))))).alias(SHARD, TASK))
            df = df.drop(KEY, "_shards", "_tasks")
        else:
            df = df.withColumn(SHARD, F.lit(0)).withColumn(TASK, self.light_task(F.col(key)))
        return df.repartitionById(self.n_tasks, F.col(TASK))


def key_loads(df: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """(_key, _rows) of the non-NULL keys; partial counts are combined before the
    shuffle. ``weight``: a column of rows counted already."""
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(KEY)).agg(rows.alias("_rows"))


def pack(sizes: list[tuple[int, object]], n_tasks: int) -> tuple[dict, list[int]]:
    """Largest first onto the least loaded task. Ties go to the lower task."""
    heap = [(0, t) for t in range(n_tasks)]
    chosen: dict = {}
    loads = [0] * n_tasks
    for size, what in sorted(sizes, key=lambda x: (-x[0], str(x[1]))):
        load, t = heapq.heappop(heap)
        chosen[what] = t
        loads[t] = load + size
        heapq.heappush(heap, (load + size, t))
    return chosen, loads


def plan_placement(df: DataFrame, key: str, n_tasks: int | None = None, weight: str | None = None) -> Placement:
    """Counts the load of every key of ``df`` once and chooses tasks for them.

    An empty ``df`` gives a placement without heavy keys."""
    spark = df.sparkSession
    n_tasks = n_tasks or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n_buckets = n_tasks * BUCKETS_PER_TASK
    loads = key_loads(df, key, weight).withColumn("_bucket", F.pmod(F.xxhash64(KEY), F.lit(n_buckets)).cast("int"))
    total_of = loads.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("_total"))
    limit = F.greatest(F.col("_total") * HEAVY_SHARE / n_tasks, F.lit(1.0))
    judged = loads.crossJoin(F.broadcast(total_of)).withColumn("_heavy", F.col("_rows") > limit)
    # one pass: a row for each heavy key and one for each bucket of light keys
    summed = (
        judged.groupBy(F.when(F.col("_heavy"), F.col(KEY)).alias(KEY), F.when(~F.col("_heavy"), F.col("_bucket")).alias("_bucket"))
        .agg(F.sum("_rows").alias("_rows"))
        .collect()
    )
    total = sum(r["_rows"] for r in summed)
    target = max(1.0, total * HEAVY_SHARE / n_tasks)
    sizes: list[tuple[int, object]] = []
    shards: dict[object, int] = {}
    for r in summed:
        if r[KEY] is not None:
            shards[r[KEY]] = min(4 * n_tasks, -(-r["_rows"] // int(target)))
            sizes += [(r["_rows"] // shards[r[KEY]], ("key", r[KEY], s)) for s in range(shards[r[KEY]])]
        else:
            sizes.append((r["_rows"], ("bucket", r["_bucket"])))
    chosen, task_loads = pack(sizes, n_tasks)
    light = [chosen.get(("bucket", b), b % n_tasks) for b in range(n_buckets)]
    schema = T.StructType([T.StructField(KEY, df.schema[key].dataType), T.StructField("_shards", T.IntegerType()), T.StructField("_tasks", T.ArrayType(T.IntegerType()))])
    rows = [(k, n, [chosen["key", k, s] for s in range(n)]) for k, n in shards.items()]
    return Placement(n_tasks, n_buckets, light, spark.createDataFrame(rows, schema), len(rows), task_loads)


def fragment_replicate_join(
    fact: DataFrame, dim: DataFrame, key: str, shard_by: str, how: str = "left", n_tasks: int | None = None, loads_of: DataFrame | None = None, weight: str | None = None
) -> DataFrame:
    """Join of ``fact`` with ``dim`` on ``key``; no task holds more than a fair
    part of a heavy key. The loads are counted in ``loads_of``, a cheaper table
    with the same keys (and their rows in ``weight``, if they are counted there), or
    else in ``fact`` itself, which is then read twice.

    how: ``left`` or ``inner``. A fact row with a NULL key matches nothing: with
    ``left`` it is kept with NULLs beside it, with ``inner`` it is dropped.
    Columns of ``dim`` must differ in name from those of ``fact`` but for the key."""
    clash = (set(fact.columns) & set(dim.columns)) - {key}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    where = plan_placement(fact if loads_of is None else loads_of, key, n_tasks, weight)
    left = where.place(fact, key, shard_by)
    right = where.replicate(dim, key).hint("shuffle_hash")
    joined = left.join(right, [TASK, SHARD, key], how).drop(TASK, SHARD)
    if how == "left":
        lost = fact.where(F.col(key).isNull())
        joined = joined.unionByName(lost, allowMissingColumns=True)
    return joined.select(*fact.columns, *[c for c in dim.columns if c != key])


def mended_postings(postings: DataFrame) -> DataFrame:
    """(term, doc_id, term_freq, positions) rows as they should read: a term_freq that is
    NULL or below 1 is the number of positions. Rows with neither count as frequency 0; NULL terms or documents are left out."""
    freq = F.when(F.col("term_freq") > 0, F.col("term_freq")).otherwise(F.coalesce(F.size("positions"), F.lit(0)))
    return postings.where(F.col("term").isNotNull() & F.col("doc_id").isNotNull()).select(
        "term", "doc_id", F.greatest(freq, F.lit(0)).cast("bigint").alias("term_freq"), "positions"
    )


def term_totals(postings: DataFrame, vocabulary: DataFrame | None = None, n_tasks: int | None = None) -> DataFrame:
    """Per-term results of an index, balanced over tasks.

    Columns: term, n_rows (rows as they stand), row_share (of all rows, NULL
    terms and repeated rows included), cards, occurrences (repeated rows once),
    n_positions, position_sum, stated_cards (sum of the vocabulary's doc_freq,
    each segment once; NULL where unknown), n_shards.

    Rows with a NULL term count in the total only. Repeated (term, doc_id) rows
    are merged: the greatest frequency, position count and position sum count."""
    total = postings.agg(F.count(F.lit(1)).alias("_total"))
    freq = F.when(F.col("term_freq") > 0, F.col("term_freq")).otherwise(F.coalesce(F.size("positions"), F.lit(0)))
    rows = postings.where(F.col("term").isNotNull()).select(
        "term", "doc_id", freq.cast("bigint").alias("freq"),
        F.coalesce(F.size("positions"), F.lit(0)).cast("bigint").alias("n_positions"),
        F.aggregate(F.coalesce("positions", F.array().cast("array<int>")), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0))).alias("position_sum"),
    )
    where = plan_placement(rows, "term", n_tasks)
    placed = where.place(rows, "term", "doc_id")
    cards = placed.groupBy(TASK, SHARD, "term", "doc_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max("freq").alias("freq"),
        F.max("n_positions").alias("n_positions"),
        F.max("position_sum").alias("position_sum"),
    )
    partial = cards.groupBy(TASK, SHARD, "term").agg(
        F.sum("n_rows").alias("n_rows"),
        F.count("doc_id").alias("cards"),
        F.sum("freq").alias("occurrences"),
        F.sum("n_positions").alias("n_positions"),
        F.sum("position_sum").alias("position_sum"),
    )
    if vocabulary is not None:
        stated = (
            vocabulary.where(F.col("term").isNotNull())
            .groupBy("segment_no", "term").agg(F.max("doc_freq").alias("df"))
            .groupBy("term").agg(F.sum("df").cast("bigint").alias("stated_cards"))
        )
        partial = partial.join(where.replicate(stated, "term"), [TASK, SHARD, "term"], "left")
    else:
        partial = partial.withColumn("stated_cards", F.lit(None).cast("bigint"))
    per_term = partial.groupBy("term").agg(
        *[F.sum(c).alias(c) for c in ("n_rows", "cards", "occurrences", "n_positions", "position_sum")],
        F.max("stated_cards").alias("stated_cards"),
        F.count(F.lit(1)).alias("n_shards"),
    )
    return per_term.crossJoin(F.broadcast(total)).select(
        "term", "n_rows", (F.col("n_rows") / F.col("_total")).alias("row_share"), "cards", "occurrences",
        "n_positions", "position_sum", "stated_cards", "n_shards",
    )


def dominant_terms(totals: DataFrame, share: float = 0.02) -> DataFrame:
    """Terms that hold more than ``share`` of all rows."""
    return totals.where(F.col("row_share") > share).select("term")
