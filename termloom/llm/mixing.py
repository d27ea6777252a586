"""Mixing sources to target weights.

Every source gets a plan (how often its documents are taken) and its stream of
documents is cut into blocks of equal size. Blocks are interleaved by Pfair
scheduling: from the weight w of its source, block j is released at slot
floor((j - 1) / w) and due at slot ceil(j / w), and the released block with the
earliest deadline comes first; so at every slot each source is within one block of
its share.

Only (document, source, size) is shuffled, never the text. Running totals are
taken in chunks, so no source is a single task's work; broadcast are one row per
target source, block and chunk, whose numbers depend on the tasks and not on the data.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

MIN_BLOCKS = 2048  # slots of the schedule, at least
BLOCKS_PER_TASK = 16  # and for each shuffle task, so that blocks do not grow with the data
MIN_CHUNKS = 1024  # chunks of each source for the running totals, at least
CHUNKS_PER_TASK = 4  # and for each shuffle task, so that one source's chunks spread evenly
WORD = r"[\p{L}\p{N}]+"


def source_name(c: Column) -> Column:
    """Source name for comparing: without outer white space, in lower case."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def sized_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size) of the rows with a source; size is the number of
    runs of letters or numbers. A NULL or empty text has size 0."""
    return documents.where(F.col("source").isNotNull()).select(
        "doc_id", source_name(F.col("source")).alias("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
    )


def source_plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source.

    Columns: source, target_share, max_repeats, documents, size, factor
    (target_share x total / size), repeats (factor, at most max_repeats),
    planned_size, planned_share, outcome: ``short`` (factor above max_repeats),
    ``repeat`` (above 1) or ``enough``. The total is the size of all rows of
    ``sizes``. A target without any text is ``short`` with planned size 0; a
    target named twice is added up, with the larger max_repeats."""
    wanted = (
        targets.where(F.col("source").isNotNull())
        .groupBy(source_name(F.col("source")).alias("source"))
        .agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    )
    per_source = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("size").alias("size"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("_total"))
    plan = (
        wanted.join(per_source, "source", "left")
        .crossJoin(F.broadcast(total))
        .withColumn("documents", F.coalesce("documents", F.lit(0)))
        .withColumn("size", F.coalesce("size", F.lit(0)))
        .withColumn("factor", F.when(F.col("size") > 0, F.col("target_share") * F.col("_total") / F.col("size")))
    )
    repeats = F.least(F.col("factor"), F.col("max_repeats").cast("double"))
    outcome = (
        F.when(F.col("factor").isNull() & (F.col("target_share") > 0), "short")
        .when(F.col("factor") > F.col("max_repeats"), "short")
        .when(F.col("factor") > 1, "repeat")
        .otherwise("enough")
    )
    plan = plan.withColumn("repeats", F.coalesce(repeats, F.lit(0.0))).withColumn("planned_size", F.col("repeats") * F.col("size"))
    all_planned = Window.partitionBy()
    share = F.try_divide(F.col("planned_size"), F.sum("planned_size").over(all_planned))
    return plan.select(
        "source", "target_share", "max_repeats", "documents", "size", "factor", "repeats", "planned_size",
        F.coalesce(share, F.lit(0.0)).alias("planned_share"), outcome.alias("outcome"),
    )


def pfair_slots(weights: dict[str, float], blocks: dict[str, int]) -> list[tuple[str, int]]:
    """Slot by slot the (source, block number from 1) that comes next, until each
    source has had all of its ``blocks``.

    weights are shares that sum to 1. A block waits for its release; if no block
    is released, the one released next comes."""
    waiting: list[tuple[int, int, str, int]] = []
    ready: list[tuple[int, str, int]] = []
    for s, w in sorted(weights.items()):
        if blocks[s] > 0:
            heapq.heappush(waiting, (0, math.ceil(1 / w), s, 1))
    slots: list[tuple[str, int]] = []
    while waiting or ready:
        while waiting and (waiting[0][0] <= len(slots) or not ready):
            _, due, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, j))
        _, s, j = heapq.heappop(ready)
        slots.append((s, j))
        if j < blocks[s]:
            w = weights[s]
            heapq.heappush(waiting, (math.floor(j / w + 1e-9), math.ceil((j + 1) / w - 1e-9), s, j + 1))
    return slots


def mix(sizes: DataFrame, targets: DataFrame, n_blocks: int | None = None, n_chunks: int | None = None) -> DataFrame:
    """The mixed corpus: (slot, place, source, doc_id, copy, size).

    Documents of a source come in the order of a hash of their id, copy after
    copy, until the planned size is reached; place is the size taken before. Sorting
    by slot and place interleaves the sources. ``sizes`` should be a written table: it is read three times. An
    empty plan gives no rows."""
    spark = sizes.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = n_blocks or max(MIN_BLOCKS, BLOCKS_PER_TASK * tasks)
    n_chunks = n_chunks or max(MIN_CHUNKS, CHUNKS_PER_TASK * tasks)
    rows = [r for r in source_plan(sizes, targets).collect() if r["planned_size"] > 0]
    schema = "source string, repeats double, planned_size double, all_size bigint, block double"
    planned = sum(r["planned_size"] for r in rows)
    block = max(planned / n_blocks, 1e-9)
    per_source = F.broadcast(spark.createDataFrame([(r["source"], r["repeats"], r["planned_size"], r["size"], block) for r in rows], schema))
    weights = {r["source"]: r["planned_size"] / planned for r in rows}
    # a document that begins below the planned size begins in one of so many blocks
    slots = pfair_slots(weights, {r["source"]: math.floor(r["planned_size"] / block) + 1 for r in rows})
    slot_of = F.broadcast(spark.createDataFrame([(s, j, t) for t, (s, j) in enumerate(slots)], "source string, block_no int, slot int"))

    order = F.xxhash64("doc_id")
    chunked = sizes.where(F.col("size") > 0).join(per_source, "source").withColumn("_chunk", F.pmod(order, F.lit(n_chunks)).cast("int"))
    sums = chunked.groupBy("source", "_chunk").agg(F.sum("size").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    starts = F.broadcast(sums.select("source", "_chunk", F.coalesce(before, F.lit(0)).alias("_start")))
    within = F.sum("size").over(
        Window.partitionBy("source", "_chunk").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = chunked.withColumn("_within", F.coalesce(within, F.lit(0))).join(starts, ["source", "_chunk"])
    copies = F.explode(F.sequence(F.lit(0), F.ceil("repeats").cast("int") - 1))
    at = F.col("copy") * F.col("all_size") + F.col("_start") + F.col("_within")
    taken = placed.withColumn("copy", copies).withColumn("_at", at).where(F.col("_at") < F.col("planned_size"))
    return (
        taken.withColumn("block_no", (F.floor(F.col("_at") / F.col("block")) + 1).cast("int"))
        .join(slot_of, ["source", "block_no"])
        .select("slot", F.col("_at").cast("bigint").alias("place"), "source", "doc_id", "copy", "size")
    )


def mix_report(sizes: DataFrame, targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """The plan with what the mix really holds: taken_rows, taken_size, copies (how
    often its most repeated document is taken) and actual_share."""
    taken = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("taken_rows"), F.sum("size").alias("taken_size"), (F.max("copy") + 1).alias("copies"))
    full = source_plan(sizes, targets).join(taken, "source", "left").fillna(0, ["taken_rows", "taken_size", "copies"])
    share = F.try_divide(F.col("taken_size"), F.sum("taken_size").over(Window.partitionBy()))
    return full.withColumn("actual_share", F.coalesce(share, F.lit(0.0)))


def mix_balance(sizes: DataFrame, report: DataFrame) -> DataFrame:
    """(source, outcome, copies, reached, exact): whether the mix holds the planned size
    of a source, and no more than one document above it."""
    largest = sizes.groupBy("source").agg(F.max("size").alias("_largest"))
    over = F.col("taken_size") - F.col("planned_size")
    joined = report.join(largest, "source", "left")
    return joined.select("source", "outcome", F.col("copies").cast("bigint").alias("copies"), (over > -1e-6).alias("reached"), (over <= F.coalesce("_largest", F.lit(0))).alias("exact"))


def outcomes(report: DataFrame) -> DataFrame:
    """(source, outcome) of the sources that the mix repeats or that fall short:
    ``repeat`` where documents are taken again and the target is reached, ``short``
    where max_repeats does not reach it."""
    repeated = (F.col("outcome") == "repeat") & (F.col("copies") > 1)
    return report.where(repeated | (F.col("outcome") == "short")).select("source", "outcome")


def written_sizes(documents: DataFrame) -> DataFrame:
    """Sizes counted once and kept in the shared folder."""
    return written(sized_documents(documents), "sizes")
