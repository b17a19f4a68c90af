"""Shards of near equal size by longest-processing-time scheduling.

Groups of equal texts, sorted by size and then by digest, go one by one to the least loaded shard through a heap. The heap doesn't
need the groups themselves: the driver gets the number of groups of each size, runs the heap over sizes and, where all
shards in reach are level, places whole rounds at once. What it returns for each size is which rank goes to which shard. Ranks within a size are
numbered by Spark, in blocks by the digest's first bytes. Distinct sizes are few: their sum is at most the sum of all
sizes, so there are fewer than the square root of twice that (250,000 at 30 GB, and far fewer in real tables).
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelloom.llm.common import table
from pixelloom.plans.storage import write_shared

#: About so many rows of a shard are numbered in one task.
ROWS_PER_SLOT_BLOCK = 20_000


def schedule(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, list[int]]]:
    """`(size, first rank, shards)`: from that rank on, groups of the size go to these shards in turn.

    `sizes` are (size, number of groups). Largest first onto the least loaded shard, ties by the shard's number, as if every
    group went through the heap alone.
    """
    heap = [(0, shard) for shard in range(shards)]
    plan = []
    for size, n in sorted(sizes, reverse=True):
        rank = 0
        while rank < n:
            load, shard = heapq.heappop(heap)
            level = [(load, shard)]  # all that get one each before the first is the least again
            while heap and len(level) < n - rank and heap[0] < (load + size, shard):
                level.append(heapq.heappop(heap))
            turns = 1
            if not heap:  # level: whole rounds go the same way
                turns = (n - rank) // len(level)
            elif heap[0][0] > load + size and len(level) < n - rank:  # until the next shard comes into reach
                turns = max(1, min((n - rank) // len(level), (heap[0][0] - load - 1) // size))
            plan.append((size, rank, [s for _, s in level]))
            rank += turns * len(level)
            for held, s in level:
                heapq.heappush(heap, (held + turns * size, s))
    return plan


def ranked(groups: DataFrame, group: str, size: str) -> DataFrame:
    """`groups` with `rank`, from 0 in the order of `group` (binary) within each `size`, numbered in blocks by the first two bytes."""
    split = groups.withColumn("block", F.hex(F.substring(group, 1, 2)))
    counts = split.groupBy(size, "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy(size).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(size, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy(size, "block").orderBy(group))
    return split.withColumn("inside", inside).join(offsets, [size, "block"]).withColumn("rank", F.col("offset") + F.col("inside") - 1).drop("block", "inside", "offset")


def assign_shards(rows: DataFrame, group: str, size: str, shards: int) -> DataFrame:
    """`rows` with `shard`. Rows of one `group` (a digest: binary, not null) share a shard; `size` is a positive long.

    A group is never split, even when it alone is larger than a fair share. Ties are broken by digest and shard number, so the result
    depends on the rows only. An empty table stays empty. A column `shard` of the input is replaced.
    """
    rows = rows.drop("shard")
    groups = write_shared(rows.groupBy(group).agg(F.sum(size).alias("group_size")), "groups")
    sizes = [(r["group_size"], r["n"]) for r in groups.groupBy("group_size").agg(F.count("*").alias("n")).toLocalIterator()]
    parts: dict[int, list[tuple[int, list[int]]]] = {}
    for length, first, members in schedule(sizes, shards):
        parts.setdefault(length, []).append((first, members))
    plan = rows.sparkSession.createDataFrame(list(parts.items()), "group_size long, parts array<struct<first:bigint,members:array<int>>>")
    placed = ranked(groups, group, "group_size").join(plan, "group_size")
    part = F.element_at(F.filter("parts", lambda p: p["first"] <= F.col("rank")), -1)
    shard = F.get(part["members"], ((F.col("rank") - part["first"]) % F.size(part["members"])).cast("int"))
    homes = write_shared(placed.select(group, shard.alias("shard")), "homes")
    return rows.join(homes, group)


def number_slots(rows: DataFrame, block_by: list[str], order: list[str], expected: int) -> DataFrame:
    """`rows` with `slot`, counting from 0 without gaps in each `shard`.

    A shard is numbered in blocks by hash of `block_by`, so that no task sees more than a block; the blocks' offsets come from their counts.
    Within a block slots follow `order`, which should tell all rows apart.
    """
    blocks = max(1, expected // ROWS_PER_SLOT_BLOCK)
    split = rows.withColumn("block", F.pmod(F.xxhash64(*block_by, F.lit("slot")), F.lit(blocks)).cast("int"))
    counts = split.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy(*order))
    return split.withColumn("inside", inside).join(offsets, ["shard", "block"]).withColumn("slot", F.col("offset") + F.col("inside") - 1).drop("block", "inside", "offset")


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """`(doc_id, size, text_crc32, shard, slot)` for every row of `docs`; equal texts share a shard.

    Size is the text's UTF-8 bytes plus `overhead`. A null text has no bytes and CRC 0, as an empty one; null texts form one group,
    empty texts another. Rows with the same doc_id and text, and null doc_ids, are told apart by a row number that is written with the
    sizes; all get slots of their own. Slots depend on doc_id and text only, but for such rows. Other columns are not looked at.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.unhex(F.sha2(F.lit("null"), 224))).otherwise(F.unhex(F.sha2(text, 256))).alias("group"),
        F.monotonically_increasing_id().alias("row"),
    )
    thin = write_shared(thin, "sizes")
    placed = assign_shards(thin, "group", "size", shards).withColumn("copy", F.when(F.col("doc_id").isNull(), F.col("row")))
    return number_slots(placed, ["doc_id", "group", "copy"], ["doc_id", "group", "row"], thin.count() // shards).select("doc_id", "size", "text_crc32", "shard", "slot")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    placed = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
