"""Sharding by minimax contiguous partition.

Equal texts form one atomic group; groups are ordered by the MD5 of their
text. The smallest capacity for which ``n_shards`` contiguous runs of whole
groups suffice is found by binary search, each probe checked greedily, and the
order is cut under that capacity, evenly within what it allows.

The search needs the running sum of the group sizes only near the places where
a probe cuts. Spark keeps the running sums; the driver sees block ends (at
most ``BLOCKS`` per round), runs the whole search on them, notes the blocks
whose inside it needed, and has Spark refine those. When a run needs none, its
result is exactly that of the full list of sums.

Rows are range-partitioned by (text digest, doc_id), so a hot group spreads
over many tasks, and a row's slot follows from its place in its partition plus
the counts of the partitions before. No window spans a shard.

Cases: a null text has size ``overhead`` and forms its own group (an empty
text another); repeated rows are separate rows of one group; an empty table
gives an empty result; fewer groups than shards leave the last shards empty.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window, functions as F

from navlens.llm.common import text_partitions, written

N_SHARDS = 40
OVERHEAD = 16
#: Block ends that the driver gets in the first round at most. A later round refines the blocks that probes cut
#: (about 40 a probe), each into 8 or so.
BLOCKS = 16_384
#: Ranges that one refining filter names at most.
MOST_RANGES = 100
#: Leading hex digits of the digest that deal groups to running-sum windows: 16^3 windows and one for null texts.
DIGITS = 3


class RunningSums:
    """Block ends of an ascending list of running sums; blocks with one group are exact."""

    def __init__(self, ends: list[int], counts: list[int]):
        self.ends, self.counts = [0, *ends], [1, *counts]
        self.total, self.inexact = self.ends[-1], set()

    def last_upto(self, x: int) -> int:
        """The largest running sum (or 0) that is at most x."""
        if x >= self.total:
            return self.total
        i = bisect_right(self.ends, x)
        if self.ends[i - 1] != x and self.counts[i] > 1:
            self.inexact.add(i)
        return self.ends[i - 1]

    def first_from(self, x: int) -> int:
        """The smallest running sum (or 0) that is at least x."""
        i = bisect_left(self.ends, max(0, x))
        if self.ends[i] != x and self.counts[i] > 1:
            self.inexact.add(i)
        return self.ends[i]

    def ranges(self) -> list[tuple[int, int]]:
        """The blocks whose inside was needed, as (after, up to) ranges; neighbours joined."""
        out: list[tuple[int, int]] = []
        for i in sorted(self.inexact):
            if out and out[-1][1] == self.ends[i - 1]:
                out[-1] = (out[-1][0], self.ends[i])
            else:
                out.append((self.ends[i - 1], self.ends[i]))
        return out


def smallest_capacity(sums: RunningSums, largest: int, n_shards: int) -> int:
    """Binary search for the smallest capacity that the greedy check accepts."""
    def fits(capacity: int) -> bool:
        at = 0
        for _ in range(n_shards):
            at = sums.last_upto(at + capacity)
        return at == sums.total

    low, high = max(largest, -(-sums.total // n_shards)), sums.total
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def cut_points(sums: RunningSums, capacity: int, n_shards: int) -> list[int]:
    """Running sums after which each shard but the last ends.

    A shard takes the even share of what is left, one group at least, and as
    much as the shards after it, at full capacity, could not hold.
    """
    least = [sums.total] * n_shards  # least[k]: what k shards must hold together, for the rest to fit
    for k in range(n_shards - 1, 0, -1):
        least[k] = sums.first_from((sums.total if k == n_shards - 1 else least[k + 1]) - capacity)
    at, cuts = 0, []
    for k in range(1, n_shards):
        left = n_shards - k + 1
        share = sums.last_upto(at + -(-(sums.total - at) // left))
        at = max(least[k], share, sums.first_from(min(at + 1, sums.total)))
        cuts.append(at)
    return cuts


def _block_ends(groups: DataFrame, ranges: list[tuple[int, int]], held: int, width: int,
                blocks: int) -> dict[int, int]:
    """end -> number of groups of the blocks inside the ranges, which hold ``held`` groups.

    Few enough groups come as they are; else blocks of ``width`` do, by one aggregate.
    """
    inside, which = F.lit(False), F.lit(-1)
    for i, (a, b) in enumerate(ranges):
        fits = (F.col("upto") > a) & (F.col("upto") <= b)
        inside, which = inside | fits, F.when(fits, F.lit(i)).otherwise(which)
    if held <= 2 * blocks:
        return {r["upto"]: 1 for r in groups.where(inside).select("upto").collect()}
    rows = (groups.where(inside).groupBy(which.alias("r"), F.floor((F.col("upto") - 1) / F.lit(width)).alias("b"))
            .agg(F.max("upto").alias("e"), F.count(F.lit(1)).alias("n")).collect())
    return {r["e"]: r["n"] for r in rows}


def minimax_cuts(groups: DataFrame, n_shards: int, blocks: int = BLOCKS) -> tuple[int, list[int]]:
    """(smallest capacity, cut points) of ``groups`` (group_bytes, upto = running sum)."""
    total, largest, n = groups.agg(F.max("upto"), F.max("group_bytes"), F.count(F.lit(1))).first()
    width = max(1, -(-total // blocks))
    ends = _block_ends(groups, [(0, total)], n, width, blocks)
    while True:
        order = sorted(ends)
        sums = RunningSums(order, [ends[e] for e in order])
        capacity = smallest_capacity(sums, largest, n_shards)
        cuts = cut_points(sums, capacity, n_shards)
        if not sums.inexact:
            return capacity, cuts
        ranges = sums.ranges()
        if len(ranges) > MOST_RANGES:  # the filter stays small: the smallest gaps between ranges are refined as well
            gaps = sorted(range(1, len(ranges)), key=lambda i: ranges[i][0] - ranges[i - 1][1])
            starts = [0, *sorted(gaps[len(ranges) - MOST_RANGES:])]
            ranges = [(ranges[a][0], ranges[b - 1][1]) for a, b in zip(starts, [*starts[1:], len(ranges)])]
        # a block across a range's start would count groups outside: ranges begin and end at block ends
        gone = {e for a, b in ranges for e in order[bisect_right(order, a):bisect_right(order, b)]}
        held = sum(ends.pop(e) for e in gone)
        width = max(1, min(width // 8, -(-sum(b - a for a, b in ranges) // blocks)))
        ends |= _block_ends(groups, ranges, held, width, blocks)


def text_size(text: Column, overhead: int = OVERHEAD) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(overhead)


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, overhead: int = OVERHEAD,
                    blocks: int = BLOCKS) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null), text_md5 of every row."""
    rows = docs.select(
        "doc_id", text_size(F.col("text"), overhead).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        F.coalesce(F.md5(F.col("text")), F.lit("")).alias("text_md5"),
        F.monotonically_increasing_id().alias("at"))
    placed = written(
        rows.repartitionByRange(text_partitions(docs), "text_md5", "doc_id", "at")
        .sortWithinPartitions("text_md5", "doc_id", "at").drop("at")
        .withColumn("place", F.monotonically_increasing_id()), "shard-rows")
    groups = placed.groupBy("text_md5").agg(F.sum("size").alias("group_bytes"))
    bucket = F.coalesce(F.conv(F.substring("text_md5", 1, DIGITS), 16, 10).cast("int"), F.lit(-1))
    groups = groups.withColumn("bucket", F.when(F.col("text_md5") == "", -1).otherwise(bucket))
    before = (groups.groupBy("bucket").agg(F.sum("group_bytes").alias("bytes"))  # at most 16^DIGITS + 1 rows
              .select("bucket", (F.sum("bytes").over(Window.orderBy("bucket")) - F.col("bytes")).alias("before")))
    upto = F.sum("group_bytes").over(Window.partitionBy("bucket").orderBy("text_md5"))
    groups = written(groups.join(F.broadcast(before), "bucket")
                     .select("text_md5", "group_bytes", (F.col("before") + upto).alias("upto")), "shard-groups")
    cut_texts: list[str] = []
    if groups.head(1):
        _, cuts = minimax_cuts(groups, n_shards, blocks)
        at = {r["upto"]: r["text_md5"] for r in groups.where(F.col("upto").isin(sorted(set(cuts)))).collect()}
        cut_texts = [at[c] for c in cuts]
    shard = sum((F.when(F.col("text_md5") > c, 1).otherwise(0) for c in cut_texts), F.lit(0))
    placed = placed.withColumn("shard", shard.cast("int")) \
        .withColumn("part", F.shiftright("place", 33)).withColumn("idx", F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))
    # one row for each (shard, partition) that meet: partitions + shards of them
    runs = placed.groupBy("shard", "part").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("n"))
    runs = runs.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
                                         - F.col("first")).alias("shift"))
    return placed.join(F.broadcast(runs), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("idx") + F.col("shift")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "text_md5")
