"""Shards of near equal bytes from a minimax contiguous partition.

Equal texts are an atomic group. A group that alone is over an equal share of what is left gets a shard of its
own, so that it doesn't set the capacity of the others. The other groups stand in the order of a 64-bit hash of their text, and the
smallest capacity is found, by binary search, with which a greedy walk over them needs no more
than the wanted number of shards. The driver holds the sizes of `buckets` equal ranges of the
hash only, and of `buckets` parts of each range in which a cut of the search lies, down to single groups: some thousands of
numbers for each cut that is tried, however many groups there are. Cuts are hashes, so a row's shard is an expression. Slots come from a
range sort by hash and id, which splits a hot group, and counts of its partitions.

Defined results: null texts count as empty. Repeated rows each get a slot of their own. With fewer
groups than shards, shards stay empty. Other columns are ignored.
"""
from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, staged

SHARDS, BUCKETS = 16, 1 << 12


class Line:
    """Ordered group sizes, seen through sums over equal ranges of the hash: 2**step ranges for the whole line, and
    as many again for a range, when a cut falls in it and it holds more than one group.

    fetch(level, prefixes) -> {prefix: [(range, bytes, groups)]}, the ranges in order. A range is the
    hash shifted right by 64 - step * (level + 1); a prefix, by 64 - step * level.
    """

    def __init__(self, step: int, fetch):
        self.step, self.fetch = step, fetch
        self.known: dict[tuple[int, int], tuple[list[int], list[int], list[int]]] = {}
        _, sums, _ = self.ranges(0, 0)
        self.total = sums[-1] if sums else 0

    def shift(self, level: int) -> int:
        return max(0, 64 - self.step * level)

    def ranges(self, level: int, prefix: int, later: range = range(0)) -> tuple[list[int], list[int], list[int]]:
        """The ranges of a node: their numbers, running sums of bytes, groups. Those of the line in which the sums `later` lie come along."""
        if (level, prefix) not in self.known:
            wanted = {prefix}
            if level == 1:
                numbers, sums, groups = self.known[0, 0]
                near = {min(bisect_right(sums, x), len(sums) - 1) for x in later}
                wanted |= {numbers[k] for k in near if groups[k] > 1 and (1, numbers[k]) not in self.known}
            for p, rows in self.fetch(level, sorted(wanted)).items():
                self.known[level, p] = ([r[0] for r in rows], list(accumulate(r[1] for r in rows)), [r[2] for r in rows])
        return self.known[level, prefix]

    def last_within(self, limit: int, stride: int) -> tuple[int, int | None]:
        """The largest sum of a prefix of whole groups that is at most `limit`, and the least hash
        that may follow it; None at the line's end. stride: where further limits may be expected."""
        level, prefix, before = 0, 0, 0
        while True:
            numbers, sums, groups = self.ranges(level, prefix, range(limit, self.total, max(1, stride)))
            k = bisect_right(sums, limit - before)
            if k == len(numbers):
                return self.total, None  # only of the whole line
            before += sums[k - 1] if k else 0
            if groups[k] == 1 or not self.shift(level + 1):
                return before, numbers[k] << self.shift(level + 1)
            level, prefix = level + 1, numbers[k]

    def cuts(self, capacity: int, shards: int) -> list[int] | None:
        """The least hash of each shard but the first, greedily; None if the groups don't fit."""
        out, at = [], 0
        for _ in range(shards - 1):
            at, after = self.last_within(at + capacity, capacity)
            if after is None:
                return out
            out.append(after)
        return out if self.total - at <= capacity else None

    def coarse(self, capacity: int, shards: int) -> bool:
        """Whether whole ranges of the line fit, greedily; then groups do, too."""
        numbers, sums, _ = self.ranges(0, 0)
        at = 0
        for _ in range(shards):
            k = bisect_right(sums, at + capacity)
            if k == len(numbers):
                return True
            at = sums[k - 1] if k else 0
        return False


def least(low: int, high: int, fits) -> int:
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def smallest_capacity(line: Line, largest: int, shards: int) -> int:
    """Binary search, over whole ranges first to narrow it down, then over groups."""
    low = max(largest, -(-line.total // shards))
    high = least(low, max(line.total, low), lambda c: line.coarse(c, shards))
    return least(low, high, lambda c: line.cuts(c, shards) is not None)


def alone(largest: list[tuple[int, int]], total: int, n: int) -> list[int]:
    """Hashes of the groups that get a shard each. largest: (hash, size), the largest first."""
    out = []
    for h, size in largest:
        if len(out) == n - 1 or size * (n - len(out)) <= total:
            break
        out.append(h)
        total -= size
    return out


def shards(docs: DataFrame, n: int = SHARDS, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, group_hash for each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = staged(
        id_and_text(docs, id_col, text_col).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")),
        "sizes",
    )
    if buckets & (buckets - 1):
        raise ValueError("buckets is a power of two")
    step = buckets.bit_length() - 1
    groups = staged(rows.groupBy("h").agg(F.sum("size").alias("bytes")).repartitionByRange("h").sortWithinPartitions("h"), "groups")
    own = alone([(r[0], r[1]) for r in groups.orderBy(F.desc("bytes"), "h").limit(n).collect()], groups.agg(F.sum("bytes")).first()[0] or 0, n)
    rest = n - len(own)
    if own:
        groups = groups.filter(~F.col("h").isin(own))

    def fetch(level: int, prefixes: list[int]) -> dict[int, list[tuple[int, int, int]]]:
        """`buckets` rows for each prefix at most."""
        inside = groups
        if level:
            up = max(0, 64 - step * level)
            # a range of hashes, so that the scan skips what lies outside
            inside = groups.filter(reduce(lambda a, b: a | b, [F.col("h").between(p << up, (p << up) + (1 << up) - 1) for p in prefixes]))
        prefix = F.shiftright("h", max(0, 64 - step * level)) if level else F.lit(0)
        down = F.shiftright("h", max(0, 64 - step * (level + 1)))
        got: dict[int, list[tuple[int, int, int]]] = {p: [] for p in prefixes}
        for p, child, size, count in inside.groupBy(prefix.cast("long").alias("p"), down.alias("c")).agg(F.sum("bytes"), F.count("*")).collect():
            got[p].append((child, size, count))
        return {p: sorted(x) for p, x in got.items()}

    line = Line(step, fetch)
    capacity = smallest_capacity(line, groups.agg(F.max("bytes")).first()[0] or 0, rest)
    shard = F.lit(0)
    for cut in line.cuts(capacity, rest) or []:
        shard = shard + (F.col("h") >= cut).cast("int")
    for k, h in enumerate(own):
        shard = F.when(F.col("h") == h, rest + k).otherwise(shard)
    order = ["shard", "h", "doc_id"]
    sorted_rows = rows.withColumn("shard", shard).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    laid = staged(sorted_rows, "ordered")
    part = F.shiftright("at", 33).cast("int")
    counts = sorted((r[0], r[1], r[2]) for r in laid.groupBy(part.alias("p"), "shard").count().collect())  # partitions plus shards
    starts, first, before = {}, {}, 0
    for p, s, c in counts:
        starts.setdefault(p, before)
        first.setdefault(s, before)
        before += c
    spark = docs.sparkSession
    where = spark.createDataFrame([(p, s) for p, s in starts.items()], "p int, part_start long")
    begin = spark.createDataFrame([(s, c) for s, c in first.items()], "shard int, shard_start long")
    inside = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    # both tables are bounded: a row for each partition, and for each shard
    placed = laid.withColumn("p", part).join(F.broadcast(where), "p").join(F.broadcast(begin), "shard")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("part_start") + inside - F.col("shard_start")).alias("slot"), F.col("h").alias("group_hash"))
