"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring is divided into ``CELLS`` equal cells; a shard owns ``vnodes`` tokens, each at a cell border. A key hashes to
a ring position and belongs to the first token clockwise. Every shard has a capacity; keys that reach a full shard
continue clockwise to the next shard with room. Cells are filled in ring order and keys in order of position, so the
walk needs only the number of keys of each cell: it is done once over at most ``CELLS`` counts (a fixed bound), gives
for each cell the ranges of ranks that go to each shard, and one join by cell then places all rows.

Slack 0 makes the capacities the even shares themselves (counts differ by one at most); a positive slack lets a shard
take up to (1 + slack) of its share and leaves more keys on their home shard.

Defined results: a null key hashes like any other value; rows with equal keys are ordered by content hash, so repeated
rows may part but reruns agree up to rows that are equal in full; an empty table gives no rows; names of input
columns do not matter, only ``key`` and the columns of ``keep`` are read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_BITS = 14
CELLS = 1 << CELL_BITS


def tokens(shards: int, vnodes: int, seed: str) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node in ring order; a cell holds one token, taken cells pass to the next free one."""
    if shards * vnodes > CELLS // 2:
        raise ValueError(f"{shards} shards of {vnodes} virtual nodes need a finer ring than {CELLS} cells")
    taken: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            cell = int.from_bytes(hashlib.sha256(f"{seed}/{shard}/{v}".encode()).digest()[:8], "big") % CELLS
            while cell in taken:
                cell = (cell + 1) % CELLS
            taken[cell] = shard
    return sorted(taken.items())


def capacities(total: int, shards: int, slack: float) -> list[int]:
    """Even shares (the first ones take the remainder), widened by ``slack``."""
    even = [total // shards + (s < total % shards) for s in range(shards)]
    return [int(e * (1 + slack)) for e in even]


def walk(counts: dict[int, int], ring: list[tuple[int, int]], shards: int, slack: float) -> list[tuple[int, int, int, int, int, int]]:
    """Ranges (cell, from_rank, to_rank, shard, first_slot, hops): which keys of a cell go where.

    First every cell fills its home shard while there is room, in ring order; then what overflowed walks on, again in
    ring order. Hops count the further shards tried.
    """
    cells = [c for c, _ in ring]
    free = capacities(sum(counts.values()), shards, slack)
    used = [0] * shards
    out = []

    def place(cell: int, rank: int, left: int, shard: int, hops: int) -> int:
        n = min(left, free[shard])
        if n:
            out.append((cell, rank, rank + n, shard, used[shard], hops))
            used[shard] += n
            free[shard] -= n
        return n

    overflow = []
    for cell in sorted(counts):
        at = bisect_left(cells, cell) % len(ring)
        n = place(cell, 0, counts[cell], ring[at][1], 0)
        if n < counts[cell]:
            overflow.append((cell, at, n))
    for cell, at, rank in overflow:
        tried = {ring[at][1]}
        while rank < counts[cell]:
            at = (at + 1) % len(ring)
            shard = ring[at][1]
            if shard not in tried:
                tried.add(shard)
                rank += place(cell, rank, counts[cell] - rank, shard, len(tried) - 1)
    return out


def assign(
    df: DataFrame, key: str, shards: int, keep: dict[str, Column], vnodes: int = 100, slack: float = 0.0, seed: str = "ring"
) -> DataFrame:
    """(key, *keep, shard, slot, hops) for every row; slots number a shard's rows from 0 without a gap."""
    spark = df.sparkSession
    position = F.xxhash64(F.lit(seed), F.col(key))
    rows = df.select(F.col(key).alias("__key"), position.alias("__at"), *[c.alias(n) for n, c in keep.items()])
    rows = rows.withColumn("__cell", F.shiftrightunsigned("__at", 64 - CELL_BITS).cast("int"))
    counts = {r[0]: r[1] for r in rows.groupBy("__cell").count().collect()}
    ring = tokens(shards, vnodes, seed)
    schema = "__cell int, __from long, __to long, shard int, __slot long, hops int"
    plan = spark.createDataFrame(walk(counts, ring, shards, slack), schema)
    order = Window.partitionBy("__cell").orderBy("__at", "__key", F.xxhash64(*keep))
    ranked = rows.withColumn("__rank", F.row_number().over(order).cast("long") - 1)
    # at most CELLS ranges and one more for each time a shard fills up
    placed = ranked.join(F.broadcast(plan), "__cell").where("__rank >= __from and __rank < __to")
    return placed.select(F.col("__key").alias(key), *keep, "shard", (F.col("__slot") + F.col("__rank") - F.col("__from")).alias("slot"), "hops")


def content_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16 for the record."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


