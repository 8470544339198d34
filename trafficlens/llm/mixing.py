"""Mixing sources to target weights by a low-discrepancy schedule.

A source's documents, in an order shuffled by hash, form a stream of words that is cut into blocks of equal size; a
source that is used more than once repeats its stream. Slots of the mix are the points of the golden-ratio sequence:
the point's place in the cumulated target weights names the source, and the rank of the slot among its source's slots
names the block. Every stretch of the mix then holds the sources close to their weights. A source whose slots fall
short of its target by the discrepancy of the sequence (a few blocks) gets the missing ones at the end; the last block
is cut so that a source's words are its target exactly, to a word.

Targets: sources by code point (null last) weigh 3, 1, 2, repeating; they share ``share`` times all words; a target
stops at ``cap`` times its source's words, and what is over is shared again by weight.

What passes the driver is one row per source. Slots and blocks are rows of Spark tables.

Defined results: a null text has no words, a document without words is never taken; a null source is a source of its
own; repeated rows count each; an empty table gives no rows; extra columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.common import PART, ROW, in_order, located, saved, small_table, with_prefix
from trafficlens.llm.worker_memory import tidy

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = (5**0.5 - 1) / 2
SLOTS_PER_CHUNK = 1 << 15
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weights_by_order(sources: Sequence[str | None], cycle: Sequence[float] = (3, 1, 2)) -> dict[str | None, float]:
    ordered = sorted(sources, key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))
    return {s: float(cycle[i % len(cycle)]) for i, s in enumerate(ordered)}


def targets(sizes: dict, weights: dict, share: float, cap: float) -> dict:
    """Each source's words in the mix: by weight, no more than ``cap`` times its own, the excess shared again by weight."""
    left = share * sum(sizes.values())
    out = dict.fromkeys(sizes, 0.0)
    open_ = {s for s in sizes if sizes[s] > 0}
    while open_ and left > 0:
        unit = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if unit * weights[s] >= cap * sizes[s]}
        if not full:
            for s in open_:
                out[s] = unit * weights[s]
            break
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def points(first: int, n: int) -> np.ndarray:
    """Golden-ratio points ``first`` to ``first + n - 1``; the high part is reduced first to keep all digits."""
    high, low = divmod(first + np.arange(n, dtype=np.int64), 1 << 20)
    return np.mod(high * np.mod(GOLDEN * (1 << 20), 1.0) + low * GOLDEN, 1.0)


def schedule(
    docs: DataFrame,
    key: Sequence[str],
    size: Column,
    source_col: str,
    share: float = 1.5,
    cap: float = 2.0,
    cycle: Sequence[float] = (3, 1, 2),
    block: int = 4096,
    seed: str = "mix",
) -> tuple[DataFrame, DataFrame]:
    """The mix as two tables.

    ``rows``: (*key, size, source_size, target, taken) for every document. ``mix``: (slot, *key, word, words), which
    words of which document stand in which slot of the mix. ``key`` should tell rows apart; if it does not, the rows
    still count one by one.
    """
    spark = docs.sparkSession
    # written: the bounds of the ranges are drawn from all rows first, and texts would be read and counted twice
    slim = saved(docs.select(*key, F.col(source_col).alias("__source"), size.alias("size")), "mix-sizes")
    order = [F.col("__source").asc_nulls_last(), F.xxhash64(F.lit(seed), *key), *key]
    placed = with_prefix(in_order(slim, order, "mix-order"), {"start": F.col("size")})

    totals = {r[0]: (r[1], r[2]) for r in placed.groupBy("__source").agg(F.sum("size"), F.min("start")).collect()}
    sizes = {s: int(t[0]) for s, t in totals.items()}
    target = targets(sizes, weights_by_order(list(sizes), cycle), share, cap)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    quota = np.array([round(target[s]) for s in names], dtype=np.int64)
    needed = -(-quota // block)
    schema = "__source string, __s int, source_size long, target double, __quota long, __base long"
    table = small_table(
        spark, [(s, i, sizes[s], float(target[s]), int(quota[i]), int(totals[s][1])) for i, s in enumerate(names)], schema
    )
    if len(names) <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    rows = saved(
        placed.join(table, placed["__source"].eqNullSafe(table["__source"])).select(
            *key, PART, ROW, "size", "source_size", "target", "__s", (F.col("start") - F.col("__base")).alias("start")
        ),
        "mix-rows",
    )

    slots = ranked_slots(spark, needed)
    limit = small_table(spark, [(i, int(quota[i]), sizes[s]) for i, s in enumerate(names)], "__s int, __quota long, __size long")
    limit = F.broadcast(limit) if len(names) <= BROADCAST_SOURCES else limit
    # Blocks of the repeated stream as segments [a, b) of one pass; a block may run over the end of a pass.
    at = slots.join(limit, "__s").withColumn("a", F.col("rank") * block).withColumn("b", F.least(F.col("a") + block, F.col("__quota")))
    passes = at.withColumn("pass", F.explode(F.sequence(F.expr("a div __size"), F.expr("(b - 1) div __size"))))
    low, high = F.greatest(F.col("a") - F.col("pass") * F.col("__size"), F.lit(0)), F.least(F.col("b") - F.col("pass") * F.col("__size"), F.col("__size"))
    segments = passes.select("slot", "__s", low.alias("a"), high.alias("b"))
    cells = segments.withColumn("cell", F.explode(F.sequence(F.expr(f"a div {block}"), F.expr(f"(b - 1) div {block}"))))

    spans = rows.where("size > 0").select(*key, PART, ROW, "__s", "start", (F.col("start") + F.col("size")).alias("stop"))
    spread = spans.withColumn("cell", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(stop - 1) div {block}"))))
    first = F.greatest("a", "start", F.col("cell") * block)
    last = F.least("b", "stop", (F.col("cell") + 1) * block)
    met = spread.join(cells, ["__s", "cell"]).where(first < last)
    mix = saved(met.select("slot", *key, PART, ROW, (first - F.col("start")).alias("word"), (last - first).alias("words")), "mix-slots")

    taken = mix.groupBy(PART, ROW).agg(F.sum("words").alias("taken"))
    out = rows.join(taken, [PART, ROW], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return out.select(*key, "size", "source_size", "target", "taken"), mix.drop(PART, ROW)


def ranked_slots(spark, needed: np.ndarray) -> DataFrame:
    """(slot, __s, rank): the source of every slot and the slot's rank among those of its source.

    Chunks of slots count their sources apart; a chunk's ranks start from the counts of the chunks before it.
    """
    total = int(needed.sum())
    bounds = np.cumsum(needed) / max(total, 1)
    chunks = -(-total // SLOTS_PER_CHUNK)

    def sources_of(chunk: int) -> tuple[int, np.ndarray]:
        first = chunk * SLOTS_PER_CHUNK
        n = min(SLOTS_PER_CHUNK, total - first)
        return first, np.minimum(np.searchsorted(bounds, points(first, n), side="right"), len(needed) - 1)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for chunk in frame["id"]:
                n = np.bincount(sources_of(int(chunk))[1], minlength=len(needed))
                yield pd.DataFrame({"chunk": chunk, "__s": np.arange(len(n), dtype=np.int32), "n": n})

    ids = spark.range(chunks, numPartitions=max(1, min(chunks, 4 * spark.sparkContext.defaultParallelism)))
    counts = saved(ids.mapInPandas(tidy(count), "chunk long, __s int, n long"), "mix-counts")
    before = F.expr("coalesce(sum(n) over (partition by __s order by chunk rows between unbounded preceding and 1 preceding), 0)")
    bases = counts.withColumn("base", before).where("n > 0").groupBy("chunk").agg(F.collect_list(F.struct("__s", "base")).alias("bases"))

    def rank(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for chunk, bases_ in zip(frame["chunk"], frame["bases"], strict=True):
                first, source = sources_of(int(chunk))
                base = np.zeros(len(needed), dtype=np.int64)
                for x in bases_:
                    base[x["__s"]] = x["base"]
                order = np.argsort(source, kind="stable")
                starts = np.searchsorted(source[order], np.arange(len(needed)))
                ranks = np.empty(len(source), dtype=np.int64)
                ranks[order] = np.arange(len(source)) - starts[source[order]]
                ranks += base[source]
                use = ranks < needed[source]
                yield pd.DataFrame({"slot": (first + np.arange(len(source)))[use], "__s": source[use].astype(np.int32), "rank": ranks[use]})

    spread = bases.repartition(max(1, min(chunks, 4 * spark.sparkContext.defaultParallelism)), "chunk")
    slots = spread.mapInPandas(tidy(rank), "slot long, __s int, rank long")
    got = {r[0]: r[1] for r in counts.groupBy("__s").agg(F.sum("n")).collect()}
    short = [(s, r) for s in range(len(needed)) for r in range(got.get(s, 0), int(needed[s]))]
    if short:  # a few blocks per source
        late = [(total + i, s, r) for i, (s, r) in enumerate(sorted(short, key=lambda x: (x[1], x[0])))]
        slots = slots.unionByName(small_table(spark, late, "slot long, __s int, rank long"))
    return slots


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The documents as often as the mix takes them, whole and with all columns.

    A copy of a document comes for every time the schedule starts it. One copy per source is only partly within the
    target: it comes if at least half of its words are. Copies are dealt by document; in each of the files or partitions
    that result they stand by the slot in which the schedule starts them, so each is a share of the mix in its order.
    """
    key = ["__in_file", "__in_row"]
    landed = located(docs, "mix-landing")
    rows, slots = schedule(landed, key, word_count(F.col(text_col)), source_col, **kw)
    copies = rows.where("taken > 0").select(*key, F.round(F.col("taken") / F.col("size")).cast("int").alias("__copies"))
    begun = slots.where("word = 0").groupBy(*key).agg(F.sort_array(F.collect_list("slot")).alias("__slots"))  # two starts at most
    starts = copies.join(begun, key).select(*key, F.explode(F.slice("__slots", F.lit(1), F.col("__copies"))).alias("__slot"))
    return landed.join(starts, key).sortWithinPartitions("__slot").select(*docs.columns)
