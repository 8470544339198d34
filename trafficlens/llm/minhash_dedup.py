"""Near-duplicate groups by min-hash, bands, verification and alternating stars.

A text's set is its distinct shingles of five words. Equal sets are one node from the start, however many documents have
them. ``HASHES`` universal hash functions (multiply, add, upper bits) each keep their minimum over a set; the minima are
cut into bands of ``ROWS``, and sets that agree in a whole band share a bucket. At a similarity of 0.85 two sets share no
bucket with a probability of 3e-7. What shares a bucket is told apart in two steps, neither of which emits its pairs:

1. every set of a bucket is compared with the bucket's least and greatest member, by signature and then on full sets.
   This joins most of a large family at once, and buckets whose members are all joined are done;
2. in the buckets left over, sets not joined yet are compared by signature, in pairs of blocks of bounded size spread
   over tasks. What looks alike is passed on as a spanning forest; the groups it connects meet with their full sets, again
   in pairs of blocks, where every pair is counted exactly.

A link counts only when the full sets bear it out: ``100 * intersection >= percent * union``. Components of the links come
from alternating large-star and small-star steps; each step is written, and only a count and a checksum reach the driver.

Defined results: words are parted by ASCII white space after lower-casing A-Z; a text of fewer words than a shingle is one
shingle; a text without words (null too) has an empty set and stays alone. Ties and repeated rows: equal texts share one
component, also under one identifier. Null identifiers are passed over when the least one is looked for, so a component
of nothing else has a null ``component_id``. An empty table gives no rows; columns that are not asked for are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.llm.chosen_path import BASE, Words, dealt, forest, grouped, in_blocks, mix, overlaps
from trafficlens.llm.common import saved

ROWS, BANDS = 6, 32
HASHES = ROWS * BANDS
SLACK_SIGMAS = 5.0
BUCKET_BLOCK, SET_BLOCK = 512, 256
MULTIPLY = mix(np.arange(20_001, 20_001 + HASHES, dtype=np.uint64)) | np.uint64(1)
ADD = mix(np.arange(30_001, 30_001 + HASHES, dtype=np.uint64))
BAND_SEED = mix(np.arange(40_001, 40_001 + BANDS, dtype=np.uint64))


def shingle_set(text: bytes | None, n: int, words: Words) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``n`` words of a UTF-8 text."""
    parts = (text or b"").lower().split()  # of bytes: A-Z only, ASCII white space only
    h = np.fromiter(map(words.__getitem__, parts), dtype=np.uint64, count=len(parts))
    width = min(n, len(h))
    if not width:
        return h
    runs = np.full(len(h) - width + 1, width, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            runs = runs * BASE + h[j : len(h) - width + 1 + j]
    return np.unique(mix(runs))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 2048):
            values = hashes[i : i + 2048] * MULTIPLY[:, None]
            values += ADD[:, None]
            np.minimum(low, values.min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and row of ``low`` (sets, hashes)."""
    parts = low.reshape(len(low), BANDS, ROWS)
    key = np.broadcast_to(BAND_SEED, parts.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            key = mix(key * BASE + parts[:, :, i])
    return key.view(np.int64)


def briefs(low: np.ndarray) -> np.ndarray:
    """One byte of each minimum, enough to estimate a similarity: chance adds a little, never takes away."""
    return (mix(low) >> np.uint64(56)).astype(np.uint8)


def least_agreement(percent: int) -> float:
    """Agreeing minima below which a pair at the threshold practically never falls."""
    p = percent / 100
    return (p - SLACK_SIGMAS * math.sqrt(p * (1 - p) / HASHES)) * HASHES


def bears_out(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return 100 * common >= percent * (len(a) + len(b) - common)


def describe(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(row, id, text_hash, d1, d2, n_shingles, bands, brief) of every row: what is needed without the text."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    more = "d1 long, d2 long, n_shingles long, bands array<long>, brief binary"
    schema = T.StructType([rows.schema["id"], rows.schema["text_hash"], *T._parse_datatype_string(more).fields])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            digests = np.empty((len(texts), 2), dtype=np.int64)
            sizes, low = np.empty(len(texts), dtype=np.int64), np.empty((len(texts), HASHES), dtype=np.uint64)
            for i, text in enumerate(texts):
                hashes = shingle_set(text, n, words)
                digests[i] = np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), dtype=np.int64)
                sizes[i], low[i] = len(hashes), minima(hashes)
            ends = pa.array(np.arange(0, len(texts) * BANDS + 1, BANDS), pa.int32())
            bands = pa.ListArray.from_arrays(ends, pa.array(band_keys(low).ravel()))
            brief = pa.array([b.tobytes() for b in briefs(low)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(sizes), bands, brief], names=schema.names
            )

    return saved(rows.mapInArrow(make, schema).withColumn("row", F.monotonically_increasing_id()), "minhash-rows")


def edges_state(graph: DataFrame) -> tuple:
    return tuple(graph.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def star_components(edges: DataFrame, label: str, rounds: int = 100) -> DataFrame:
    """(node, root) of every node of ``edges(a, b)`` (long) but the roots themselves: the least node of each component.

    Large star: a node's greater neighbours are tied to its least one. Small star: a node and its lesser neighbours are tied
    to the least of them. Both keep what is connected; in turn they end with one star per component.
    """
    graph = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), f"{label}-edges")
    state = edges_state(graph)
    for _ in range(rounds):
        both = graph.union(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        tied = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = saved(tied.where("a > b").distinct(), f"{label}-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(low, "a").select("a", "b", "m")
        ties = tied.select("a", F.col("m").alias("b")).union(tied.select(F.col("b").alias("a"), F.col("m").alias("b")))
        graph = saved(ties.where("a > b").distinct(), f"{label}-small")
        before, state = state, edges_state(graph)
        if state == before:
            return graph.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle within {rounds} rounds")


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """(key, node, n, lo, hi) of buckets of two sets or more; of buckets with the same members one is kept."""
    rows = nodes.select(F.explode("bands").alias("key"), "node")
    kinds = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
    )
    first = kinds.where("n > 1").groupBy("n", "lo", "hi", "x", "y").agg(F.min("key").alias("key")).drop("x", "y")
    return saved(rows.join(first, "key"), "minhash-buckets")


def full_sets(docs: DataFrame, id_col: str, text_col: str, n: int, wanted: DataFrame) -> DataFrame:
    """(node, hashes) for ``wanted(id, text_hash, node)``: the sets of those rows' texts."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    found = rows.join(wanted, rows["id"].eqNullSafe(wanted["id"]) & (rows["text_hash"] == wanted["text_hash"])).select("node", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            sets = [shingle_set(t, n, words).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "hashes"])

    return saved(found.mapInArrow(make, "node long, hashes binary"), "minhash-sets")  # rows repeated in full give a set twice


def confirmed(edges: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``edges(a, b)`` whose signatures agree and whose full sets are alike enough."""
    least = least_agreement(percent)

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, HASHES) for c in ("brief_a", "brief_b"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)
            hit = [bears_out(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in pairs]
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    def with_both(rows: DataFrame, side: DataFrame, column: str, name: str) -> DataFrame:
        for end in ("a", "b"):
            rows = rows.join(side.select(F.col("node").alias(end), F.col(column).alias(f"{name}_{end}")), end)
        return rows.select("a", "b", f"{name}_a", f"{name}_b")

    near = saved(with_both(edges, nodes, "brief", "brief").mapInArrow(agree, "a long, b long"), "minhash-near")
    return saved(with_both(near, sets, "hashes", "set").mapInArrow(compare, "a long, b long").distinct(), "minhash-links")


def alike(brief: np.ndarray, sizes: np.ndarray, root: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one of ``left``, one of ``right``) of different roots whose sizes and signatures allow the threshold."""
    least = least_agreement(percent)
    right = right[np.argsort(sizes[right], kind="stable")]
    by_size = sizes[right]
    out_a, out_b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for x in left:
        lo = np.searchsorted(by_size, sizes[x] * percent / 100 - 1e-9, side="left")
        hi = np.searchsorted(by_size, sizes[x] * 100 / percent + 1e-9, side="right")
        near = right[lo:hi]
        near = near[root[near] != root[x]]
        near = near[(brief[near] == brief[x]).sum(axis=1) >= least]
        out_a.append(np.full(len(near), x))
        out_b.append(near)
    return np.concatenate(out_a).astype(np.int64), np.concatenate(out_b).astype(np.int64)


def left_over(buckets: DataFrame, nodes: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect what looks alike in a bucket and is not joined yet."""

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in grouped(frames, ["key", "g", "h"]):
            if len(part) < 2:
                continue
            own, ids = part["own"].to_numpy(), part["node"].to_numpy()
            left, right = np.flatnonzero(own == part["g"].iloc[0]), np.flatnonzero(own == part["h"].iloc[0])
            brief = np.frombuffer(b"".join(part["brief"]), dtype=np.uint8).reshape(-1, HASHES)
            a, b = forest(ids, *alike(brief, part["n_shingles"].to_numpy(), part["root"].to_numpy(), left, right, percent))
            if len(a):
                yield pd.DataFrame({"a": a, "b": b})

    rows = buckets.select("key", "node", "n").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    wanted = saved(rows.join(mixed, "key"), "minhash-mixed")
    spread = in_blocks(wanted.join(nodes.select("node", "n_shingles", "brief"), "node"), "key", "n", "node", BUCKET_BLOCK)
    return saved(dealt(spread, "key").mapInPandas(compare, "a long, b long").distinct(), "minhash-candidates")


def confirmed_groups(candidates: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of forests that connect what is linked on full sets within each group of candidates."""
    near = star_components(candidates, "minhash-groups")
    members = near.union(near.select(F.col("root").alias("node"), "root").distinct())
    counts = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in grouped(frames, ["root", "g", "h"]):
            part = part.drop_duplicates("node")
            own, ids = part["own"].to_numpy(), part["node"].to_numpy()
            left, right = np.flatnonzero(own == part["g"].iloc[0]), np.flatnonzero(own == part["h"].iloc[0])
            if not len(left) or not len(right):
                continue
            one = [np.frombuffer(x, dtype=np.uint64) for x in part["hashes"]]
            size = np.array([len(s) for s in one], dtype=np.int64)
            common = overlaps(one, left, right).astype(np.int64)
            link = 100 * common >= percent * (size[left][:, None] + size[right][None, :] - common)
            x, y = np.nonzero(link)
            keep = left[x] != right[y]
            a, b = forest(ids, left[x[keep]], right[y[keep]])
            if len(a):
                yield pd.DataFrame({"a": a, "b": b})

    spread = in_blocks(members.join(counts, "root").join(sets, "node"), "root", "n", "node", SET_BLOCK)
    return saved(dealt(spread, "root").mapInPandas(count, "a long, b long").distinct(), "minhash-links")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: (``id_col``, n_shingles, component_id: the least identifier reachable over links)."""
    rows = describe(docs, id_col, text_col, n)
    filled = rows.where("n_shingles > 0")
    nodes = saved(filled.groupBy("d1", "d2", "n_shingles", "bands", "brief").agg(F.min("row").alias("node"), F.min("id").alias("least_id")), "minhash-nodes")
    buckets = shared_buckets(nodes)
    shared = buckets.select("node").distinct()
    sets = full_sets(docs, id_col, text_col, n, rows.join(shared, rows["row"] == shared["node"]).select("id", "text_hash", "node"))
    ends = buckets.select("node", F.explode(F.array("lo", "hi")).alias("b")).where("node != b")
    links = confirmed(ends.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct(), nodes, sets, percent)
    joined = star_components(links, "minhash-joined")
    more = confirmed_groups(left_over(buckets, nodes, joined, percent), sets, percent)
    groups = star_components(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), "minhash-components")
    rooted = nodes.select("d1", "d2", "node", "least_id").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select("d1", "d2", "component_id")
    alone = rows.where("n_shingles = 0").select(F.col("id").alias(id_col), "n_shingles", F.col("id").alias("component_id"))
    return filled.select(F.col("id").alias(id_col), "n_shingles", "d1", "d2").join(named, ["d1", "d2"]).drop("d1", "d2").union(alone)
