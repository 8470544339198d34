"""Jaccard self-join of word n-grams by chosen paths.

Documents with equal shingle sets are one text from the start: their number is carried along and they are never paired
with each other. Each text's set is embedded as ``TOKENS`` min-hash tokens, of which two sets share a fraction equal to
their similarity. A run splits all sets from a root: a node chooses some of the tokens at random, about 1 / threshold of
them, and sends a set to one child for each chosen token and the value it has there. Similar sets go on together,
others part. A bucket that is small enough is compared by brute force; a larger one is split again, and one that is
still large at ``depth`` (sets that are really alike) is compared in pairs of blocks that are spread over tasks. Runs
are repeated until a pair at the threshold is missed with a probability of at most 1 - ``recall``.

A bucket passes on a spanning forest of what looks alike in it, not its pairs. The connected texts then meet with their
whole sets, again in pairs of blocks: every pair is counted exactly, so links within a group are complete and none is
made up. No step emits the pairs of a group.

Defined results: words are parted by white space and compared in lower case; a text of fewer than ``n`` words is one
shingle; texts without words (null too) have an empty set and are copies of each other only; repeated rows are
copies; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.common import components, saved, with_made
from trafficlens.llm.worker_memory import tidy

TOKENS = 128
SLACK_SIGMAS = 4.0
WORD_LIMIT = 131_072
PAIRS = 1 << 16
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


MULTIPLY = mix(np.arange(1, TOKENS + 1, dtype=np.uint64)) | np.uint64(1)
ADD = mix(np.arange(1001, 1001 + TOKENS, dtype=np.uint64))


class Words(dict):
    """64-bit hashes of words, remembered within a task."""

    def __missing__(self, word: str) -> int:
        if len(self) > WORD_LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``n`` words."""
    parts = (text or "").lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts), dtype=np.uint64, count=len(parts))
    width = min(n, len(h))
    if not width:
        return h
    runs = np.full(len(h) - width + 1, width, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            runs = runs * BASE + h[j : len(h) - width + 1 + j]
    found = np.sort(mix(runs))
    return found[np.append(True, found[1:] != found[:-1])]


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The min-hash tokens of a set: 32 bits each, so that chance does not fill buckets; comparing needs one byte of each."""
    low = np.full(TOKENS, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 4096):
            hashed = hashes[i : i + 4096] * MULTIPLY[:, None]
            hashed += ADD[:, None]
            np.minimum(low, hashed.min(axis=1), out=low)
    return (mix(low) >> np.uint64(32)).astype(np.uint32)


def digest(hashes: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def survival(depth: int) -> float:
    """Probability that a pair at the threshold is together somewhere ``depth`` splits below the root."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return p


def runs_for(recall: float, depth: int) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(depth))))


def children(keys: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child key) for every token that a row's node chose; ``keys`` has the node of each row, or one for all."""
    spot = mix(np.arange(5001, 5001 + TOKENS, dtype=np.uint64))
    chosen = mix(keys[:, None] ^ spot[None, :]) < np.uint64(min(1.0, 1 / (threshold * TOKENS)) * 2.0**64)
    row, i = np.nonzero(np.broadcast_to(chosen, tokens.shape))
    keys = np.broadcast_to(keys, len(tokens))
    return row, mix(mix(keys[row] + spot[i]) ^ (tokens[row, i].astype(np.uint64) + np.uint64(1)))


def lowest(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component of each of ``size`` nodes: its smallest member."""
    root = np.arange(size)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all() and (root[a] == root[b]).all():
            break
    return root


def forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the pairs (a, b) connect: every other member of a component to its least id.

    The same group met in many buckets mostly gives the same edges.
    """
    nodes = np.unique(np.concatenate([a, b]))
    if not len(nodes):
        return ids[:0], ids[:0]
    root = lowest(len(ids), a, b)[nodes]
    order = np.lexsort((ids[nodes], root))
    nodes, root = nodes[order], root[order]
    first = np.searchsorted(root, root)
    child = first < np.arange(len(nodes))
    return ids[nodes[child]], ids[nodes[first[child]]]


def near_sizes(group: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``right`` by group and size, and where in it the rows begin and end that stand in the group of a row of ``left`` and
    whose sizes allow the threshold: up to size / threshold."""
    place = group.astype(np.int64) << 32
    right = right[np.argsort(place[right] + sizes[right], kind="stable")]
    by_size = place[right] + sizes[right]
    first = np.searchsorted(by_size, place[left] + np.ceil(sizes[left] * threshold - 1e-9).astype(np.int64), side="left")
    end = np.searchsorted(by_size, place[left] + np.floor(sizes[left] / threshold + 1e-9).astype(np.int64), side="right")
    return right, first, end


def alike(
    tokens: np.ndarray, sizes: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one of ``left``, one of ``right``) of a group whose sizes allow the threshold and whose tokens come near it.

    Two rows that both stand on both sides meet once. Pairs are compared ``PAIRS`` at a time.
    """
    least = (threshold - SLACK_SIGMAS * math.sqrt(threshold * (1 - threshold) / TOKENS)) * TOKENS
    right, first, end = near_sizes(group, sizes, left, right, threshold)
    both = np.zeros(len(group), dtype=bool)
    both[left[np.isin(left, right)]] = True
    meets = np.concatenate([[0], np.cumsum(end - first)])
    out_a, out_b = [], []
    at = 0
    while at < len(left):
        stop = max(at + 1, int(np.searchsorted(meets, meets[at] + PAIRS, side="right")) - 1)
        times = (end - first)[at:stop]
        a = np.repeat(left[at:stop], times)
        b = right[np.arange(meets[at], meets[stop]) + np.repeat(first[at:stop] - meets[at:stop], times)]
        once = ~(both[a] & both[b]) | (a < b)
        a, b = a[once], b[once]
        hit = (tokens[a] == tokens[b]).sum(axis=1, dtype=np.uint8) >= least
        out_a.append(a[hit])
        out_b.append(b[hit])
        at = stop
    return np.concatenate(out_a or [left[:0]]), np.concatenate(out_b or [left[:0]])


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact sizes of all intersections (left x right): products of membership rows, a slice of the shingles at a time.

    Where both sides are the same rows, what a row would share with itself is left open.
    """
    used = left if np.array_equal(left, right) else np.concatenate([left, right])
    owner = np.concatenate([np.full(len(sets[i]), i) for i in used])
    value, spot, times = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)  # a shingle of one set adds to no intersection
    column = np.full(len(value), -1)
    column[shared] = np.arange(len(shared))
    at = column[spot]
    row_l = np.full(len(sets), -1)
    row_l[left] = np.arange(len(left))
    row_r = np.full(len(sets), -1)
    row_r[right] = np.arange(len(right))
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    for i in range(0, len(shared), 8192):
        s = slice(np.searchsorted(at, i), np.searchsorted(at, i + 8192))
        m = np.zeros((2, max(len(left), len(right)), min(8192, len(shared) - i)), dtype=np.float32)
        for side, rows in enumerate((row_l, row_r)):
            r = rows[owner[s]]
            m[side, r[r >= 0], at[s][r >= 0] - i] = 1
        out += m[0, : len(left)] @ m[1, : len(right)].T
    return out


def grouped(frames: Iterator[pd.DataFrame], key: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Whole groups out of batches that are sorted by ``key``; a group may span batches."""
    kept: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        values = frame[list(key)].to_numpy()
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        if kept and (kept[-1][list(key)].iloc[-1].to_numpy() != values[0]).any():
            yield pd.concat(kept) if len(kept) > 1 else kept[0]
            kept = []
        edges = [0, *cuts, len(frame)]
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            kept.append(frame.iloc[a:b])
            if i < len(edges) - 2:
                yield pd.concat(kept) if len(kept) > 1 else kept[0]
                kept = []
    if kept:
        yield pd.concat(kept) if len(kept) > 1 else kept[0]


def whole_groups(frames: Iterator[pd.DataFrame], key: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Batches that are sorted by ``key``, cut so that no group spans two of them; ``group`` numbers those of a batch."""

    def numbered(frame: pd.DataFrame) -> pd.DataFrame:
        values = frame[list(key)].to_numpy()
        return frame.assign(group=np.append(0, np.cumsum((values[1:] != values[:-1]).any(axis=1))))

    kept: list[pd.DataFrame] = []  # the last group so far
    for frame in frames:
        if frame.empty:
            continue
        last = (frame[list(key)].to_numpy() == frame[list(key)].iloc[-1].to_numpy()).all(axis=1)
        if last.all() and (not kept or (kept[0][list(key)].iloc[0] == frame[list(key)].iloc[0]).all()):
            kept.append(frame)
            continue
        yield numbered(pd.concat([*kept, frame[~last]], ignore_index=True))
        kept = [frame[last]]
    if kept:
        yield numbered(pd.concat(kept, ignore_index=True))


def in_blocks(rows: DataFrame, key: str, count: str, node: str, block: int) -> DataFrame:
    """Deal the rows of a key to pairs of blocks ``(g, h)`` of about ``block`` rows; ``own`` is the row's block.

    A key of at most ``block`` rows is the one pair (0, 0). All pairs of rows meet in exactly one pair of blocks.
    """
    blocks = F.ceil(F.col(count) / block).cast("int")
    own = rows.withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64(node), blocks).cast("int")})
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumns({"g": F.least("own", "other"), "h": F.greatest("own", "other")}).drop("other", "blocks", count)


def dealt(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(key, "g", "h").sortWithinPartitions(key, "g", "h")


def describe(docs: DataFrame, key: Sequence[str], text_col: str, n: int) -> DataFrame:
    """(id, text_hash, d1, d2, size, tokens, brief) of every row: what is needed without the text."""

    def start() -> Callable[[pd.DataFrame], pd.DataFrame]:
        def make(frame: pd.DataFrame) -> pd.DataFrame:
            sets = [shingles(t, n) for t in frame["text"]]
            d = [digest(s) for s in sets]
            tokens = [sketch(s) for s in sets]
            return pd.DataFrame(
                {
                    "d1": [x[0] for x in d], "d2": [x[1] for x in d], "size": [len(s) for s in sets],
                    "tokens": [t.tobytes() for t in tokens], "brief": [t.astype(np.uint8).tobytes() for t in tokens],
                }
            )

        return make

    rows = docs.select(F.struct(*key).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return saved(with_made(rows, ["text"], start, "d1 long, d2 long, size int, tokens binary, brief binary", drop=["text"]), "path-rows")


def matrix(column: pd.Series, kind: type = np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind).reshape(len(column), TOKENS)


def candidates(texts: DataFrame, threshold: float, recall: float, depth: int, bucket: int) -> DataFrame:
    """Edges (a, b) that connect all texts found alike in some bucket of some run."""
    roots = mix(np.arange(9001, 9001 + runs_for(recall, depth), dtype=np.uint64))

    def start(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            tokens, node = matrix(frame["tokens"]), frame["node"].to_numpy()
            for root in roots:
                row, key = children(np.array([root]), tokens, threshold)
                yield pd.DataFrame({"key": key.view(np.int64), "node": node[row]})

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            row, key = children(frame["key"].to_numpy().view(np.uint64), matrix(frame["tokens"]), threshold)
            yield pd.DataFrame({"key": key.view(np.int64), "node": frame["node"].to_numpy()[row]})

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(frames, ["key", "g", "h"]):
            own = part["own"].to_numpy()
            left, right = np.flatnonzero(own == part["g"].to_numpy()), np.flatnonzero(own == part["h"].to_numpy())
            found = alike(matrix(part["brief"], np.uint8), part["size"].to_numpy(), part["group"].to_numpy(), left, right, threshold)
            a, b = forest(part["node"].to_numpy(), *found)
            yield pd.DataFrame({"a": a, "b": b})

    known = texts.select("node", "size", "brief")
    tokens = texts.select("node", "tokens")
    rows = tokens.mapInPandas(tidy(start), "key long, node long")
    edges = []
    for level in range(1, depth + 1):
        rows = saved(rows, "path-keys")
        counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = saved(rows.join(counts, "key").join(known, "node"), "path-buckets")
        ready = shared if level == depth else shared.where(F.col("n") <= bucket)
        spread = in_blocks(ready, "key", "n", "node", bucket)
        edges.append(saved(dealt(spread, "key").mapInPandas(tidy(compare), "a long, b long").distinct(), "path-edges"))
        if level < depth:
            large = shared.where(F.col("n") > bucket)
            if large.isEmpty():
                break
            rows = large.select("key", "node").join(tokens, "node").select("key", "node", "tokens").mapInPandas(tidy(split), "key long, node long")
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    return out


def verified(docs: DataFrame, key: Sequence[str], text_col: str, members: DataFrame, n: int, threshold: float, block: int) -> DataFrame:
    """Exact links inside candidate groups: rows (node, texts, docs) with link counts, and rows (node, parent) of a forest."""

    def sets_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [shingles(t, n) for t in frame.pop("text")]
            right = [d == digest(s) for d, s in zip(zip(frame["d1"], frame["d2"], strict=True), sets, strict=True)]
            yield frame.drop(columns=["d1", "d2"]).assign(hashes=[s.tobytes() for s in sets])[right]

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[tuple[np.ndarray, ...]] = []

        def passed_on() -> pd.DataFrame:
            columns = [np.concatenate(c) for c in zip(*done, strict=True)]
            done.clear()
            return pd.DataFrame(dict(zip(["node", "texts", "docs", "parent"], columns, strict=True)))

        for part in grouped(frames, ["root", "g", "h"]):
            if not part["node"].is_unique:
                part = part.drop_duplicates("node")  # rows repeated in full come once
            g, h = part["g"].iloc[0], part["h"].iloc[0]
            own, ids, copies = part["own"].to_numpy(), part["node"].to_numpy(), part["copies"].to_numpy()
            sets = [np.frombuffer(x, dtype=np.uint64) for x in part["hashes"]]
            size = np.array([len(s) for s in sets], dtype=np.float64)
            left, right = np.flatnonzero(own == g), np.flatnonzero(own == h)
            if not len(left) or not len(right):
                continue
            common = overlaps(sets, left, right)
            union = size[left][:, None] + size[right][None, :] - common
            link = common >= threshold * union - 1e-9
            if g == h:
                np.fill_diagonal(link, False)
            texts, rows = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
            texts[left] += link.sum(axis=1)
            rows[left] += link @ copies[right]
            if g != h:
                texts[right] += link.sum(axis=0)
                rows[right] += link.T @ copies[left]
            a, b = np.nonzero(link)
            up = dict(zip(*(x.tolist() for x in forest(ids, left[a], right[b])), strict=True))
            parents = np.array([up.get(i) for i in ids.tolist()], dtype=object)
            done.append((ids, texts, rows, parents))
            if sum(len(x[0]) for x in done) > 10_000:
                yield passed_on()
        if done:
            yield passed_on()

    rows = docs.select(F.struct(*key).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    same = rows["id"].eqNullSafe(members["id"]) & (rows["text_hash"] == members["text_hash"])
    wanted = rows.join(members, same).select("root", "n", "node", "copies", "d1", "d2", "text")
    made = wanted.mapInPandas(tidy(sets_of), "root long, n long, node long, copies long, hashes binary")
    spread = in_blocks(made, "root", "n", "node", block)
    return saved(dealt(spread, "root").mapInPandas(tidy(count), "node long, texts long, docs long, parent long"), "path-links")


def similarity_classes(
    docs: DataFrame,
    key: Sequence[str] = ("doc_id",),
    text_col: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    recall: float = 0.9999,
    depth: int = 3,
    bucket: int = 512,
    block: int = 256,
) -> DataFrame:
    """One row per row of ``docs``: (id, class_id, representative, copies, text_links, links).

    ``id`` is the struct of ``key``. ``representative`` is the least id among the documents with the same shingle set,
    of which there are ``copies``; ``class_id`` is the least id among all that are connected by links. ``text_links``
    counts the other shingle sets at or above the threshold, ``links`` the documents that have them, copies included.
    """
    rows = describe(docs, key, text_col, n)
    equal = rows.groupBy("d1", "d2", "size", "tokens", "brief").agg(F.min(F.struct("id", "text_hash")).alias("first"), F.count(F.lit(1)).alias("copies"))
    texts = saved(
        equal.select(
            F.monotonically_increasing_id().alias("node"), "d1", "d2", "size", "tokens", "brief", "copies",
            F.col("first.id").alias("id"), F.col("first.text_hash").alias("text_hash"),
        ),
        "path-texts",
    )
    near = components(candidates(texts.where("size > 0"), threshold, recall, depth, bucket), "path-candidates")
    sizes = near.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    members = texts.join(near.join(sizes, "root"), texts["node"] == near["id"]).select(
        texts["id"], "text_hash", "d1", "d2", "node", "copies", "root", "n"
    )
    found = verified(docs, key, text_col, members, n, threshold, block)
    groups = components(found.where("parent is not null").select(F.col("node").alias("a"), F.col("parent").alias("b")), "path-groups")
    sums = found.groupBy("node").agg(F.sum("texts").alias("text_links"), F.sum("docs").alias("links"))
    labelled = texts.join(groups.withColumnRenamed("id", "node"), "node", "left").join(sums, "node", "left")
    labelled = labelled.withColumn("root", F.coalesce("root", "node"))
    least = labelled.groupBy("root").agg(F.min("id").alias("class_id"))
    named = labelled.join(least, "root").select(
        "d1", "d2", "class_id", F.col("id").alias("representative"), "copies",
        F.coalesce("text_links", F.lit(0)).alias("text_links"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
    )
    return rows.select("id", "d1", "d2").join(named, ["d1", "d2"]).drop("d1", "d2")
