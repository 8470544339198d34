"""Packing of token sequences by non-negative least squares over a length histogram.

Documents are cut into pieces: full windows, and what is left. Piece lengths fall into bins of ``quantum`` tokens
(rounded up). All combinations of at most ``depth`` bins that fill a window exactly are enumerated, and non-negative
least squares finds how often to repeat each so that the used lengths match the histogram. The repeat counts are
rounded down, and what they leave over is packed greedily, longest first into the tightest opening. All of this
works on the histogram, whose size is the number of bins, whatever the number of documents; pieces then take the
places of their bin by rank.

Defined results: a null text is empty and still has its end id, so every document has at least one piece; repeated
rows are documents of their own; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.common import in_order, saved, with_made, with_prefix
from trafficlens.llm.tokens import Encoder, default_path, encoder
from trafficlens.llm.worker_memory import tidy

REPEAT_CHARS = 1 << 25
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def combinations(bins: int, depth: int) -> list[tuple[int, ...]]:
    """Ascending tuples of one to ``depth`` bins with sum ``bins``."""
    out: list[tuple[int, ...]] = []

    def extend(prefix: tuple[int, ...], left: int) -> None:
        low = prefix[-1] if prefix else 1
        if left >= low:
            out.append((*prefix, left))
        if len(prefix) + 1 < depth:
            for b in range(low, left // 2 + 1):
                extend((*prefix, b), left - b)

    extend((), bins)
    return out


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """Minimise |a x - b| over x >= 0 by the active-set method."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    limit = tolerance * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(3 * n):
        pull = a.T @ (b - a @ x)
        pull[free] = -np.inf
        best = int(np.argmax(pull))
        if free.all() or pull[best] <= limit:
            break
        free[best] = True
        while True:
            at = np.flatnonzero(free)
            part = a[:, at]
            gram = part.T @ part
            s = np.linalg.solve(gram + 1e-10 * np.eye(len(at)), part.T @ b)
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = at[s <= 0]
            step = np.min(x[low] / np.maximum(x[low] - s[s <= 0], 1e-300))
            x[at] += step * (s - x[at])
            free[at[x[at] <= 1e-12]] = False
            x[~free] = 0
    return x


def solved(histogram: np.ndarray, depth: int) -> list[tuple[tuple[int, ...], int]]:
    """Repeat counts of the exact combinations, rounded down and never more pieces of a bin than there are."""
    bins = len(histogram) - 1
    patterns = [p for p in combinations(bins, depth) if all(histogram[b] for b in p)]
    if not patterns:
        return []
    use = np.zeros((bins + 1, len(patterns)))
    for j, p in enumerate(patterns):
        for b in p:
            use[b, j] += 1
    scale = histogram.max()
    repeats = np.floor(nnls(use, histogram / scale) * scale + 1e-6).astype(np.int64)
    left = histogram.copy()
    out = []
    for j in np.argsort(-repeats, kind="stable"):
        need = np.bincount(patterns[j], minlength=bins + 1)
        n = min([int(repeats[j]), *[int(left[b] // need[b]) for b in set(patterns[j])]])
        if n > 0:
            left -= n * need
            out.append((patterns[j], n))
    return out


def greedy(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Pack the rest, longest bin first into the tightest opening, many equal windows at a time."""
    bins = len(left) - 1
    openings: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(pattern: tuple[int, ...], n: int) -> None:
        if n:
            openings.setdefault(bins - sum(pattern), []).append((pattern, n))

    for b in range(bins, 0, -1):
        count = int(left[b])
        for room in sorted(r for r in openings if r >= b):
            while count and openings[room]:
                pattern, n = openings[room].pop()
                fit = min(room // b, count)
                take = min(n, count // fit)
                put(pattern + (b,) * fit, take)
                put(pattern, n - take)
                count -= take * fit
                if not count:
                    break
        if count:
            fit = bins // b
            put((b,) * fit, count // fit)
            put((b,) * (count % fit), 1 if count % fit else 0)
    return [x for group in openings.values() for x in group]


def plan(histogram: np.ndarray, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """(bins of a window, how many such windows) for all pieces of the histogram (index: bin; 0 is unused)."""
    exact = solved(histogram, depth)
    left = histogram.copy()
    for p, n in exact:
        left -= n * np.bincount(p, minlength=len(left))
    return exact + greedy(left)


def places(windows: list[tuple[tuple[int, ...], int]], bins: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per bin: first ranks, first sequence ids and slots of its runs of places, in order of rank."""
    runs: dict[int, list[tuple[int, int, int]]] = {b: [] for b in range(1, bins + 1)}
    used = dict.fromkeys(runs, 0)
    first = 0
    for pattern, n in windows:
        for slot, b in enumerate(pattern):
            runs[b].append((used[b], first, slot))
            used[b] += n
        first += n
    return {b: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for b, r in runs.items() if r}


def pieces(docs: DataFrame, window: int, id_col: str, text_col: str, tokenizer: str, end_id: int) -> DataFrame:
    """Cut every document's ids into full windows and a rest.

    A mix repeats documents: what became of a text is remembered in a task, for texts of at most ``REPEAT_CHARS`` together.
    """

    def parts_of(ids: bytes) -> list[tuple[int, int, int, int]]:
        total = len(ids) // 4
        cuts = [(start, ids[4 * start : 4 * (start + window)]) for start in range(0, total, window)]
        return [(start, len(part) // 4, zlib.crc32(part), total) for start, part in cuts]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), Encoder.pack([end_id])
        known: dict[str | None, list[tuple[int, int, int, int]]] = {}
        chars = 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            fresh = [t for t in dict.fromkeys(texts) if t not in known]
            chars += sum(len(t or "") for t in fresh)
            if chars > REPEAT_CHARS:
                known, fresh = {}, list(dict.fromkeys(texts))
                chars = sum(len(t or "") for t in fresh)
            for t in fresh:
                known[t] = parts_of(enc.encode(t, end))
            enc.trim()
            rows = [(doc, *part) for doc, t in zip(batch.column("doc_id").to_pylist(), texts, strict=True) for part in known[t]]
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(cut, "encoder"), PIECES)


def pack(
    docs: DataFrame,
    window: int = 4096,
    quantum: int = 16,
    depth: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 2,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): where each piece of each document goes."""
    if window % quantum:
        raise ValueError(f"window {window} is no multiple of the quantum {quantum}")
    bins = window // quantum
    cut = saved(pieces(docs, window, id_col, text_col, tokenizer or default_path(), end_id), "pack-pieces")
    binned = cut.withColumn("bin", F.ceil(F.col("length") / quantum).cast("int"))
    histogram = np.zeros(bins + 1, dtype=np.int64)
    for b, n in binned.groupBy("bin").count().collect():  # at most `bins` rows
        histogram[b] = n
    runs = places(plan(histogram, depth), bins)
    below = np.concatenate([[0], np.cumsum(histogram)[:-1]])

    # Rank within a bin, however many pieces it holds: the order over all pieces less those of smaller bins.
    mixed = F.xxhash64("doc_id", "start", "ids_crc32")
    ordered = in_order(binned, ["bin", mixed, "doc_id", "start"], "pack-order")
    ranked = with_prefix(ordered, {"at": F.lit(1).cast("long")})

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        sequence = np.zeros(len(frame), dtype=np.int64)
        slot = np.zeros(len(frame), dtype=np.int64)
        bin_of = frame["bin"].to_numpy()
        at = frame["at"].to_numpy()
        for b in np.unique(bin_of):
            mine = np.flatnonzero(bin_of == b)
            ranks = at[mine] - below[b]
            starts, firsts, slots = runs[int(b)]
            run = np.searchsorted(starts, ranks, side="right") - 1
            sequence[mine] = firsts[run] + ranks - starts[run]
            slot[mine] = slots[run]
        return pd.DataFrame({"sequence_id": sequence, "slot": slot})

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    placed = with_made(ranked.select(*columns, "bin", "at"), ["bin", "at"], lambda: place, "sequence_id long, slot long", drop=["bin", "at"])
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("slot")
