"""Streaming deduplication, ring shards and winnowing against plain Python."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from trafficlens.llm import ring_shards, stream_dedup, winnow


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def expected_dedup(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(lower(t), []).append(i)
    return {k: (max((x for x in v if x is not None), default=None), len(v)) for k, v in groups.items()}


def collect_dedup(df):
    return df.select("spot.doc_id", F.col("keeper.doc_id").alias("keep_id"), "group_size", "kept", "digest").collect()


def test_dedup_equals_grouping(spark, frame, odd):
    rows = odd + [(10, "Äpfel AB"), (11, "Äpfel ab"), (12, "äpfel ab"), (13, "x"), (14, "X")]
    path, _ = frame(rows)
    got = collect_dedup(stream_dedup.dedup(spark, path))
    want = expected_dedup(rows)
    by_digest = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    assert len(got) == len(rows)
    for r in got:
        assert (r.keep_id, r.group_size) == by_digest[r.digest]
    assert sum(r.kept for r in got) == len(want)


def test_dedup_splits_colliding_digests(spark, frame):
    rows = [(i, f"text {i % 7}") for i in range(60)]
    path, _ = frame(rows)
    got = collect_dedup(stream_dedup.dedup(spark, path, digest=lambda t: (F.crc32(t.cast("binary")) % 2).cast("string")))
    want = expected_dedup(rows)
    text = dict(rows)
    assert all((r.keep_id, r.group_size) == want[text[r.doc_id]] for r in got) and sum(r.kept for r in got) == 7


def test_state_outlives_a_run(spark, frame, tmp_path):
    path, docs = frame([(1, "a"), (2, "b")])
    check = str(tmp_path / "state")
    first = {r.group_size for r in stream_dedup.update_state(spark, path, check, "doc_id", "text").collect()}
    docs.limit(0).union(spark.createDataFrame([(9, "A", None, None, 1)], docs.schema)).write.mode("append").parquet(path)
    again = stream_dedup.update_state(spark, path, check, "doc_id", "text").select("keeper.doc_id", "group_size").collect()
    assert first == {1} and {tuple(r) for r in again} == {(9, 2), (2, 1)}


def test_dedup_of_an_empty_table_and_of_a_frame(spark, frame, odd):
    path, docs = frame([])
    assert stream_dedup.dedup(spark, path).count() == 0
    assert stream_dedup.dedup(spark, frame([(1, "a"), (2, "A")], "two")[0] + "/").where("kept").count() == 1
    _, docs = frame(odd, "more")
    assert stream_dedup.dedup_frame(docs.withColumn("digest", F.lit(1))).count() == len(expected_dedup(odd))


def test_ring_law_slots_and_walk(spark, frame, odd):
    rows = odd + [(i, f"t{i}") for i in range(100, 1000)]
    _, docs = frame(rows)
    keep = {"size": ring_shards.content_size(F.col("text"))}
    got = ring_shards.assign(docs, "doc_id", 7, keep, vnodes=20).collect()
    assert len(got) == len(rows)
    per = {}
    for r in got:
        per.setdefault(r.shard, []).append(r.slot)
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1 and len(per) == 7
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    again = {(r.doc_id, r.shard) for r in ring_shards.assign(docs, "doc_id", 7, keep, vnodes=20).collect()}
    assert again == {(r.doc_id, r.shard) for r in got}


def test_ring_walk_fills_clockwise_and_moves_little():
    ring = ring_shards.tokens(8, 30, "s")
    rnd = random.Random(1)
    counts = {c: rnd.randint(1, 5) for c in range(0, ring_shards.CELLS, 9)}
    loose = ring_shards.walk(counts, ring, 8, 0.25)
    total = sum(counts.values())
    for cell, n in counts.items():
        spans = sorted((a, b) for c, a, b, *_ in loose if c == cell)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
    load = [sum(b - a for _, a, b, s, *_ in loose if s == k) for k in range(8)]
    assert max(load) <= total / 8 * 1.25 + 1
    home = sum(b - a for _, a, b, _, _, h in loose if h == 0)
    assert home > 0.75 * total
    nine = {(c, r): s for c, a, b, s, *_ in ring_shards.walk(counts, ring_shards.tokens(9, 30, "s"), 9, 0.25) for r in range(a, b)}
    eight = {(c, r): s for c, a, b, s, *_ in loose for r in range(a, b)}
    assert sum(nine[k] != eight[k] for k in eight) < 0.45 * total


def test_ring_of_an_empty_table(spark, frame):
    _, docs = frame([])
    assert ring_shards.assign(docs, "doc_id", 4, {"one": F.lit(1)}, vnodes=4).count() == 0


def minima(entries, window):
    if len(entries) < window:
        return {min(entries)} if entries else set()
    return {min(entries[i : i + window]) for i in range(len(entries) - window + 1)}


def test_winnow_chooses_window_minima_with_rightmost_ties(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("ab cd ef gh".split()) for _ in range(n)) for n in (0, 1, 3, 5, 6, 11, 12, 13, 60, 400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    words = winnow.let(F.transform(winnow.words(F.col("t")), lambda w: F.xxhash64(w)), lambda h: winnow.run_hashes(h, 5))
    runs = {r.i: r.h for r in df.select("i", words.alias("h")).collect()}
    out = df.select("i", winnow.chosen(F.col("t"), 5, 8).alias("e"))
    got = {r.i: r for r in out.select("i", winnow.hashes_of(F.col("e")).alias("h"), winnow.positions_of(F.col("e")).alias("p"), "e").collect()}
    mixed = {x: y for x, y in df.select(F.explode(words).alias("x")).select("x", F.shiftrightunsigned(F.xxhash64("x"), 25)).distinct().collect()}
    for i, text in enumerate(texts):
        n = len(text.split())
        if n < 5:
            assert len(got[i].e) == (1 if n else 0)
            continue
        entries = [(mixed[x], -p) for p, x in enumerate(runs[i])]
        want = minima(entries, 8)
        assert {(e >> 24, -(((1 << 24) - 1) - (e & ((1 << 24) - 1)))) for e in got[i].e} == want
        assert set(got[i].p) == {-p for _, p in want}


def test_equal_runs_have_equal_hashes_and_shared_passages_meet(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    shared = " ".join(rnd.choices(vocabulary, k=12))
    a = " ".join(rnd.choices(vocabulary, k=40)) + " " + shared
    b = shared + " " + " ".join(rnd.choices(vocabulary, k=70))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(*[winnow.hashes_of(winnow.chosen(F.col(c))).alias(c) for c in "ab"])
    row = df.collect()[0]
    assert set(row.a) & set(row.b)


def test_edited_texts(spark, frame, odd):
    rows = odd + [(20, "x" * 10), (21, "é" * 7 + " one two three four five six"), (22, "z")]
    _, docs = frame(rows)
    got = sorted(winnow.with_edited(docs).select("id", "text", "edited", "near_edited", "near_next").collect(), key=lambda r: (r.id is not None, r.id or 0, r.text))
    assert len(got) == len(rows)
    by_id = {r.id: r for r in got if r.id not in (None, 1)}
    for i, j in ((2, 3), (3, 4), (20, 21), (21, 22)):
        text, following = by_id[i].text, by_id[j].text
        cut = len(text) // 4
        assert by_id[i].edited == text[: len(text) - cut] + following[:cut]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_edited_of_an_empty_table(spark, frame):
    _, docs = frame([])
    assert winnow.with_edited(docs).count() == 0


def test_a_later_call_reads_files_with_old_times(spark, frame, tmp_path):
    path, docs = frame([(1, "a b"), (2, "c")])
    checkpoint = str(tmp_path / "checkpoint")
    assert stream_dedup.dedup(spark, path, checkpoint=checkpoint).count() == 2
    before = set(os.listdir(path))
    spark.createDataFrame([(3, "A b", None, None, 3), (4, "new", None, None, 3)], docs.schema).coalesce(1).write.mode("append").parquet(path)
    for name in set(os.listdir(path)) - before:
        os.utime(os.path.join(path, name), (1_000_000_000, 1_000_000_000))
    got = {r.spot.doc_id: (r.keeper.doc_id, r.group_size) for r in stream_dedup.dedup(spark, path, checkpoint=checkpoint).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}


def test_rows_without_state_are_an_error(spark, frame, monkeypatch):
    path, _ = frame([(1, "a b"), (2, "c")])
    update = stream_dedup.update_state
    monkeypatch.setattr(stream_dedup, "update_state", lambda *a: update(*a).where("keeper.doc_id = 1"))
    with pytest.raises(ValueError, match="1 of 2 rows"):
        stream_dedup.dedup(spark, path)
