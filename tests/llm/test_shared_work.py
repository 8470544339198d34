"""Work of the pipeline that is done once: scans, digests, word counts, tokens of repeated texts, comparisons by batch."""

import itertools
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trafficlens.llm import chosen_path, common, language, mixing, packing, stream_dedup, tokens


@pytest.fixture
def plans(monkeypatch):
    """Physical plans of what is written, by label."""
    seen, write = {}, common.saved

    def saved(df, label, **options):
        seen[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label, **options)

    for module in (common, mixing, stream_dedup):
        monkeypatch.setattr(module, "saved", saved)
    return seen


def test_exact_copies_are_found_without_reading_texts_again(spark, frame, plans):
    _, docs = frame([(i, f"Text {i % 50}é") for i in range(60)] + [(100, None), (101, "")])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = {r.doc_id for r in stream_dedup.dedup_frame(docs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert kept == {*range(10, 60), 101}
    assert "ReadSchema" in plans["dedup-rows"] and not re.search(r"ReadSchema: .*\btext:", plans["dedup-rows"])
    assert "sha2" not in plans["dedup-rows"] + plans["dedup-collided"]
    assert "might_contain" in plans["dedup-collided"]  # texts without a hit stay out of the shuffle


def test_normalised_texts_keep_letters_beyond_ascii(spark):
    texts = ["ABC xyz 09", "ÄB İ ΣΑΣ É z", "", None, "\x00Z\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    want = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for t in texts]
    assert [r[0] for r in rows.select(stream_dedup.normalised(F.col("t"))).collect()] == want


def test_words_of_the_mix_are_counted_once(spark, frame, plans):
    _, docs = frame([(i, "a b " * i, "en", f"s{i % 2}") for i in range(1, 20)])
    assert mixing.mix(docs).count() > 0
    assert [label for label, plan in plans.items() if "regexp" in plan] == ["mix-sizes"]


class Batches:
    """Stands for a table: gives the function that works through its batches."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_a_repeated_text_is_encoded_once(spark, monkeypatch):
    texts = ["the cat", None, "a dog " * 9, "the cat", "", "a dog " * 9, "the cat"]
    made, encode = [], tokens.Encoder.encode
    monkeypatch.setattr(tokens.Encoder, "encode", lambda self, text, end: (made.append(text), encode(self, text, end))[1])
    run = packing.pieces(Batches(), 4, "doc_id", "text", packing.default_path(), 2)

    def batches():
        made.clear()  # loading the vocabulary encodes a probe
        for ids in ([0, 1, 2, 3], [4, 5, 6]):
            yield pa.record_batch({"doc_id": pa.array(ids), "text": pa.array([texts[i] for i in ids], pa.string())})

    tokens.encoder(packing.default_path())
    got = pa.Table.from_batches(run(batches())).to_pylist()
    assert sorted(made, key=str) == sorted(set(texts), key=str)
    whole = tokens.Encoder(packing.default_path()).tokenizer
    for i, t in enumerate(texts):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        mine = [r for r in got if r["doc_id"] == i]
        assert [r["length"] for r in mine] == [len(ids[k : k + 4]) for k in range(0, len(ids), 4)]
        assert {r["doc_tokens"] for r in mine} == {len(ids)}
    monkeypatch.setattr(packing, "REPEAT_CHARS", 5)
    forgetful = packing.pieces(Batches(), 4, "doc_id", "text", packing.default_path(), 2)
    assert pa.Table.from_batches(forgetful(batches())).to_pylist() == got


def test_groups_are_cut_whole_out_of_batches():
    keys = [1, 1, 2, 3, 3, 3, 3, 3, 4, 5, 5]
    for size in range(1, 12):
        frames = [pd.DataFrame({"key": keys[i : i + size], "g": 0, "x": range(i, min(i + size, 11))}) for i in range(0, 11, size)]
        parts = list(chosen_path.whole_groups(iter([frames[0].iloc[:0], *frames]), ["key", "g"]))
        assert [x for p in parts for x in p["x"]] == list(range(11))
        assert all(set(a["key"]).isdisjoint(b["key"]) for a, b in itertools.combinations(parts, 2))
        for p in parts:
            assert p["group"].tolist() == [sorted(set(p["key"])).index(k) for k in p["key"]]


@pytest.mark.parametrize("pairs", [1, 50, 1 << 16])
def test_buckets_of_a_batch_are_compared_together(monkeypatch, pairs):
    monkeypatch.setattr(chosen_path, "PAIRS", pairs)
    rng = np.random.default_rng(3)
    n = 120
    family = rng.integers(0, 256, (6, chosen_path.TOKENS), dtype=np.uint8)
    brief = family[rng.integers(0, 6, n)]
    noise = rng.random(brief.shape) < rng.choice([0.0, 0.05, 0.2], n)[:, None]
    brief = np.where(noise, rng.integers(0, 256, brief.shape, dtype=np.uint8), brief)
    sizes, group, own = rng.integers(90, 130, n).astype(np.int32), np.sort(rng.integers(0, 9, n)), rng.integers(0, 2, n)
    g, h = np.zeros(n, int), group % 2  # a bucket by itself, or two blocks
    own = own * h
    left, right = np.flatnonzero(own == g), np.flatnonzero(own == h)
    a, b = chosen_path.alike(brief, sizes, group, left, right, 0.8)
    least = (0.8 - 4 * (0.8 * 0.2 / 128) ** 0.5) * 128
    want = {
        (i, j)
        for i in left for j in right
        if group[i] == group[j] and (h[i] or i < j)
        and min(sizes[i], sizes[j]) >= 0.8 * max(sizes[i], sizes[j]) - 1e-9 and (brief[i] == brief[j]).sum() >= least
    }
    assert len(want) > 20 and len(a) == len(want) and {(int(min(x)), int(max(x))) for x in zip(a, b, strict=True)} == {(min(x), max(x)) for x in want}


def test_intersections_of_rows_with_themselves():
    rng = random.Random(2)
    sets = [np.array(sorted(rng.sample(range(60), rng.randint(1, 40))), dtype=np.uint64) for _ in range(12)]
    every = np.arange(12)
    for left, right in ((every, every), (every[:5], every[5:])):
        got = chosen_path.overlaps(sets, left, right)
        assert all(got[x, y] == len(np.intersect1d(sets[i], sets[j])) for x, i in enumerate(left) for y, j in enumerate(right) if i != j)


def test_pieces_are_found_where_they_stand():
    pieces = language.vocabulary(language.default_path())
    names = {n: i for i, n in enumerate(pieces.names) if i}
    for _, codes in language.by_length(["nation", "über", "日本", "qzxj", "información", "the", "wörterbuch", "zzzzzz"]):
        found = pieces.matches(codes)
        words = ["".join(map(chr, column)) for column in codes.T]
        got = {(w, s, e): i for s, e, rows, ids in found.hits for w, i in zip(np.arange(len(words))[rows], ids, strict=True)}
        want = {}
        for w, word in enumerate(words):
            for s, e in itertools.combinations(range(len(word) + 1), 2):
                if word[s:e] in names or e == s + 1:
                    want[w, s, e] = names.get(word[s:e], 0)
        assert got == want and [hit[0] for hit in found.hits] == sorted(hit[0] for hit in found.hits)


def test_words_are_all_runs_of_letters():
    for text in ("Don't. stop,now", "a1b² x_y\x1cz Ünï,code…日本 ½ß", "1,000.50 e-mail@Home.ORG", "ΣΑΣ İx  ", "", None):
        assert language.words_of(text) == re.findall(r"[^\W\d_]+", (text or "").lower())


def test_a_slice_of_words_is_scored_in_one_go():
    model = language.LanguageModel(["a", "b"], np.zeros(2), np.zeros((1, 2)), "")
    asked = []
    model.log_probs = lambda words: (asked.append(list(words)), np.array([[len(w), -len(w)] for w in words], dtype=float).reshape(-1, 2))[1]
    known = language.KnownWords(model, limit=5)
    for words in (["a", "bb", "a", "ccc"], ["bb", "dddd", "a"], ["e" * 5, "f" * 6, "a"], ["bb", "g" * 7, "a"]):
        places = known.learn(words)
        assert known.table[places, 0].tolist() == [len(w) for w in words]
    assert asked == [["a", "bb", "ccc"], ["dddd"], ["e" * 5, "f" * 6], ["g" * 7]]


def test_batches_of_words_are_joined():
    frames = [pd.DataFrame({"x": [i] * 4}) for i in range(7)]
    got = list(language.joined(iter(frames), 10))
    assert [len(f) for f in got] == [12, 12, 4] and pd.concat(got)["x"].tolist() == pd.concat(frames)["x"].tolist()
    assert list(language.joined(iter([]), 10)) == []
