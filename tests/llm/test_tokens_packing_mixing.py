"""Token files, packing and mixing against plain Python."""

import glob
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from trafficlens.llm import mixing, packing, token_files, tokens
from trafficlens.llm.common import located

TRICKY = [
    "Été l'école <|endoftext|>x don't you'LL 12 ab12 \x1cfoo bar \x85 İstanbul ΣΑΣ ﬁ éa '' -- #tag… “q” naïve\tTab\r\nx_y  z",
    "日本語 テスト 안녕 Привет, мир! éa   a b", "", "   ", "word" * 50, "A.B.C. (x) [y] --'s 's 'tis ...'ll",
]


def reference_ids(texts):
    enc = tokens.Encoder(tokens.default_path()).tokenizer
    return [np.array([*e.ids, 2], dtype="<u4") for e in enc.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_cached_encoder_equals_the_library():
    enc = tokens.Encoder(tokens.default_path(), limit=5)
    for _ in range(2):
        for text, want in zip(TRICKY, reference_ids(TRICKY), strict=True):
            assert enc.encode(text, enc.pack([2])) == want.tobytes()
            enc.trim()


def test_a_word_is_encoded_once_for_all_its_forms_and_generations_are_not_copied(monkeypatch):
    words = [f"bl{a}nd{b}r" for a in "aeiouéø" for b in "aeiouéø"]
    texts = [" ".join(words), " ".join(w.capitalize() for w in words), " ".join(f"{w.upper()}," for w in words)]
    want = [x.tobytes() for x in reference_ids(texts)]
    enc = tokens.Encoder(tokens.default_path(), limit=100)
    made, fresh = [], tokens.Parts.fresh
    monkeypatch.setattr(tokens.Parts, "fresh", lambda self, part: (made.append(part), fresh(self, part))[1])
    assert [enc.encode(t, enc.pack([2])) for t in texts] == want
    assert sum(p in words for p in made) == len(words) and made.count(",") <= 1
    full = enc.parts
    enc.trim()
    assert enc.parts is not full and enc.parts.older is full and not full.older
    made.clear()
    assert [enc.encode(t, enc.pack([2])) for t in texts] == want and not made


def test_another_vocabulary_is_read_by_the_library():
    import public_tokenizers

    other = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert other.whole and not tokens.Encoder(tokens.default_path()).whole
    for text in ("Hello World,\n two  blanks ", "", None):
        assert other.encode(text, b"") == tokens.Encoder.pack(other.tokenizer.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_round_trip(spark, frame, odd, tmp_path, encoding):
    rows = [r for r in odd if r[0] is not None] + [(100 + i, t) for i, t in enumerate(TRICKY)]
    _, docs = frame(rows)
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs.withColumn("tokens", F.lit(0)), path, encoding=encoding)
    got = token_files.token_index(spark, path).orderBy("doc_id", "start").collect()
    ordered = sorted(rows, key=lambda r: r[0])
    want = reference_ids([r[1] for r in ordered])
    starts = np.cumsum([0] + [len(w) for w in want])
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == [
        (o[0], s, len(w), zlib.crc32(w.tobytes())) for o, s, w in zip(ordered, starts[:-1], want, strict=True)
    ]
    meta = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path}/*.parquet")]
    groups = [m.row_group(g).column(c) for m in meta for g in range(m.num_row_groups) for c in range(m.num_columns)]
    lists = [c for c in groups if c.path_in_schema.startswith("tokens")]
    assert all(c.has_offset_index for c in groups) and lists
    assert all(("DELTA_BINARY_PACKED" in c.encodings) == (encoding == "delta") for c in lists)


def test_token_files_without_rows_and_with_null_ids(spark, frame, tmp_path):
    _, docs = frame([])
    token_files.write_tokens(docs, str(tmp_path / "none"))
    assert token_files.token_index(spark, str(tmp_path / "none")).count() == 0
    _, docs = frame([(None, "b"), (None, None), (1, "a")], "nulls")
    token_files.write_tokens(docs, str(tmp_path / "some"))
    assert token_files.token_index(spark, str(tmp_path / "some")).orderBy("start").collect()[-1].doc_id == 1


def check_packing(got, rows, window):
    by_doc = {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    total = sum(len(w) for w in reference_ids([r[1] for r in rows]))
    assert sum(r.length for r in got) == total
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for spans in sequences.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
        assert spans[-1][0] + spans[-1][1] <= window
    return total / (window * len(sequences))


def test_packing_places_every_token_once(spark, frame, odd):
    rng = np.random.default_rng(2)
    rows = odd + [(100 + i, "word " * int(n)) for i, n in enumerate(rng.integers(1, 200, 300))]
    _, docs = frame(rows)
    fill = check_packing(packing.pack(docs, window=128, quantum=4).collect(), rows, 128)
    assert fill > 0.93


def test_packing_of_an_empty_table_and_of_one_length(spark, frame):
    _, docs = frame([])
    assert packing.pack(docs).count() == 0
    rows = [(i, "a " * 9) for i in range(50)]
    _, docs = frame(rows, "even")
    check_packing(packing.pack(docs, window=64, quantum=2).collect(), rows, 64)


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(1)
    for histogram in (rng.integers(0, 50, 65), np.eye(65, dtype=np.int64)[3] * 1000, np.zeros(65, dtype=np.int64)):
        histogram[0] = 0
        used = np.zeros_like(histogram)
        for pattern, n in packing.plan(histogram):
            assert sum(pattern) <= 64 and n > 0
            used += n * np.bincount(pattern, minlength=65)
        assert (used == histogram).all()


def test_nnls_finds_the_optimum():
    rng = np.random.default_rng(4)
    a, b = rng.random((12, 30)), rng.random(12) - 0.3
    x = packing.nnls(a, b)
    gradient = a.T @ (a @ x - b)
    assert (x >= 0).all() and (gradient > -1e-6).all() and abs(gradient @ x) < 1e-6


def test_targets_are_capped_and_shared_again():
    sizes = {"a": 10, "b": 1000, None: 1000}
    weights = mixing.weights_by_order(list(sizes))
    assert weights == {"a": 3.0, "b": 1.0, None: 2.0}
    got = mixing.targets(sizes, weights, 1.5, 2.0)
    assert got["a"] == 20 and abs(sum(got.values()) - 3015) < 1e-9 and abs(got[None] / got["b"] - 2) < 1e-9
    assert mixing.targets({"z": 0}, {"z": 3.0}, 1.5, 2.0) == {"z": 0.0}


def test_schedule_takes_targets_to_a_word(spark, frame, odd):
    rng = np.random.default_rng(3)
    rows = [r for r in odd if r[0] is not None]
    rows += [(100 + i, "w " * int(n), "en", s) for i, (n, s) in enumerate(zip(rng.integers(0, 90, 200), rng.choice(["p", "q", "r", "É", "hot", "hot", "hot"], 200), strict=True))]
    _, docs = frame(rows)
    size = mixing.word_count(F.col("text"))
    table, mix = mixing.schedule(docs, ["doc_id"], size, "source", block=50)
    got = table.join(docs.select("doc_id", "source").distinct(), "doc_id").collect()
    assert len(got) == len(rows)
    for source in {r.source for r in got}:
        mine = [r for r in got if r.source == source]
        assert sum(r.size for r in mine) == mine[0].source_size
        assert sum(r.taken for r in mine) == round(mine[0].target)
        assert all(r.taken <= 2 * r.size for r in mine)
    slots = mix.collect()
    assert sum(r.words for r in slots) == sum(r.taken for r in got)
    again = {tuple(r) for r in mixing.schedule(docs, ["doc_id"], size, "source", block=50)[0].collect()}
    assert again == {tuple(r) for r in table.collect()}
    # every tenth of the mix holds each source near its share
    source = {r.doc_id: r.source for r in got}
    last = max(r.slot for r in slots) + 1
    share = {s: sum(r.target for r in got if r.source == s) / max(1, sum(r.source == s for r in got)) for s in set(source.values())}
    for k in range(5):
        part = [r for r in slots if last * k // 5 <= r.slot < last * (k + 1) // 5]
        words = sum(r.words for r in part)
        for s, t in share.items():
            assert abs(sum(r.words for r in part if source[r.doc_id] == s) - words * t / sum(share.values())) <= 3.5 * 50 + 1


def test_mix_repeats_whole_documents_in_slot_order(spark, frame):
    rows = [(i, f"d{i} " + "w " * (i % 11) + "end", "en", "ab"[i % 2]) for i in range(40)]
    _, docs = frame(rows)
    landed = located(docs, "mix-test")
    spot = ["__in_file", "__in_row"]  # the order of a source's documents follows a hash of the key: the same one as in mix
    table, slots = (
        t.join(landed.select(*spot, "doc_id"), spot) for t in mixing.schedule(landed, spot, mixing.word_count(F.col("text")), "source", block=16)
    )
    made = mixing.mix(docs, block=16)
    assert made.columns == docs.columns
    got = made.collect()
    text = {r[0]: r[1] for r in rows}
    assert all(r.text == text[r.doc_id] for r in got)
    copies = Counter(r.doc_id for r in got)
    for r in table.collect():
        assert abs(copies[r.doc_id] * r.size - r.taken) <= r.size / 2 and copies[r.doc_id] <= 2
    partly = [r for r in table.collect() if copies[r.doc_id] * r.size != r.taken]
    assert len(partly) <= 2  # one per source
    # inside every partition copies come in the order of the slots that start them
    starts = defaultdict(list)
    for r in sorted(slots.where("word = 0").collect(), key=lambda r: r.slot):
        starts[r.doc_id].append(r.slot)
    at = made.select("doc_id", F.spark_partition_id().alias("p")).collect()
    seen, order = Counter(), defaultdict(list)
    for r in at:
        order[r.p].append(r.doc_id)
    for ids in order.values():
        seen.clear()
        place = []
        for i in ids:
            place.append(starts[i][seen[i]])
            seen[i] += 1
        assert place == sorted(place)


def test_mix_of_an_empty_table(spark, frame):
    _, docs = frame([])
    assert mixing.mix(docs).count() == 0
