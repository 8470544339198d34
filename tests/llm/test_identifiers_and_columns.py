"""Identifiers beyond 2**53 next to null ones, and columns whose names clash with those an operator makes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trafficlens.llm import chosen_path, language, minhash_dedup, packing, toxicity
from trafficlens.llm.common import hold_out

BIG = 2**60
IDS = [BIG + 1, None, BIG + 3, BIG + 5]
TEXTS = ["the cat and the dog run over the hill", "a short text of words here", "le chat et le chien courent sur la colline", "the cat and the dog run over the wall"]


@pytest.fixture
def docs(frame):
    return frame([(i, t, "en" if t.startswith("the") else "fr", "s") for i, t in zip(IDS, TEXTS, strict=True)])[1].coalesce(1)


def scored(spark, docs):
    labels = spark.createDataFrame([(BIG + 1, 0, 1), (BIG + 3, 1, 0)], "doc_id long, quality int, toxic int")
    return [r["id"] for r in toxicity.score(docs, labels, ~hold_out("doc_id", 5, 0)).collect()]


def told(spark, docs):
    return [r["doc_id"] for r in language.predict(docs, language.train(docs)).collect()]


def joined(spark, docs):
    return [r["id"]["doc_id"] for r in chosen_path.similarity_classes(docs).collect()]


def packed(spark, docs):
    return [r["doc_id"] for r in packing.pack(docs).collect()]


def grouped(spark, docs):
    return [r["doc_id"] for r in minhash_dedup.near_groups(docs).collect()]


@pytest.mark.parametrize("ids_of", [scored, told, joined, packed, grouped])
def test_identifiers_survive(spark, docs, ids_of):
    assert sorted(ids_of(spark, docs), key=str) == sorted(IDS, key=str)


def test_links_of_large_identifiers_are_found(spark, frame):
    base = " ".join(f"w{i}" for i in range(100))
    _, docs = frame([(BIG + 1, base), (None, "other"), (BIG + 3, base + " end")])
    got = {r["id"]["doc_id"]: r["class_id"]["doc_id"] for r in chosen_path.similarity_classes(docs.coalesce(1)).collect()}
    assert got == {BIG + 1: BIG + 1, BIG + 3: BIG + 1, None: None}


def test_language_with_clashing_columns(spark, docs):
    more = docs.withColumns({"score": F.lit("mine"), "lang_pred": F.lit(7), "__text": F.lit(0)})
    kept = corpus_pipeline.identify_language(spark, more, "")
    assert kept.columns == more.columns
    assert {r["score"] for r in kept.collect()} <= {"mine"}


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_that_clash(spark, docs, stage):
    more = docs.withColumns({c: F.lit(c) for c in ("score", "id", "size", "taken", "slot", "class_id", "kept", "digest")})
    path = docs.inputFiles()[0].rsplit("/", 1)[0] + "-more"
    more.write.mode("overwrite").parquet(path)
    assert stage(spark, spark.read.parquet(path), "").columns == more.columns


def test_known_words_stay_within_two_generations():
    model = language.LanguageModel(["a", "b"], np.zeros(2), np.ones((language.vocabulary(language.default_path()).size + 1, 2)), language.default_path())
    model.log_probs = lambda words: np.array([[len(w), -len(w)] for w in words], dtype=float).reshape(len(words), 2)
    known = language.KnownWords(model, limit=4)
    for words in (["a", "bb"], ["bb", "ccc", "a"], ["dddd", "a"], ["eeeee"] * 3, ["f" * 6, "bb", "a"], [f"{'g' * n}" for n in range(1, 9)]):
        known.learn(words)
        assert known.total(words).tolist() == [sum(map(len, words)), -sum(map(len, words))]
        assert len(known.row) <= max(4, len(set(words)))
