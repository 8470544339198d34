"""The registered queries of the text operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from trafficlens.llm import (
    chosen_path, collocations, language, minhash_dedup, mixing, packing, ring_shards, stream_dedup, surrogates, token_files, toxicity, whitening, winnow,
)
from trafficlens.llm.common import documents, hold_out
from trafficlens.session import prepare, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def llm_sql() -> dict[str, str]:
    return dict(SQL)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@query
def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return surrogates.replace(docs, b"documents")


@query
def op2_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.score(docs, labels, ~hold_out("doc_id", 5, 0))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return rows.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "score", predicted, "posterior", "votes")


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = hold_out("doc_id", 3, 1)
    model = language.train(docs.where(~held))
    return language.predict(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": held})


@query
def op4_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mixing.schedule(documents(spark, sf_dir), ["doc_id"], mixing.word_count(F.col("text")), "source")
    return rows


@query
def op5_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chosen_path.similarity_classes(documents(spark, sf_dir))
    return rows.select(
        F.col("id.doc_id").alias("doc_id"), F.col("class_id.doc_id").alias("class_id"), F.col("representative.doc_id").alias("representative"),
        "copies", "text_links", "links",
    )


@query
def op6_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    keep = {"size": ring_shards.content_size(text), "text_crc32": ring_shards.text_crc(text)}
    out = ring_shards.assign(documents(spark, sf_dir), "doc_id", 40, keep)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hops"
    )


@query
def op7_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def hex_text(hashes: Column) -> Column:
    return F.concat_ws(" ", F.transform(hashes, lambda h: F.lower(F.hex(h))))


@query
def op8_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnow.with_edited(documents(spark, sf_dir))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        hex_text(F.col("hashes")).alias("fingerprint"),
        hex_text(F.col("edited_hashes")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query
def op9_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents(spark, sf_dir)
    rows = stream_dedup.dedup(spark, f"{sf_dir}/documents.parquet")
    return rows.select(
        F.col("spot.doc_id").alias("doc_id"), F.col("keeper.doc_id").alias("keep_id"), "group_size", "kept", F.col("digest").alias("text_sha256")
    )


SQL["op9_stream_dedup"] = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(n) AS text_sha256
FROM t WINDOW g AS (PARTITION BY n)
"""


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_tokens(documents(spark, sf_dir), path)
    return token_files.token_index(spark, path)


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = whitening.long_form(*whitening.whiten(vectors, "embedding", ["vec_id"]))
    return rows.select(F.col("keep.vec_id").alias("vec_id"), "component", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened", "explained", "identity_error")


@query
def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = minhash_dedup.near_groups(documents(spark, sf_dir), "doc_id")
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir))


SQL["op12_minhash"] = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS row_id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\x0C\r]+') AS w
  FROM documents
),
shingled AS (
  SELECT row_id, doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM docs WHERE len(w) > 0
),
sets AS (SELECT min(row_id) AS node, list_sort(s) AS s, len(s) AS n FROM shingled GROUP BY ALL),
flat AS (SELECT node, n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.node AS u, b.node AS v FROM flat a JOIN flat b ON a.x = b.x AND a.node < b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reached AS (SELECT node AS u, node AS v FROM sets UNION SELECT r.u, e.v FROM reached r JOIN both_ways e ON r.v = e.u),
members AS (SELECT sets.node, shingled.doc_id FROM sets JOIN shingled ON list_sort(shingled.s) = sets.s),
least AS (SELECT u AS node, min(doc_id) AS component_id FROM reached JOIN members ON members.node = reached.v GROUP BY u)
SELECT docs.doc_id, coalesce(len(shingled.s), 0) AS n_shingles,
  CASE WHEN shingled.row_id IS NULL THEN docs.doc_id ELSE least.component_id END AS component_id,
  shingled.row_id IS NULL OR docs.doc_id IS NOT DISTINCT FROM least.component_id AS kept
FROM docs LEFT JOIN shingled USING (row_id) LEFT JOIN sets ON sets.s = list_sort(shingled.s) LEFT JOIN least USING (node)
"""


SQL["op13_collocations"] = r"""
WITH texts AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, 'und') AS lang,
    regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]') AS cut
  FROM documents WHERE text IS NOT NULL
),
pieces AS (SELECT lang, regexp_extract_all(unnest(cut), '[^ \t]+') AS w FROM texts),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
phrases AS (
  SELECT lang, 1 AS k, w[i] AS phrase, count(*) AS n FROM places GROUP BY ALL
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1], count(*) FROM places WHERE i < len(w) GROUP BY ALL
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2], count(*) FROM places WHERE i + 1 < len(w) GROUP BY ALL
),
totals AS (SELECT lang, sum(n) AS n FROM phrases WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM phrases WHERE k > 1 AND n >= 10),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.w, s.k1, f.n AS l, g.n AS r, (c.a::HUGEINT * c.a * 1000000) // (f.n::HUGEINT * g.n) AS score
  FROM candidates c JOIN (VALUES (1), (2)) s(k1) ON s.k1 < c.k
  JOIN phrases f ON f.lang = c.lang AND f.k = s.k1 AND f.phrase = array_to_string(c.w[1:s.k1], ' ')
  JOIN phrases g ON g.lang = c.lang AND g.k = c.k - s.k1 AND g.phrase = array_to_string(c.w[s.k1 + 1:], ' ')
),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k1) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS within FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM candidates WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM candidates WHERE k = 3
  ) GROUP BY ALL
),
ranked AS (
  SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank, c.phrase, a, l, r, score
  FROM weakest c LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase AND c.k = 2
  WHERE i.within IS NULL OR 100 * i.within < 50 * a
)
SELECT lang, rank, phrase, a, l, r, totals.n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
