"""From raw documents to packed sequences: language, exact copies, near copies, mix, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm import chosen_path, language, mixing, packing, stream_dedup
from trafficlens.llm.common import hold_out, located, saved
from trafficlens.session import prepare

LEAST_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: not those without letters, nor those that no language wins."""
    prepare(spark)
    model = language.train(docs.where(~hold_out("doc_id", 3, 1)))
    judged = language.predict(docs, model, names=("__lang_pred", "__lang_score"))
    return judged.where((F.col("__lang_pred") != "und") & (F.col("__lang_score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest identifier."""
    prepare(spark)
    return stream_dedup.dedup_frame(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more), the document with the smallest identifier."""
    prepare(spark)
    spot = ["__in_file", "__in_row"]
    landed = located(docs, "near-landing")
    classes = chosen_path.similarity_classes(landed, ["doc_id", *spot])
    first = classes.where(F.col("id").eqNullSafe(F.col("class_id"))).select(*[F.col(f"id.{c}").alias(c) for c in spot])
    return landed.join(first, spot, "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents come as often as the mix takes them."""
    prepare(spark)
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: The mix and the packing follow hashes and a least-squares plan that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
