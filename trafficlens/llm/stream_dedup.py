"""Exact deduplication as a stateful stream.

The stream reads a folder of Parquet files and keeps, for every text digest ever seen, one state row: how often it
came, and of its best document the stable identifier and the locator of the content (file and row in the file). The
state lives on disk in the RocksDB state store under the checkpoint folder, has no watermark and never expires; a
later call with the same checkpoint reads only new files, whatever their times, and continues; rows without state are an error. The state is read back as a table, so no
sink has to hold every update. Digests that came more than once are hits: their documents' full bytes are then
compared, and a digest shared by different texts is split by its texts.

Defined results: a null text counts as empty; of equal texts the largest identifier stays (a null one is smaller than
all, ties go to the larger locator), so exactly one row per text is kept even when identifiers repeat; extra columns
are ignored; an empty folder gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm.common import saved
from trafficlens.session import scratch_path, state_settings

STORE = {
    # no space set aside in advance: there is a store for each shuffle partition, and many of them are small
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
# A file may arrive with an old time; the source passes over files older than this against the newest it has seen.
MAX_FILE_AGE = "36500d"
# Where few rows have a digest that came more than once, a Bloom filter of those digests stops the others before the shuffle.
FEW_HITS = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1t",
}
DIGEST = "__digest"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """The text as it is compared: null as empty, A-Z in lower case, nothing else changed.

    Without letters beyond ASCII ``lower`` does just that, and takes a fraction of the time.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def located(df: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Digest, locator and normalised text of every row of a Parquet read, batch or stream."""
    spot = F.struct(
        F.col(id_col).alias("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    text = normalised(F.col(text_col))
    return df.select(digest(text).alias("digest"), spot.alias("spot"), text.alias("text"))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with other settings for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def update_state(
    spark: SparkSession, path: str, checkpoint: str, id_col: str, text_col: str, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """Run the stream over what is new in ``path`` and return the whole state: (digest, keeper, group_size)."""
    # a path that ends in a pattern may be a folder or one file; both then have the same form
    path = path.rstrip("/")
    pattern = f"{path[:-1]}[{path[-1]}]"
    with settings(spark, {**state_settings(spark, checkpoint), **STORE}):
        arriving = spark.readStream.option("maxFileAge", MAX_FILE_AGE).schema(spark.read.parquet(path).schema).parquet(pattern)
        seen = located(arriving, id_col, text_col, digest).groupBy("digest")
        query = (
            seen.agg(F.max("spot").alias("keeper"), F.count(F.lit(1)).alias("n"))
            .writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
        rows = state.select(
            F.col("key.digest").alias("digest"), F.col("value.max").alias("keeper"), F.col("value.count").alias("group_size")
        )
        return saved(rows, "dedup-state")


def dedup(
    spark: SparkSession,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    checkpoint: str | None = None,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per row of the files: (spot, digest, keeper, group_size, kept).

    ``spot`` and ``keeper`` are locators (doc_id, file, row) of the row and of the row that stays.
    """
    checkpoint = checkpoint or scratch_path(spark, "dedup-checkpoint")
    state = update_state(spark, path, checkpoint, id_col, text_col, digest)
    rows = located(spark.read.parquet(path), id_col, text_col, digest)
    # A digest with a third of all rows: the planner splits the large side of this join.
    verdict = saved(rows.select("digest", "spot").join(state, "digest"), "dedup-rows")
    read, joined = spark.read.parquet(path).count(), verdict.count()
    if joined < read:
        raise ValueError(f"{read - joined} of {read} rows in {path} have no state in {checkpoint}: the stream has not read their files")

    # Full bytes of hits. Fetching by locator spreads a large group over all tasks; grouping by digest and text
    # then leaves one row per text and task before the shuffle.
    hits = verdict.where("group_size > 1").select("digest", F.col("spot.file").alias("file"), F.col("spot.row").alias("row"))
    content = rows.select("digest", "text", "spot", F.col("spot.file").alias("file"), F.col("spot.row").alias("row"))
    texts = content.join(hits, ["digest", "file", "row"]).select("digest", "text").distinct()
    with settings(spark, FEW_HITS):
        collided = saved(
            texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "dedup-collided"
        )
    if not collided.isEmpty():
        shared = content.join(collided, "digest", "left_semi")
        per_text = shared.groupBy("digest", "text").agg(F.max("spot").alias("keeper"), F.count(F.lit(1)).alias("group_size"))
        split = shared.select("digest", "text", "spot").join(per_text, ["digest", "text"]).select("digest", "spot", "keeper", "group_size")
        verdict = verdict.join(collided, "digest", "left_anti").unionByName(split)
    return verdict.withColumn("kept", F.col("spot").eqNullSafe(F.col("keeper")))


def dedup_frame(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, all columns: ``docs`` is landed in the shared folder and streamed from there.

    Digests are landed too, so that only the comparison of hits and the last step read texts again.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "dedup-landing")
    docs.withColumn(DIGEST, sha256(normalised(F.col(text_col)))).write.parquet(path)
    keep = dedup(spark, path, id_col, text_col, digest=lambda text: F.col(DIGEST)).where("kept").select(F.col("spot.file").alias("__file"), F.col("spot.row").alias("__row"))
    landed = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return landed.join(keep, ["__file", "__row"], "left_semi").select(*docs.columns)
