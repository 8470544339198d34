"""The table of saved runs: append, list, look up, compare, delete, totals.

Runs live in a parquet table partitioned by ``config_preset``. A run's load, server and cost series are kept as rows of
a second table keyed by the run's id, not as one ever-growing array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

HASH_ROWS = 4096


def load_hash(loads: DataFrame, keys: Sequence[str], order: str = "timestamp", load: str = "load", step_seconds: int = 3600) -> DataFrame:
    """SHA-256 of a run's loads: blocks of rows are hashed first, then the block hashes in order."""
    from trafficlens.operators.scale import chunk_of

    block = chunk_of(F.col(order), step_seconds, HASH_ROWS)
    text = F.transform(F.array_sort(F.collect_list(F.struct(order, load))), lambda r: r[load].cast("string"))
    blocks = loads.groupBy(*keys, block.alias("__b")).agg(F.sha2(F.concat_ws(",", text), 256).alias("__h"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("__b", "__h"))), lambda r: r["__h"])
    return blocks.groupBy(*keys).agg(F.sha2(F.concat_ws(",", whole), 256).alias("data_hash"))


def save_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").partitionBy("config_preset").parquet(path)


DELETED = "_deleted"


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    """The saved runs without the deleted ones. Presets are text, whatever they look like."""
    # the folder names of the partitions would otherwise be typed by their look
    stored = spark.read.schema(StructType([*spark.read.parquet(path).drop("config_preset").schema, StructField("config_preset", StringType())])).parquet(path)
    gone = deleted_runs(spark, path)
    return stored if gone is None else stored.join(gone, "id", "left_anti")


def deleted_runs(spark: SparkSession, path: str) -> DataFrame | None:
    """Identifiers of deleted runs, or None if there are none. The folder's name keeps it out of the table itself."""
    marks = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{DELETED}")
    if not marks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marks):
        return None
    return spark.read.schema("id string").parquet(f"{path}/{DELETED}").distinct()


def get_run(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.where(F.col("id") == run_id)


def list_runs(
    runs: DataFrame, limit: int = 50, offset: int = 0, preset: str | None = None, policy: str | None = None, search: str | None = None
) -> DataFrame:
    """A page of runs, newest first; ``search`` looks for a text in name or description, ignoring case."""
    out = runs
    if preset:
        out = out.where(F.col("config_preset") == preset)
    if policy:
        out = out.where(F.col("policy_type") == policy)
    if search:
        pattern = f"%{search}%"
        out = out.where(F.col("name").ilike(pattern) | F.coalesce(F.col("description").ilike(pattern), F.lit(False)))
    return out.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def delete_run(spark: SparkSession, path: str, run_id: str) -> bool:
    """Mark a run as deleted. Returns whether it was there.

    Nothing stored is rewritten: the mark is one appended row, so no crash and no preset name can lose other runs.
    """
    if load_runs(spark, path).where(F.col("id") == run_id).isEmpty():
        return False
    spark.createDataFrame([(run_id,)], "id string").write.mode("append").parquet(f"{path}/{DELETED}")
    return True


def compare_runs(runs: DataFrame, ids: Sequence[str]) -> DataFrame:
    return runs.where(F.col("id").isin(*ids))


def totals(runs: DataFrame) -> DataFrame:
    """Count, mean cost and mean violation rate; zeros for an empty table."""
    return runs.agg(
        F.count(F.lit(1)).alias("total_results"),
        F.coalesce(F.avg("total_cost"), F.lit(0.0)).alias("avg_cost"),
        F.coalesce(F.avg("sla_violation_rate"), F.lit(0.0)).alias("avg_sla_violation_rate"),
    )


def counts_by(runs: DataFrame, col: str) -> DataFrame:
    return runs.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def newest_per(runs: DataFrame, col: str) -> DataFrame:
    window = Window.partitionBy(col).orderBy(F.desc("created_at"), "id")
    return runs.withColumn("__nth", F.row_number().over(window)).where(F.col("__nth") == 1).drop("__nth")
