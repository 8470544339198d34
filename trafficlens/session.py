"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings that results depend on (all are per-session)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")  # long rows: a batch for Python is bounded in bytes too
    return spark


def local_session(cpus: int | str = "*", app: str = "trafficlens", memory: str = "12g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = prepare(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to executors that do not have it installed. Once per application, before the first Python task."""
    import shutil

    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="spark-")
    zipped = shutil.make_archive(os.path.join(folder, "trafficlens"), "zip", os.path.dirname(root), os.path.basename(root))
    spark.sparkContext.addPyFile(zipped)


_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local master, where driver and executors share one disk, may fall back to a temporary folder. The setting
    is static, so the fallback is kept here and not written back to the session.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    return _FALLBACK.setdefault("dir", tempfile.mkdtemp(prefix="spark-"))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under this application's part of the shared folder."""
    return os.path.join(shared_dir(spark), spark.sparkContext.applicationId, f"{label}-{uuid.uuid4().hex}")


def drop_scratch(spark: SparkSession) -> None:
    """Delete everything this application wrote under the shared folder; call it once its results are saved."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(os.path.join(shared_dir(spark), spark.sparkContext.applicationId))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # a commit writes one file of changes; whole snapshots of a store follow in the background, now and then
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
# The default manager starts processes on a local disk (chmod, readlink) for each file of a checkpoint, out of an executor
# whose memory they share for that moment. Elsewhere the default stays.
LOCAL_FILES = {
    "spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager",
}


def state_settings(spark: SparkSession, checkpoint: str) -> dict[str, str]:
    """Settings for a stream that keeps its state under ``checkpoint``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint)
    local = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() == "file"
    return {**STATE_STORE, **(LOCAL_FILES if local else {})}


def cut_lineage(spark: SparkSession, df, label: str):
    """Write a frame to the shared folder and read it back: one computation, safe when executors are lost."""
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
