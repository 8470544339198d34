"""Shared parts of the text operators: ordered prefix sums, connected components, word splitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trafficlens.llm.worker_memory import tidy
from trafficlens.session import prepare, scratch_path

if TYPE_CHECKING:  # not every worker that needs this module needs pandas in its memory
    import pandas as pd

PART, ROW = "__part", "__row"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def saved(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: computed once, and kept when executors are lost."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def located(docs: DataFrame, label: str, file_col: str = "__in_file", row_col: str = "__in_row") -> DataFrame:
    """The rows with the file and place they stand in, which tell all of them apart, repeated ones too.

    Rows read from files have this at hand; others are written first.
    """

    def with_spot(frame: DataFrame) -> DataFrame:
        spot = frame.metadataColumn("_metadata")
        return frame.select("*", spot.getField("file_path").alias(file_col), spot.getField("row_index").alias(row_col))

    try:
        return with_spot(docs)
    except AnalysisException:  # no rows of files
        return with_spot(saved(docs, label))


def with_made(
    rows: DataFrame,
    needs: Sequence[str],
    start: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    made: str,
    drop: Sequence[str] = (),
    keeps: str | None = None,
) -> DataFrame:
    """Add the columns ``made`` (names and types), computed in Python from the columns ``needs``; those of ``drop`` go.

    ``start`` is called once per task and gives the function from a batch of ``needs`` to the new columns. All other
    columns pass by as they are: an identifier beyond 2**53 next to a null one would be rounded on its way through pandas.
    ``keeps`` is what the worker may go on holding (:func:`tidy`).
    """
    kept = [f for f in rows.schema if f.name not in drop]
    fresh = T.StructType.fromDDL(made)
    types = to_arrow_schema(fresh).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in batches:
            out = make(batch.select(list(needs)).to_pandas())
            columns = [pa.array(out[f.name], kind, from_pandas=True) for f, kind in zip(fresh, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + columns, names=[f.name for f in [*kept, *fresh]])

    return rows.mapInArrow(tidy(run, keeps), T.StructType([*kept, *fresh]))


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table. They come as Arrow columns: plain rows would start workers of their own on every executor."""
    fields = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(arrow.types)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), fields)


def in_order(df: DataFrame, order: Sequence[str | Column], label: str) -> DataFrame:
    """The rows dealt by ranges of ``order`` and written, with ``__part`` and ``__row``: their order as two numbers.

    Rows equal in all of ``order`` stay next to each other. Saving pins the sampled range bounds.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = dealt.withColumns({PART: F.spark_partition_id(), ROW: F.monotonically_increasing_id()})
    return saved(numbered, label)


def with_prefix(ordered: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Add, to a frame of :func:`in_order`, sums over all rows before each row (``sums``: output name to summand).

    Partition totals meet in one task, a row per partition; rows only meet those of their own partition.
    """
    totals = ordered.groupBy(PART).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(PART, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums])
    inside = Window.partitionBy(PART).orderBy(ROW).rowsBetween(Window.unboundedPreceding, -1)
    own = {n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}
    summed = ordered.withColumns(own).join(F.broadcast(bases), on=PART)
    return summed.withColumns({n: F.col(n) + F.col(f"__b_{n}") for n in sums}).drop(*[f"__b_{n}" for n in sums])


def components(edges: DataFrame, label: str, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (long): ``(id, root)`` with the smallest id of each component.

    Each round gives every node the least label among its neighbours, then jumps to that label's label, so a path of
    length n takes about log n rounds. Each round is written, nothing but a count of changes reaches the driver.
    """
    both = saved(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a != b").distinct(), f"{label}-edges")
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("root")), f"{label}-labels")
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("step"))
        jump = labels.select(F.col("id").alias("step"), F.col("root").alias("far"))
        moved = lower.join(jump, "step", "left").select("id", "old", F.least("step", F.coalesce("far", "step")).alias("root"))
        moved = saved(moved, f"{label}-labels")
        labels = moved.select("id", "root")
        if moved.where("root != old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle within {rounds} rounds")


def hold_out(doc_id: str, parts: int, part: int) -> Column:
    """True for the rows whose crc32 of the id as text falls on ``part`` of ``parts``."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == part
