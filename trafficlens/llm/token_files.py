"""Token ids in Parquet list columns, in document order, with controlled encoding, row groups and page indexes.

Documents are dealt by ranges of their id, encoded where they land, and written sorted, a file per range. The token
column is a list of 32-bit integers, with a dictionary (ids repeat) or as binary-packed deltas; row groups and pages
have set sizes and the page index holds the id range of each page, so that reading some documents skips pages and
reading only counts never touches the tokens.

Defined results: a null text is empty and still has its end id; a null id sorts first; rows of one id are ordered by
content hash; extra columns are ignored; an empty table gives files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm.common import PART, ROW, saved, with_prefix
from trafficlens.llm.tokens import default_path, encoded
from trafficlens.llm.worker_memory import tidy

SCHEMA = "doc_id long, n_tokens long, tokens array<int>, part int, row long"


def file_options(encoding: str = "dictionary", row_group_mb: int = 32, page_kb: int = 256, page_rows: int = 1000) -> dict[str, str]:
    """Writer options; ``encoding`` of the token column is ``dictionary`` or ``delta``."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding {encoding!r} is neither dictionary nor delta")
    delta = encoding == "delta"
    return {
        "parquet.block.size": str(row_group_mb << 20),
        "parquet.page.size": str(page_kb << 10),
        "parquet.page.row.count.limit": str(page_rows),
        "parquet.dictionary.page.size": str(1 << 20),
        "parquet.enable.dictionary": str(not delta).lower(),
        "parquet.writer.version": "PARQUET_2_0" if delta else "PARQUET_1_0",
        "compression": "zstd",
    }


def write_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, **layout
) -> None:
    """Encode every document and write the files."""
    vocabulary = tokenizer or default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids in encoded(batches, vocabulary, "text", end_id):
            counts = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
            lists = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), lists], ["doc_id", "n_tokens", "tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    made = ordered.mapInArrow(tidy(encode, "encoder"), "doc_id long, n_tokens long, tokens array<int>")
    numbered = made.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()})
    numbered.write.options(**file_options(**layout)).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files as a table; filters on ``doc_id`` and the choice of columns reach the page index and the scan."""
    return spark.read.schema(SCHEMA).parquet(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, computed from the ids in the files."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            columns = [batch.column("doc_id"), batch.column("part"), batch.column("row")]
            counts = np.diff(offsets).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts), pa.array(crcs, pa.int64())], ["doc_id", PART, ROW, "n_tokens", "ids_crc32"])

    files = read_tokens(spark, path).select("doc_id", "tokens", "part", "row")
    rows = saved(files.mapInArrow(digest, f"doc_id long, {PART} int, {ROW} long, n_tokens long, ids_crc32 long"), "token-index")
    return with_prefix(rows, {"start": F.col("n_tokens")}).select("doc_id", "start", "n_tokens", "ids_crc32")
