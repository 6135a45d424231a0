"""What several corpus operators share: row batches, word rules, and the shared scratch tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, scratch_folder, settled  # noqa: F401

#: Words are runs of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def spread(table: DataFrame) -> DataFrame:
    """The table, dealt out anew if its files are too few to keep the cores busy: a file of one row group is one task.

    The rows are the same either way; a table of many files is read where it lies.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() > 4 * cores or len(table.inputFiles()) >= cores:
        return table
    return table.repartition(4 * cores)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def texts_of(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, so that no other column's name can clash; a null text is empty."""
    return df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def by_bytes(batch: pa.RecordBatch, most_bytes: int, most: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Rows in a row, so many at most, whose texts and bytes have so many bytes together, or one row with more."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        fitting = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, "right"))
        upto = min(at + most, max(at + 1, fitting))
        yield batch.slice(at, upto - at)
        at = upto


def rows_of(batch: pa.RecordBatch, most: int = 256, most_bytes: int = 4_000_000) -> Iterator[list[tuple]]:
    """The rows of an Arrow batch as Python tuples, a bounded number and size at a time."""
    for part in by_bytes(batch, most_bytes, most):
        yield list(zip(*(column.to_pylist() for column in part.columns), strict=True))


def words_of(text: Column) -> Column:
    """The words of a text, unchanged; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))
