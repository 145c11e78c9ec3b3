"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprobe.sources.shared import shared_folder

#: Bytes of text that a Python worker expands into wide arrays at once.
CHUNK_BYTES = 2_000_000

_ROWS_KNOWN: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """Only doc_id, text (null counts as empty) and the named columns, whatever else there is."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def fold_of(column: str, folds: int):
    """Remainder of crc32 of the id as text; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % folds


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, end to end, and where each row begins (one entry more)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    column = column.fill_null("") if column.null_count else column
    _, places, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(places, kind)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES):
    """Ranges of rows that hold about `size` bytes; a longer text is a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last
