"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of the contracts, for Java's regular expressions and for ``trim``.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def over_cores(scan: DataFrame, key: str) -> DataFrame:
    """Give each core a share of a scan that has fewer splits than there are cores; a larger scan stays as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(2 * cores, key)


def fold_of(key: str, parts: int) -> Column:
    """crc32 of the key as text modulo ``parts``; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else untouched; pure ASCII takes the faster function, which then does the same."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def share_filter(key: str, share: Column, salt: int = 0) -> Column:
    """True for about ``share`` of the keys, the same ones in each run."""
    return F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(1_000_000)) < share * 1_000_000


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice's texts have ``most_bytes`` or are one row: bounds what a task holds at once."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        ends = np.cumsum(text_lengths(batch.column(at)))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rows + 1) and UTF-8 bytes of a string column as views; null rows are empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return ends - ends[0], np.zeros(0, np.uint8)
    return ends - ends[0], np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]


def text_lengths(column: pa.Array) -> np.ndarray:
    return np.diff(text_buffers(column)[0]) if len(column) else np.zeros(0, np.int64)
