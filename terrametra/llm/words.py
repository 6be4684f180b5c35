"""Words of a text as bytes: what lies between the ASCII blanks 0x20 and 0x09 to 0x0D."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.types import DataType, StructField, StructType

BLOCK = 1 << 20
BLANKS = b" \t\n\x0b\x0c\r"
# Rows that Spark hands to Python at a time.
ROWS_PER_BATCH = 512
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def word_blocks(data: bytes, block: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of ``data`` in order, in lists that cover about ``block`` bytes each; no word is cut."""
    if len(data) <= block:
        yield data.split()
        return
    at = 0
    while at < len(data):
        end = min(len(data), at + block)
        while end < len(data) and data[end] not in BLANKS:
            end += 1
        yield data[at:end].split()
        at = end


def slices(batches, rows: int = 512) -> Iterator:
    """Arrow batches in slices of at most ``rows`` rows, so that what Python makes of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def small_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """Set the session to hand at most ``rows`` rows to Python at a time; a smaller setting stays.

    Whole texts make batches of the usual 10,000 rows large, once in the executor's buffers and once in each worker.
    """
    if not 0 < int(spark.conf.get(BATCH_KEY)) <= rows:
        spark.conf.set(BATCH_KEY, rows)


def row_schema(key: DataType, rest: str) -> StructType:
    """The schema of ``id`` (of any type) and the columns of ``rest``."""
    return StructType([StructField("id", key), *StructType.fromDDL(rest).fields])
