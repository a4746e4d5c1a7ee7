"""What the corpus operators share: the session, the tables, Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.session import tune

#: Rows and bytes that one Arrow batch may bring to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """The session with results pinned and Arrow batches kept small, as single texts may be long."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_key(text: str | Column = "text") -> Column:
    """Tells apart rows that share a doc_id; rows equal in both are the same document."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def parts(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch cut so that the text of each piece is about ``most`` bytes, or one row."""
    start, held = 0, 0
    for i, size in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if held and held + (size or 0) > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()
