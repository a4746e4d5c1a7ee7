"""Starting streams: RocksDB state, checkpoints in the shared folder, append sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tapeworks.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def table_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1000
) -> DataFrame:
    """A folder of Parquet files as a stream; the cap bounds the work of one micro-batch."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Process everything available into a Parquet table and return it."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", f"{path}-checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def append_batches(
    stream: DataFrame, path: str, split: Callable[[DataFrame], dict[str, DataFrame]]
) -> None:
    """Append several event tables per micro-batch.

    Each batch owns its ``batch`` folder, so a batch that is retried replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for table, rows in split(batch).items():
                rows.write.mode("overwrite").parquet(f"{path}/{table}/batch={number}")
        finally:
            batch.unpersist()

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
