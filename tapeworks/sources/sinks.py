"""Sinks: partitioned bars, JSON lines, write-once artifacts, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks import schemas as S
from tapeworks.session import staged
from tapeworks.sources.bars import partition_columns


def write_bars(bars: DataFrame, path: str) -> None:
    """Write once, zstd, by asset_class/year/month. The rebalance hint lets adaptive execution
    split a large month over several tasks and join small ones."""
    columns = {
        n: F.to_json(n) if n == "contract" else F.col(n)
        for n in S.BARS.fieldNames()
        if n in bars.columns
    }
    rows = bars.select(
        *[c.alias(n) for n, c in columns.items()],
        *[c for c in ("instrument_id",) if c in bars.columns],
    ).withColumns(partition_columns())
    (
        rows.hint("rebalance", "asset_class", "year", "month")
        .sortWithinPartitions("asset_class", "year", "month", "symbol", "ts")
        .write.mode("errorifexists")
        .partitionBy("asset_class", "year", "month")
        .option("compression", "zstd")
        .parquet(path)
    )


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


def write_once(rows: DataFrame, path: str) -> None:
    """Artifacts are never overwritten."""
    rows.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def append_events(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def latest_per_key(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Current row of every key, by the highest version; ``max_by`` combines map-side."""
    values = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), version).alias("_row"))
        .select(*keys, "_row.*")
    )


# --- manifests ---------------------------------------------------------------------------


def _text(column: str, frame: DataFrame) -> Column:
    """A cell as text with its length in front, so that no two rows of cells read alike; ``-`` for null."""
    kind = frame.schema[column].dataType.typeName()
    value = F.to_json(column) if kind in ("struct", "array", "map") else F.col(column).cast("string")
    return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def row_digest(rows: DataFrame, columns: Sequence[str]) -> Column:
    return F.sha2(F.concat(*[_text(c, rows) for c in columns]), 256)


def _sums() -> list[Column]:
    """Count and order-free sums modulo 2^64 of two 60-bit slices of the row digests ``d``. A sum of
    decimals of 28 digits holds 1e19 rows."""

    def part(start: int) -> Column:
        number = F.conv(F.substring("d", start, 15), 16, 10).cast("decimal(28,0)")
        whole = F.coalesce(F.sum(number), F.lit(0).cast("decimal(38,0)"))
        return (whole % F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(20,0)")

    return [F.count(F.lit(1)).alias("n"), part(1).alias("a"), part(16).alias("b")]


def fingerprint(bars: DataFrame, mapping_json: str, synthetic: bool) -> DataFrame:
    """Order-free content identity: counts and sums of row digests, hashed with the schema version, the
    mapping and the flag."""
    combined = bars.select(row_digest(bars, sorted(bars.columns)).alias("d")).agg(*_sums())
    mapping = F.sha2(F.lit(mapping_json), 256)
    data = F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in "nab"]), 256)
    return combined.select(
        F.col("n").alias("row_count"),
        data.alias("data_sha256"),
        mapping.alias("mapping_sha256"),
        F.sha2(
            F.concat_ws(":", F.lit(S.SCHEMA_VERSION), data, mapping, F.lit(str(synthetic))), 256
        ).alias("import_id"),
    )


#: The leaves of a stored manifest: one row for each of these.
PARTITION = ["asset_class", "year", "month"]
_FILES = ["files", "bytes", "newest"]


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("*", F.col("_metadata").alias("_file"))


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """Per partition: number, size and newest time of its files. No data column is read."""
    each = _stored(spark, path).groupBy(*PARTITION, F.col("_file.file_path").alias("file")).agg(
        F.max("_file.file_size").alias("bytes"), F.max("_file.file_modification_time").alias("newest")
    )
    return each.groupBy(*PARTITION).agg(
        F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.max("newest").alias("newest")
    )


def partition_digests(rows: DataFrame) -> DataFrame:
    """Per partition: row count and digest sums. Sums of partitions add up to those of the whole import."""
    columns = sorted(c for c in rows.columns if c not in (*PARTITION, "_file"))
    return rows.select(*PARTITION, row_digest(rows, columns).alias("d")).groupBy(*PARTITION).agg(*_sums())


def store_manifest(spark: SparkSession, path: str, manifest_path: str) -> None:
    """Write the leaves of the import at ``path``: file facts and digests of each partition."""
    leaves = file_facts(spark, path).join(partition_digests(_stored(spark, path)), PARTITION)
    write_once(leaves, manifest_path)


def verify_import(spark: SparkSession, path: str, manifest_path: str, *, full: bool = False) -> DataFrame:
    """One row (partition, field, stored, found) for what differs from the stored manifest.

    Only partitions whose files have changed since are read again; with ``full`` all are. Fields: n, a, b
    (row count and digest sums), or ``partition`` for one that is missing or was not there.
    """
    kept = spark.read.parquet(manifest_path)
    now = file_facts(spark, path)
    both = kept.select(*PARTITION, F.struct(*_FILES).alias("then")).join(
        now.select(*PARTITION, F.struct(*_FILES).alias("now")), PARTITION, "full"
    )
    suspect = both if full else both.filter(~F.col("then").eqNullSafe(F.col("now")))
    suspect = staged(suspect.select(*PARTITION, F.col("then").isNull().alias("new"), F.col("now").isNull().alias("gone")), "suspects")
    again = partition_digests(_stored(spark, path).join(suspect.filter("NOT gone").select(*PARTITION), PARTITION, "left_semi"))
    values = ["n", "a", "b"]
    text = lambda df, name: df.select(*PARTITION, F.struct(*[F.col(c).cast("string").alias(c) for c in values]).alias(name))
    held = suspect.join(text(kept, "stored"), PARTITION, "left").join(text(again, "found"), PARTITION, "left")
    presence = F.struct(
        F.lit("partition").alias("field"),
        F.when(~F.col("new"), "present").alias("stored"), F.when(~F.col("gone"), "present").alias("found"),
    )
    fields = [
        F.struct(F.lit(c).alias("field"), F.col(f"stored.{c}").alias("stored"), F.col(f"found.{c}").alias("found"))
        for c in values
    ]
    told = F.when(F.col("new") | F.col("gone"), F.array(presence)).otherwise(F.array(*fields))
    rows = held.select(*PARTITION, F.explode(told).alias("x")).select(*PARTITION, "x.*")
    return rows.filter(~F.col("stored").eqNullSafe(F.col("found")))


def import_instruments(bars: DataFrame) -> DataFrame:
    """Distinct instruments, kept as a table because their number grows with the data."""
    return bars.select("instrument_id").distinct()


def import_statistics(bars: DataFrame) -> DataFrame:
    """Counts, time range and an order-free digest of the instruments, from one row each."""
    per = bars.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )
    name_part = F.conv(F.substring(F.sha2("instrument_id", 256), 1, 15), 16, 10)
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.min("first").alias("first_timestamp"),
        F.max("last").alias("last_timestamp"),
        F.count(F.lit(1)).alias("instrument_count"),
        F.coalesce(F.sum(name_part.cast("decimal(28,0)")), F.lit(0))
        .cast("string")
        .alias("instruments_digest"),
    )


def manifest(
    bars: DataFrame, provider: str, source: str, mapping_json: str, synthetic: bool
) -> DataFrame:
    """One provenance row of an import."""
    return import_statistics(bars).join(
        fingerprint(bars, mapping_json, synthetic), "row_count", "full"
    ).select(
        F.lit(S.SCHEMA_VERSION).alias("schema_version"),
        "import_id",
        F.lit(provider).alias("provider"),
        F.lit(source).alias("source_filename"),
        "data_sha256",
        "mapping_sha256",
        "row_count",
        "first_timestamp",
        "last_timestamp",
        "instrument_count",
        "instruments_digest",
        F.lit(synthetic).alias("synthetic"),
        F.lit("passed").alias("validation_status"),
    )


def verify_manifest(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """One row per field that differs; no rows means the import is intact."""
    fields = [c for c in recomputed.columns if c in stored.columns]

    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(
            *[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields]
        )
        return df.select(F.explode(pairs).alias("p")).select("p.*")

    both = long(stored, "stored").join(long(recomputed, "recomputed"), "field", "full")
    return both.filter(~F.col("stored").eqNullSafe(F.col("recomputed")))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
