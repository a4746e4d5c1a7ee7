"""Bar sources: mapped CSV, JSON lines, partitioned Parquet, and range scans."""

from __future__ import annotations

import csv
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks import schemas as S

CORRUPT = "_corrupt"


def reject_first(*checks: tuple[object, str]) -> None:
    """Raise for the first check that holds."""
    for wrong, message in checks:
        if wrong:
            raise ValueError(message)


@dataclass(frozen=True)
class CsvMapping:
    """Which file header feeds which canonical field; ``defaults`` are constants."""

    provider: str
    columns: Mapping[str, str]
    defaults: Mapping[str, str] = field(default_factory=dict)
    delimiter: str = ","
    encoding: str = "utf-8"
    timestamp_format: str | None = None

    def __post_init__(self) -> None:
        sources = [*self.columns, *self.defaults]
        left_out = [f for f in S.REQUIRED_BAR_FIELDS if f not in sources]
        strange = sorted({f for f in sources if f not in S.BARS.fieldNames()})
        twice = sorted({f for f in sources if sources.count(f) > 1})
        reject_first(
            (self.provider == "", "a mapping names its provider"),
            (len(self.delimiter) != 1, f"cells are separated by one character, not {self.delimiter!r}"),
            (strange, f"bars have no fields {strange}"),
            (twice, f"a column and a constant both feed {twice}"),
            (left_out, f"nothing feeds {left_out}"),
        )


def csv_header(spark: SparkSession, path: str, mapping: CsvMapping) -> list[str]:
    """The first line of one file; the scan compares the header of every file of the path to it."""
    first = spark.read.option("encoding", mapping.encoding).text(path).limit(1).collect()
    line = (first[0][0] or "").lstrip("\ufeff") if first else ""
    header = next(csv.reader([line], delimiter=mapping.delimiter), [])
    wanted = sorted(set(mapping.columns.values()).difference(header))
    reject_first(
        (not all(header) or not header, f"a header needs a name in every cell: {line!r}"),
        (len(set(header)) < len(header), f"a header names a column twice: {line!r}"),
        (wanted, f"the file has no columns {wanted}"),
    )
    return header


def scan_csv(spark: SparkSession, path: str, mapping: CsvMapping) -> DataFrame:
    """Raw canonical text cells, plus ``row_id``, ``source_file`` and ``bad_structure``.

    Lines with a wrong number of cells or stray quotes are kept and flagged, not dropped.
    """
    header = csv_header(spark, path, mapping)
    fields = [T.StructField(h, T.StringType()) for h in header]
    schema = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", mapping.delimiter)
        .option("encoding", mapping.encoding)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("columnPruning", False)
        # A file whose header differs stops the scan; its cells would land in wrong columns.
        .option("enforceSchema", False)
        .csv(path)
    )
    quoted = F.lit(False)
    for h in header:
        quoted = quoted | F.coalesce(F.col(f"`{h}`").startswith('"'), F.lit(False))
    cells = {f: F.col(f"`{h}`") for f, h in mapping.columns.items()}
    cells |= {f: F.lit(str(v)) for f, v in mapping.defaults.items()}
    return rows.select(
        *[value.alias(name) for name, value in cells.items()],
        F.monotonically_increasing_id().alias("row_id"),
        F.input_file_name().alias("source_file"),
        (F.col(CORRUPT).isNotNull() | quoted).alias("bad_structure"),
    )


def scan_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Normalised JSON lines; malformed lines keep their text in ``malformed``."""
    schema = T.StructType([*S.BARS.fields, T.StructField("malformed", T.StringType())])
    return (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "malformed")
        .json(path)
    )


def partition_columns() -> dict[str, Column]:
    return {"year": F.year("ts"), "month": F.month("ts")}


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """The partitioned bar table; the nested contract is stored as JSON text."""
    rows = spark.read.parquet(path)
    if "contract" in rows.columns:
        rows = rows.withColumn("contract", F.from_json("contract", S.CONTRACTS))
    return rows


def bars_between(
    bars: DataFrame, symbol: str, start: str, end: str, *, closed_end: bool = False
) -> DataFrame:
    """One symbol, ``[start, end)``; also prunes the year/month partitions when present."""
    first, last = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    upper = F.col("ts") <= last if closed_end else F.col("ts") < last
    rows = bars.filter((F.col("symbol") == symbol) & (F.col("ts") >= first) & upper)
    if "year" in bars.columns:
        rows = rows.filter((F.col("year") >= F.year(first)) & (F.col("year") <= F.year(last)))
    return rows


def test_window(bars: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Tag bars as ``warmup`` (before start) or ``test`` (``[start, end]``); drop the rest."""
    ts = F.col("ts")
    phase = F.lit("test")
    if start is not None:
        phase = F.when(ts < F.lit(start).cast("timestamp"), "warmup").otherwise(phase)
    rows = bars if end is None else bars.filter(ts <= F.lit(end).cast("timestamp"))
    return rows.withColumn("phase", phase)


test_window.__test__ = False  # not a pytest case


def sorted_bars(bars: DataFrame) -> DataFrame:
    return bars.orderBy("ts", "instrument_id")


def inspect(rows: DataFrame, limit: int = 5) -> DataFrame:
    if not 1 <= limit <= 5:
        raise ValueError("inspect shows one to five rows")
    return rows.limit(limit)


def research_bars(bars: DataFrame, provider: str, version: str, synthetic: bool) -> DataFrame:
    """Float projection with lineage. An expiry date is no instant, so expiry stays null."""
    double = lambda n: F.col(n).cast("double").alias(n)
    return bars.select(
        "instrument_id",
        "ts",
        *[double(n) for n in ("close", "high", "low", "volume", "open_interest", "strike")],
        F.lit(None).cast("double").alias("underlying_price"),
        F.lit(None).cast("timestamp").alias("expiry"),
        F.lit(provider).alias("provenance"),
        F.lit(version).alias("dataset_version"),
        F.lit(synthetic).alias("synthetic"),
    )
