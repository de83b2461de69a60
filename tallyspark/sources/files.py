"""File sources and sinks: raw CSV, cleaned Parquet/CSV, JSON reports, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.schema import CLEAN_COLUMNS, DISPLAY_NAMES, RAW_COLUMNS, SOURCE_COLUMNS


def check_source_schema(columns: list[str]) -> None:
    """The raw header must be exactly the eleven source columns, in order."""
    if list(columns) != SOURCE_COLUMNS and list(columns) != RAW_COLUMNS:
        raise ValueError(f"the header does not hold the eleven raw columns in order, but {list(columns)}")


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw CSV scan, every column as text, header checked against the contract.

    The header is read from the file itself (no inference) and compared before
    the data is bound to the all-string schema; blanks stay blank ("" is a
    missing token downstream, so null and "" behave the same).
    """
    header = (spark.read.option("header", True).option("inferSchema", False)
              .option("encoding", "UTF-8").csv(path).columns)
    header = [h.lstrip("﻿") for h in header]
    check_source_schema(header)
    named = T.StructType([T.StructField(h, T.StringType()) for h in header])
    # enforceSchema off: the header of every file is compared with the contract, not only that of the first.
    return (spark.read.schema(named).option("header", True)
            .option("enforceSchema", False).option("emptyValue", "")
            .option("mode", "PERMISSIVE").csv(path).toDF(*RAW_COLUMNS))


def write_raw_csv(df: DataFrame, path: str) -> None:
    """Write a raw table with display-name header (for round-trip tests)."""
    (df.select([F.col(c).alias(DISPLAY_NAMES[c]) for c in RAW_COLUMNS])
       .write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path))


def write_clean(df: DataFrame, path: str, partition_by_month: bool = True) -> None:
    """Cleaned table sink: fixed column order, Parquet, partitioned by year/month.

    Partitioning on the calendar columns lets month-range queries prune files.
    """
    out = df.select(*CLEAN_COLUMNS)
    writer = out.write.mode("overwrite")
    if partition_by_month:
        writer = writer.partitionBy("year", "month")
    writer.parquet(path)


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*CLEAN_COLUMNS)


def content_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table: row count and two bag hashes.

    Each row hashes to two 60-bit numbers (halves of the MD5 of its values); the
    sums are taken in DECIMAL, so they are exact and independent of partitioning.
    Equal bags give equal fingerprints, in any engine.
    """
    row = F.md5(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in df.columns]))
    half = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.agg(F.count(F.lit(1)).alias("rows"), half(1).alias("bag_hash"), half(16).alias("bag_hash_2"))
