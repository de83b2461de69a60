"""Structured Streaming form of the cleaning rules and the dashboard cube.

The row-local rules (parse, price derivation, arithmetic flag, calendar
parts, missing pattern) are stream-safe as they are. The two whole-table
rules are taken from a static snapshot: the (category, price) -> item map
and the IQR bounds of the cleaned history are static inputs joined to each
micro-batch (stream-static joins; the bounds are one row). The cube is a
stateful aggregation keyed by (month, location, category), emitted in
``update`` mode; with an event-time watermark on the transaction date, state
for months older than the watermark is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import cleaning as C
from tallyspark.schema import CLEAN_COLUMNS, RAW_SCHEMA


def read_raw_stream(spark: SparkSession, path: str, fmt: str = "csv", max_files: int = 1) -> DataFrame:
    """Raw rows arriving as files (all columns text)."""
    reader = spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", max_files)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def clean_stream(raw_stream: DataFrame, history_clean: DataFrame) -> DataFrame:
    """Clean a raw stream with the item map and IQR bounds of a cleaned history table.

    The map comes from history rows whose item and price were both recorded.
    It is a stream-static join; the planner broadcasts the static side (one
    row per (category, price) pair) only when its estimated size is under the
    broadcast threshold.
    """
    parsed = C.parse_raw(raw_stream)
    priced = C.derive_price(parsed)
    recorded = history_clean.where((F.col("price_imputed") == "No") & (F.col("item_imputed") == "No"))
    mapping = C.item_map(recorded.select("category", "item", F.col("price_per_unit").alias("_price_recorded")))
    need = F.col("item").isNull() & F.col("category").isNotNull() & F.col("price_per_unit").isNotNull()
    looked = (priced.withColumn("_pkey", F.when(need, C.price_key(F.col("price_per_unit"))))
                    .join(mapping, ["category", "_pkey"], "left")
                    .withColumn("item_imputed", F.when(need & F.col("_map_item").isNotNull(), "Yes").otherwise("No"))
                    .withColumn("item", F.coalesce(F.col("item"), F.when(need, F.col("_map_item"))))
                    .drop("_pkey", "_map_item"))
    audited = C.add_audit_columns(C.arithmetic_issue(looked))
    bounds = C.iqr_bounds(history_clean)
    return C.flag_outliers(audited, bounds).select(*CLEAN_COLUMNS, "_date")


def cube_stream(clean: DataFrame, watermark: str = "62 days") -> DataFrame:
    """Running cube of a cleaned stream (update mode).

    The month start is the event time; the watermark on it bounds the state:
    months older than the watermark are finalised and evicted.
    """
    m = F.to_timestamp(F.trunc(F.col("_date"), "month"))
    return (clean.withColumn("_m", m).withWatermark("_m", watermark)
                 .groupBy("_m", F.substring("transaction_date", 1, 7).alias("month"), "location", "category")
                 .agg(F.count(F.lit(1)).alias("rows"), F.count("total_spent").alias("valid"),
                      F.count("quantity").alias("quantity_valid"),
                      F.coalesce(F.sum(F.col("total_spent").cast("decimal(28,6)")), F.lit(0)).cast("double").alias("sales"),
                      F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("units"))
                 .drop("_m"))
