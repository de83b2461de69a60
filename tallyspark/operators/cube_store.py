"""A maintained cube: the partial cube of each input file is kept, and only what changed is computed again.

A store is a folder with three parts:

* ``parts/file_id=.../``: the cube of one input file. The id covers the file's path, length and time of change,
  so a rewritten file gets a new part;
* ``cube/month=.../``: the sum of all live parts, one folder a month;
* ``manifest.json``: the live parts.

``update`` compares the input folder with the manifest, scans only new files, and rewrites only the months that
their parts or the parts of vanished files touch. Parts and months are overwritten as whole folders and the
manifest comes last, so an update that was cut off is simply done again by the next one.

The cube's size is bounded by months x channels x categories; the queries of ``operators.dashboard`` read it with
their months pruned to folders, and no plan touches the facts.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.calendar import parsed_date
from tallyspark.operators.checked import write_text

KEYS = ["month", "location", "category"]
MEASURES = ["rows", "valid", "quantity_valid", "sales", "units", "last_date"]
_MEASURE_TYPES = "rows long, valid long, quantity_valid long, sales decimal(38,6), units double, last_date date"
_CUBE_SCHEMA = f"location string, category string, {_MEASURE_TYPES}, month string"
_PART_SCHEMA = f"month string, location string, category string, {_MEASURE_TYPES}, file_id string"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def input_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """Id -> path of every data file under ``folder`` (one line of metadata a file)."""
    fs, p = _path(spark, folder)
    found, it = {}, fs.listFiles(p, True)
    while it.hasNext():
        f = it.next()
        path = f.getPath().toString()
        if not f.getPath().getName().startswith(("_", ".")):
            found[hashlib.sha1(f"{path}|{f.getLen()}|{f.getModificationTime()}".encode()).hexdigest()[:20]] = path
    return found


def _manifest(spark: SparkSession, store: str) -> list[str]:
    fs, p = _path(spark, f"{store}/manifest.json")
    if not fs.exists(p):
        return []
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["files"]
    finally:
        stream.close()


def _partial(clean: DataFrame) -> list:
    """Aggregates of fact rows."""
    return [F.count(F.lit(1)).alias("rows"), F.count("total_spent").alias("valid"), F.count("quantity").alias("quantity_valid"),
            F.coalesce(F.sum(F.col("total_spent").cast("decimal(28,6)")), F.lit(0)).cast("decimal(38,6)").alias("sales"),
            F.coalesce(F.sum(F.col("quantity").cast("double")), F.lit(0.0)).alias("units"), F.max(parsed_date(F.col("transaction_date"))).alias("last_date")]


def _merged() -> list:
    """The same aggregates from parts."""
    add = lambda c, t: F.sum(c).cast(t).alias(c)
    return [add("rows", "long"), add("valid", "long"), add("quantity_valid", "long"), add("sales", "decimal(38,6)"), add("units", "double"), F.max("last_date").alias("last_date")]


def _months(spark: SparkSession, store: str, ids: list[str]) -> list[str | None]:
    """The months that some parts touch; a calendar's worth of values."""
    if not ids:
        return []
    parts = spark.read.schema(_PART_SCHEMA).parquet(f"{store}/parts").where(F.col("file_id").isin(ids))
    return [r["month"] for r in parts.select("month").distinct().collect()]


def update(spark: SparkSession, folder: str, store: str) -> list[str | None]:
    """Bring the store up to date with the cleaned Parquet files under ``folder``; returns the months that were written."""
    store = store.rstrip("/")
    files, live = input_files(spark, folder), set(_manifest(spark, store))
    new, gone = sorted(set(files) - live), sorted(live - set(files))
    if not new and not gone:
        return []
    if new:
        ids = {path: i for i, path in files.items()}
        rows = spark.read.option("basePath", folder).parquet(*[files[i] for i in new])
        names = spark.createDataFrame(sorted((p, ids[p]) for p in (files[i] for i in new)), "path string, file_id string")
        part = rows.groupBy(F.col("_metadata.file_path").alias("path"), F.substring("transaction_date", 1, 7).alias("month"), "location", "category").agg(*_partial(rows))
        # The reader writes local paths with three slashes, the listing with one.
        same = lambda c: F.regexp_replace(F.url_decode(F.regexp_replace(c, r"\+", "%2B")), "^file:/+", "file:/")
        part = part.withColumn("path", same(F.col("path"))).join(names.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/")), "path").drop("path")
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_id").parquet(f"{store}/parts")
    months = sorted(set(_months(spark, store, new)) | set(_months(spark, store, gone)), key=lambda m: (m is not None, m))
    touched = F.col("month").isin([m for m in months if m is not None])
    if None in months:
        touched = touched | F.col("month").isNull()
    parts = spark.read.schema(_PART_SCHEMA).parquet(f"{store}/parts").where(F.col("file_id").isin(sorted(files)) & touched)
    cube = parts.groupBy(*KEYS).agg(*_merged())
    # One folder a month, one file in it: a month holds at most channels x categories rows.
    cube.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{store}/cube")
    left = {r["month"] for r in cube.select("month").distinct().collect()}
    for m in months:
        if m not in left:
            fs, p = _path(spark, f"{store}/cube/month={m if m is not None else '__HIVE_DEFAULT_PARTITION__'}")
            fs.delete(p, True)
    write_text(spark, f"{store}/manifest.json", json.dumps({"files": sorted(files)}))
    for i in gone:
        fs, p = _path(spark, f"{store}/parts/file_id={i}")
        fs.delete(p, True)
    return months


def read_cube(spark: SparkSession, store: str) -> DataFrame:
    """The cube in the shape of ``dashboard.build_cube``."""
    cube = spark.read.schema(_CUBE_SCHEMA).parquet(f"{store.rstrip('/')}/cube")
    return cube.select("month", "location", "category", "rows", "valid", "quantity_valid", F.col("sales").cast("double").alias("sales"), "units")


def last_date_info(spark: SparkSession, store: str) -> DataFrame:
    """``dashboard.last_date_info`` from the cube: last date, its month, and whether that month is complete."""
    cube = spark.read.schema(_CUBE_SCHEMA).parquet(f"{store.rstrip('/')}/cube")
    return cube.agg(F.max("last_date").alias("last_date")).select("last_date", F.date_format("last_date", "yyyy-MM").alias("last_month"),
                                                                  (F.last_day("last_date") == F.col("last_date")).alias("last_month_complete"))
