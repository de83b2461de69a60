"""Session construction and shared-storage settings."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every session of this library relies on. AQE re-plans joins and
# coalesces shuffle partitions at run time; the broadcast threshold is the
# size check behind every runtime broadcast of a lookup table.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Remove RDD checkpoint files once their DataFrame is garbage-collected.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


# SQL settings applied to any session the library runs on, but only where the
# session still has Spark's own default (a user's explicit choice wins).
# hugeMethodLimit: HotSpot does not JIT-compile methods above 8000 bytecodes,
# so a fused whole-stage method between 8 KB and Spark's 64 KB default runs
# interpreted; at 8000 Spark splits such a stage into per-operator code
# instead (3x faster parsing of the raw table here).
TUNED_SQL_DEFAULTS = {
    "spark.sql.codegen.hugeMethodLimit": ("65535", "8000"),
}


def tune_session(spark: SparkSession) -> SparkSession:
    for key, (spark_default, ours) in TUNED_SQL_DEFAULTS.items():
        if spark.conf.get(key, spark_default) == spark_default:
            spark.conf.set(key, ours)
    return spark


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tallyspark") -> SparkSession:
    """Return the active session or build one with the library defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return tune_session(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; only when that is unset
    (local tests) a private scratch folder is created.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tallyspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Within it, a query's shuffle files go when the query ends, not when the driver happens to collect its garbage.

    For writes of whole tables: the next step would else find the shuffles of the last ones still on disk.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def write_table(df: DataFrame, path: str, mode: str = "error", partition_by: list[str] | None = None) -> None:
    """Parquet under ``path``, as small as it gets without much work; the shuffles behind ``df`` are freed."""
    writer = df.write.mode(mode).option("compression", "zstd")
    with shuffles_freed(df.sparkSession):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def written_once(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in a new folder of the shared one, and that folder.

    For a table that several later passes read: each reads only the columns it needs, and
    none repeats the plan behind ``df`` or pushes its filters into it.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tallyspark/{name}-{uuid.uuid4().hex[:12]}"
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
