"""Derived tables written once to the shared checkpoint folder and reused.

The cleaned table is an ETL product: many reports read it. It is written as
Parquet under ``spark.checkpoint.dir`` (the shared folder every executor
sees), keyed by a fingerprint of the input files (path, length, modification
time), so a changed input never reuses a stale table. Writing it also cuts
the lineage: a lost executor re-reads Parquet instead of recomputing the
whole cleaning plan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.session import checkpoint_dir


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def code_signature() -> str:
    """Hash of the source of the modules that define the cleaned table, so a rule change never reuses a stale table."""
    import inspect

    from tallyspark import schema
    from tallyspark.functions import calendar, numeric, text
    from tallyspark.operators import cleaning, ranks
    from tallyspark.sources import adapter, dirty
    src = "".join(inspect.getsource(m) for m in (schema, text, numeric, calendar, cleaning, ranks, adapter, dirty))
    return hashlib.sha1(src.encode()).hexdigest()[:12]


def input_signature(spark: SparkSession, paths: list[str]) -> str:
    """Hash of (path, total length, latest modification time) of each input and of the code version."""
    parts = [code_signature()]
    for path in paths:
        fs, p = _fs(spark, path)
        summary = fs.getContentSummary(p)
        mtime = 0
        it = fs.listFiles(p, True)
        while it.hasNext():
            mtime = max(mtime, it.next().getModificationTime())
        parts.append(f"{path}|{summary.getLength()}|{mtime}")
    return hashlib.sha1("\n".join(parts).encode()).hexdigest()[:16]


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path.rstrip("/") + "/_SUCCESS")
    return bool(fs.exists(p))


def materialized(spark: SparkSession, name: str, inputs: list[str], write: Callable[[str], None]) -> DataFrame:
    """Read ``name`` for these inputs from the shared folder, writing it first (``write(path)``) if absent."""
    return spark.read.parquet(materialized_path(spark, name, inputs, write))


def materialized_path(spark: SparkSession, name: str, inputs: list[str], write: Callable[[str], None]) -> str:
    """The folder of ``name`` for these inputs, written first if absent.

    The table is written to a unique temporary folder and renamed into place,
    so concurrent builders never read a half-written table; if another
    builder finished first, its table is used.
    """
    import uuid
    path = f"{checkpoint_dir(spark).rstrip('/')}/tallyspark/{name}-{input_signature(spark, inputs)}"
    if not exists(spark, path):
        tmp = f"{path}.tmp-{uuid.uuid4().hex[:12]}"
        write(tmp)
        # A directory rename onto an existing directory would nest the source
        # inside it, so publish only if no other builder has finished first.
        if not exists(spark, path):
            fs, target = _fs(spark, path)
            _, source = _fs(spark, tmp)
            if not fs.rename(source, target) and not exists(spark, path):
                raise RuntimeError(f"could not publish {tmp} as {path}")
    return path
