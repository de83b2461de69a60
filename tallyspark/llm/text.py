"""Shared column helpers of the training-data operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import checkpoint_dir

# The six white-space characters that separate words: space, \t, \n, \v, \f, \r.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else; texts without other letters than ASCII take the cheaper built-in."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    """The words of a text in order; an empty array for null, empty or blank text."""
    # split() gives one empty string for an empty text, and none otherwise.
    return F.array_remove(F.split(F.btrim(F.coalesce(c, F.lit("")), F.lit(SPACES)), SPACE_CLASS + "+"), "")


def once(c: Column) -> Column:
    """``c``, computed once per row: the test always holds, but keeps the optimizer from copying a costly column into
    each place that uses it (filters on a verdict). A plain rand() >= 0 would not: the optimizer knows that it is true."""
    return F.when(F.rand(0) + 1 > 0, c)


def count_words(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD_CLASS + "+")).cast("long")


def count_chars(c: Column, chars: str) -> Column:
    """How many code points of a text are one of ``chars``."""
    return (F.length(c) - F.length(F.translate(c, chars, ""))).cast("long")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that no input column has (names are compared without case, as Spark does)."""
    taken = {x.lower() for x in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` less the columns that an operator is about to add (an input column of that name gives way)."""
    taken = {x.lower() for x in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared checkpoint folder and read that; a lost executor re-reads files."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Python workers get at most ``rows`` rows at a time in what runs inside (their memory is that of a batch or two)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tallyspark-llm/{name}-{uuid.uuid4().hex[:12]}"


def delete_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
