"""Hash tree over the bytes of files, to show that an input did not change, or where it did.

A leaf covers the lines that begin in one fixed byte range of one file (a line
ends with \\n; any other byte is content, so binary files work as well). Spark's
text source splits files into such ranges, so a file of any size is read by many
tasks, each of which streams its lines through SHA-256; no file and no range is
held in one row. Groups of ``FAN_OUT`` neighbouring hashes are hashed again until
one root is left per file, which also covers the file's length.

Two trees are compared from the root down: only files whose roots differ have
their leaves compared. A difference names the file and the byte range.

Compressed text files (.gz and the like) are hashed as the text they hold, in one
range; empty files have no leaf and are not listed.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import checkpoint_dir

RANGE_BYTES = 64 * 1024 * 1024
FAN_OUT = 256


@contextmanager
def _split_at(spark: SparkSession, size: int):
    """File scans planned inside are cut at multiples of ``size``: the split size is the least of the two settings and never below the second."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, str(size))
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def leaves(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, size, start, length, lines, hash): one row per byte range of each file under ``paths``, read now."""
    def fold(batches):
        key, digest, lines = None, None, 0

        def leaf():
            columns = [[v] for v in (*key, lines, digest.hexdigest())]
            return pa.RecordBatch.from_arrays([pa.array(v) for v in columns], ["file", "size", "start", "length", "lines", "hash"])
        for b in batches:
            value, *where = (b.column(k).to_pylist() for k in range(5))
            for line, *at in zip(value, *where):
                if at != key:
                    if key is not None:
                        yield leaf()
                    key, digest, lines = at, hashlib.sha256(), 0
                digest.update(line)
                digest.update(b"\n")
                lines += 1
        if key is not None:
            yield leaf()
    checkpoint_dir(spark)
    with _split_at(spark, range_bytes):
        text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(paths)
        meta = [F.col(f"_metadata.{c}") for c in ("file_path", "file_size", "file_block_start", "file_block_length")]
        return text.select(F.col("value").cast("binary"), *meta).mapInArrow(
            fold, "file string, size long, start long, length long, lines long, hash string").checkpoint()


def roots(leaf: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, size, ranges, lines, root): one row per file, by levels of ``FAN_OUT`` neighbours."""
    totals = leaf.groupBy("file", "size").agg(F.count(F.lit(1)).alias("ranges"), F.sum("lines").alias("lines"))
    # The number of a range in its file; its neighbours share the quotient by FAN_OUT on the next level.
    level = leaf.select("file", F.floor(F.col("start") / range_bytes).alias("k"), "hash")
    last = level.agg(F.max("k")).first()[0] or 0
    node = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "hash"))), lambda x: x["hash"]), ""), 256)
    while True:
        level = level.groupBy("file", F.floor(F.col("k") / FAN_OUT).alias("up")).agg(node.alias("hash")).withColumnRenamed("up", "k")
        last //= FAN_OUT
        if last == 0:
            break
    return (totals.join(level.select("file", "hash"), "file")
                  .select("file", "size", "ranges", "lines", F.sha2(F.concat_ws(":", F.col("size").cast("string"), "hash"), 256).alias("root")))


@dataclass(frozen=True)
class Tree:
    leaves: DataFrame
    roots: DataFrame


def hash_tree(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES) -> Tree:
    """The tree of all files under ``paths`` as they are now."""
    leaf = leaves(spark, paths, range_bytes)
    return Tree(leaf, roots(leaf, range_bytes).checkpoint())


def differences(before: Tree, after: Tree) -> DataFrame:
    """(file, start, length, change): byte ranges that were added, removed or changed between two trees of the same range size."""
    a, b = before.roots.alias("a"), after.roots.alias("b")
    files = a.join(b, "file", "full").where(~F.col("a.root").eqNullSafe(F.col("b.root"))).select("file")
    old, new = (t.leaves.join(files, "file", "left_semi") for t in (before, after))
    both = old.alias("a").join(new.alias("b"), ["file", "start"], "full")
    kind = F.when(F.col("a.hash").isNull(), "added").when(F.col("b.hash").isNull(), "removed").otherwise("changed")
    moved = both.where(~F.col("a.hash").eqNullSafe(F.col("b.hash")) | ~F.col("a.length").eqNullSafe(F.col("b.length")))
    ranges = moved.select("file", "start", F.greatest("a.length", "b.length").alias("length"), kind.alias("change"))
    # A last \n more or less changes the length of the file but no line.
    only_length = files.join(ranges, "file", "left_anti").join(after.roots, "file").select("file", F.lit(0).cast("long").alias("start"), F.col("size").alias("length"), F.lit("changed").alias("change"))
    return ranges.unionByName(only_length)
