"""Line deduplication over levelled sorted runs of line hashes.

A line's key is the line stripped of white space and lower-cased (A-Z); its hash
has 128 bits. Documents come in batches. Each batch is reduced to one row per key
(hash, number of documents, largest doc_id) and written as a sorted run of level
0; when a level has ``fanout`` runs they are merged into one run of the next level
(a grouped sum by hash; it does not use the sort order), so a table of B batches is re-written about
log(B) times. A batch can be anti-joined against the runs (``unseen``): what is
left are the lines that no earlier batch has. ``drop_repeated_lines`` does not use it.

``drop_repeated_lines`` applies it to a table. Whether a line goes depends on the
whole table (number of documents, largest doc_id), so all batches are added first;
the lines are then merge-joined with the frequent keys, and each document loses
the lines that another document keeps. Frequent keys are salted for that join, so
one line in a third of all documents does not land in one task. Texts travel once,
joined by doc_id to their own short list of hashes.

Runs are Parquet files in the shared checkpoint folder; a lost executor re-reads
them. Runs that a merge has replaced are deleted.

Defined cases. Null or empty text: one empty line. Repeated rows of one doc_id
count as one document and lose the same lines. Null doc_ids count as one document
that is smaller than all others. Empty table: no rows. Keys shorter than
``min_chars`` code points are never dropped. Input columns named like an added one
give way.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.text import delete_folder, free_name, saved, shared_folder, without

SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
NO_ID = -(1 << 63)
SALTS = 16


def line_keys(text: bytes | None, min_chars: int) -> list[bytes | None]:
    """The hash of each line's key; None where the key is too short to count."""
    out: list[bytes | None] = []
    for line in (text or b"").split(b"\n"):
        key = line.strip(SPACE_BYTES).lower()  # on bytes: A-Z only
        long_enough = len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if long_enough else None)
    return out


def document_keys(docs: DataFrame, min_chars: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, hash): each key once per row of ``docs``."""
    def lines(batches):
        for b in batches:
            ids, hashes = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                mine = {k for k in line_keys(t, min_chars) if k is not None}
                ids += [i] * len(mine)
                hashes += mine
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], ["id", "hash"])

    slim = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("text"))
    return slim.mapInArrow(lines, "id long, hash binary")


class LineRuns:
    """Levelled sorted runs (hash, n_docs, keeper) in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = []

    @staticmethod
    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy("hash").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def _write(self, rows: DataFrame, level: int) -> None:
        path = shared_folder(self.spark, f"lines-l{level}")
        rows.sortWithinPartitions("hash").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._write(self.merge(self.spark.read.schema(RUN).parquet(*old)), level + 1)
            for p in old:
                delete_folder(self.spark, p)

    def add(self, keys: DataFrame) -> None:
        """Add a batch of (id, hash). A document must be in one batch only."""
        each = keys.groupBy("hash").agg(F.countDistinct("id").alias("n_docs"), F.max("id").alias("keeper"))
        self._write(each, 0)

    def rows(self) -> DataFrame:
        """All runs; a hash may be in several."""
        paths = [p for level in self.levels for p in level]
        return self.spark.read.schema(RUN).parquet(*paths) if paths else self.spark.createDataFrame([], RUN)

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The (id, hash) of a new batch that no run has: a sort-merge anti-join by hash."""
        return keys.join(self.rows().hint("merge"), "hash", "left_anti").select("id", "hash")

    def delete(self) -> None:
        for p in [p for level in self.levels for p in level]:
            delete_folder(self.spark, p)
        self.levels = []


RUN = T.StructType([T.StructField("hash", T.BinaryType()), T.StructField("n_docs", T.LongType()), T.StructField("keeper", T.LongType())])


def drop_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3,
                        text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept`` (the text without its dropped lines).

    Keys in at least ``min_docs`` documents stay only in the largest doc_id that holds them.
    """
    spark = docs.sparkSession
    docs = without(docs, ["n_lines", "n_dropped", "kept"])
    batch = F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")
    path = shared_folder(spark, "lines")
    (document_keys(docs, min_chars, text, doc_id).withColumn("batch", batch)
     .write.partitionBy("batch").parquet(path))
    lines = spark.read.schema("id long, hash binary, batch int").parquet(path)
    runs = LineRuns(spark, fanout)
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b))
    frequent = saved(runs.merge(runs.rows()).where(F.col("n_docs") >= min_docs).select("hash", "keeper"))
    salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lost = saved(lines.withColumn("salt", F.pmod(F.xxhash64("id", F.lit("salt")), F.lit(SALTS)).cast("int"))
                 .join(salted, ["hash", "salt"]).where(F.col("id") != F.col("keeper"))
                 .groupBy("id").agg(F.collect_set("hash").alias("lost")))
    runs.delete()
    delete_folder(spark, path)

    ident, gone = free_name(docs, "__id"), free_name(docs, "__lost")
    at = docs.columns.index(next(c for c in docs.columns if c.lower() == text.lower()))
    joined = (docs.withColumn(ident, F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)))
              .join(lost.withColumnRenamed("lost", gone).withColumnRenamed("id", ident), ident, "left")
              .select(*[F.col(f"`{c}`") for c in docs.columns], gone))
    n = len(docs.columns)
    out_schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()),
                               T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])

    def rewrite(it):
        for b in it:
            n_lines, n_dropped, kept = [], [], []
            for t, drop in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column(n).to_pylist()):
                t = t or b""
                if not drop:
                    n_lines.append(t.count(b"\n") + 1)
                    n_dropped.append(0)
                    kept.append(t)
                    continue
                drop = set(drop)
                rows = t.split(b"\n")
                stay = [r for r, k in zip(rows, line_keys(t, min_chars)) if k not in drop]
                n_lines.append(len(rows))
                n_dropped.append(len(rows) - len(stay))
                kept.append(b"\n".join(stay))
            new = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(n)] + new, [f.name for f in out_schema.fields])

    return joined.mapInArrow(rewrite, out_schema)
