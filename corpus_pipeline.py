"""Training-data pipeline over ``documents``: each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontamination, jaccard_join, mixing, quality, sharding
from tallyspark.llm.queries import table
from tallyspark.llm.text import delete_folder, free_name, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """Each row as one column ``__row``, beside the columns that an operator reads: what it adds cannot meet a column of the input."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go."""
    rules = quality.fit_list(docs, table(spark, sf_dir, "labels"))
    return quality.judge(packed(docs, "text"), rules).where("kept").select("__row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, that of the smallest doc_id (null ids come last); blank texts are in no group and all stay."""
    key, row = free_name(docs, "__id"), free_name(docs, "__row")
    gone, repeats = (d.select(F.col("doc_id").alias(key), F.col("row").alias(row)) for d in jaccard_join.surplus(jaccard_join.grouped(docs)))
    same = docs["doc_id"].eqNullSafe(F.col(key)) & (jaccard_join.row_identity("doc_id", "text") == F.col(row))
    stay = docs.join(gone, same, "left_anti")
    if repeats.isEmpty():
        return stay
    # Rows that agree in doc_id and text are one document.
    return stay.join(repeats, same, "left_anti").unionByName(stay.join(repeats, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.repeated(mixing.mix(packed(docs, "doc_id", "text", "source")), ["__row"]).select("__row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot."""
    return sharding.shard_by_bytes(docs, n_shards=24)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# Learned rules and hash-based shards are not expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again, and goes once the next one is written.

    The last stage replaces input columns named size, shard and slot by its own; all others keep every column and value."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = shared_folder(spark, f"pipeline-{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
