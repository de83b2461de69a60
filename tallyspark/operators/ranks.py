"""Exact ranks, quantiles and positional indexes without a single-partition sort.

A window without PARTITION BY moves every row into one task. Instead values
are first reduced to a value-count table (one row per distinct value). That
table is range-partitioned and checkpointed to the shared checkpoint folder,
so its partitions are ordered buckets with fixed ids; per-bucket totals (one
row per bucket) give each bucket its offset, and only a window *inside* a
bucket orders values. The result is exact whatever the bucket bounds are;
they only balance the work. Range partitioning samples the keys, so a
value's bucket never depends on a Python-side list of cut points.

Ranks are kept doubled, ``2 * below + t + 1`` for a value seen ``t`` times with
``below`` smaller values, so they are integers and rank sums are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.session import written_once

DEFAULT_BUCKETS = None  # None: one bucket per shuffle partition of the session


def ranged(df: DataFrame, order: list, buckets: int | None = None) -> DataFrame:
    """Range-partitioned, checkpointed copy of ``df`` with ``_p``, its ordered bucket id.

    The checkpoint (reliable, in the shared checkpoint folder) fixes the
    partition ids: a recomputation or another coalescing can not renumber
    them, and downstream consumers all see the same buckets.
    """
    from tallyspark.session import checkpoint_dir
    spark = df.sparkSession
    checkpoint_dir(spark)
    # Without an explicit count AQE sizes the buckets from the data (advisory
    # partition size), so a small table gets few buckets and a large one many.
    parts = df.repartitionByRange(buckets, *order) if buckets else df.repartitionByRange(*order)
    return parts.checkpoint().withColumn("_p", F.spark_partition_id())


def with_bucket(df: DataFrame, col: str, buckets: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Adds ``_b``, an ordered bucket id of ``col`` (ordered by ``by`` first, if given)."""
    return ranged(df, [*(by or []), col], buckets).withColumnRenamed("_p", "_b")


def value_counts(df: DataFrame, col: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(by..., v, t): occurrences of each non-null value, optionally per group."""
    by = by or []
    t = F.sum(weight) if weight else F.count(F.lit(1))
    return (df.where(F.col(col).isNotNull())
              .groupBy(*by, F.col(col).alias("v")).agg(t.cast("long").alias("t")))


def _bucket_offsets(b: DataFrame, by: list[str]) -> DataFrame:
    """(by..., _b, _off, _bt): values of the group before each bucket and in it.

    One row per (group, bucket) pair: at most buckets + groups rows.
    """
    totals = b.groupBy(*by, "_b").agg(F.sum("t").alias("_bt"))
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1) if by else \
        Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*by, "_b", F.coalesce(F.sum("_bt").over(w), F.lit(0)).alias("_off"), "_bt")


def cumulative_counts(vc: DataFrame, buckets: int | None = DEFAULT_BUCKETS, by: list[str] | None = None,
                      keep_bucket: bool = False) -> DataFrame:
    """(by..., v, t, below) from a value-count table: ``below`` = count of smaller values in the group.

    Lazy; work per task is bounded by the bucket size, not by the table or
    the group.
    """
    by = list(by or [])
    b = with_bucket(vc.select(*by, "v", "t"), "v", buckets, by)
    offsets = _bucket_offsets(b, by)
    inner = Window.partitionBy(*by, "_b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    off = F.broadcast(offsets) if not by else offsets  # without groups: one row per bucket
    out = b.join(off, [*by, "_b"]).select(
        *by, "v", "t", (F.col("_off") + F.coalesce(F.sum("t").over(inner), F.lit(0))).cast("long").alias("below"),
        "_b", "_off", "_bt")
    return out if keep_bucket else out.drop("_b", "_off", "_bt")


def doubled_rank(below: Column, t: Column) -> Column:
    """Twice the mid-rank (average rank of a tie block), as an integer."""
    return below * 2 + t + 1


def midranks(df: DataFrame, col: str, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """(v, t, below, rank): mid-rank of every distinct non-null value of a column."""
    cum = cumulative_counts(value_counts(df, col), buckets)
    return cum.withColumn("rank", doubled_rank(F.col("below"), F.col("t")) / 2.0)


def exact_quantiles(df: DataFrame, col: str, probs: list[float], buckets: int | None = DEFAULT_BUCKETS,
                    by: list[str] | None = None) -> DataFrame:
    """(by..., pi, p, q): linear-interpolated exact quantiles (numpy default), per group; see ``operators.selection``."""
    from tallyspark.operators.selection import quantiles
    return quantiles(df, col, probs, by)


def running_total(df: DataFrame, order: list, value: str | None = None,
                  partitions: int | None = None) -> DataFrame:
    """Adds ``idx`` (0-based position in the total order) and ``running`` (sum of ``value`` up to the row).

    Range partitioning splits even a single hot key value across tasks when
    the order ends in a unique tie-breaker; per-partition totals (one row per
    partition) give the offsets.
    """
    r = ranged(df, order, partitions)
    val = F.col(value) if value else F.lit(0)
    counts = r.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.sum(val).alias("_s"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                            F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_soff"))
    w = Window.partitionBy("_p").orderBy(*order)
    out = (r.join(F.broadcast(offsets), "_p")
            .withColumn("idx", (F.col("_off") + F.row_number().over(w) - 1).cast("long"))
            .withColumn("running", F.col("_soff") + F.sum(val).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    out = out.drop("_p", "_off", "_soff")
    return out if value else out.drop("running")


def row_index(df: DataFrame, order: list, partitions: int | None = None) -> DataFrame:
    """Adds ``idx``, the 0-based position of each row in the total order ``order``.

    The rows are written once, sorted within range partitions, with their partition and their place in it, so nothing
    but one row per partition is needed to number them: no second shuffle, and no window over a partition.
    """
    parts = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the place in the partition
    r, _ = written_once(parts.sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_at": at}), "ordered")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = r.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return r.join(F.broadcast(offsets), "_p").select(*df.columns, (F.col("_off") + F.col("_at")).cast("long").alias("idx"))


def rank_desc(df: DataFrame, col: str, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Adds ``rank_<col>``: SQL RANK() by ``col`` descending (1 + number of larger values), nulls last."""
    vc = value_counts(df.select((-F.col(col)).alias("_neg")), "_neg")
    cum = cumulative_counts(vc, buckets).select((-F.col("v")).alias(col), (F.col("below") + 1).alias(f"rank_{col}"))
    return df.join(cum, col, "left")
