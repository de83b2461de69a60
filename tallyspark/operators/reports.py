"""Sales, coverage, product, customer and month-over-month reports.

All inputs are the cleaned table. Money is summed in DECIMAL (exact and
independent of partitioning); averages and percentages are plain doubles
derived from those sums and are not rounded (rounding is presentation).
Every grouping is a hash aggregate with map-side partial aggregation, so the
shuffle carries one row per group and task, whatever the skew of a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.stats import complete_month_rows
from tallyspark.functions.numeric import safe_ratio


def money(c) -> F.Column:
    return F.sum(F.col(c).cast("decimal(28,6)") if isinstance(c, str) else c.cast("decimal(28,6)"))


def _sales_cols(total: str = "total_spent"):
    s = money(total)
    n = F.count(total)
    return s, n


def monthly_channel(df: DataFrame) -> DataFrame:
    """Monthly recorded sales and coverage by channel."""
    s, n = _sales_cols()
    g = (df.groupBy(F.substring("transaction_date", 1, 7).alias("sales_month"), F.col("location").alias("channel"))
           .agg(F.count(F.lit(1)).alias("total_records"), n.alias("valid_sales_records"), s.alias("_s")))
    return g.select("sales_month", "channel", "total_records", "valid_sales_records",
                    F.col("_s").cast("double").alias("recorded_sales"),
                    safe_ratio(F.col("_s").cast("double"), F.col("valid_sales_records")).alias("sales_per_valid_transaction"),
                    (F.lit(100.0) * F.col("valid_sales_records") / F.col("total_records")).alias("sales_coverage_pct"))


def top_products(df: DataFrame, min_n: int = 20, k: int = 10, by: str = "units") -> DataFrame:
    """Top-k items (recorded, not imputed) by units (or transactions), groups of >= min_n rows.

    Ties are broken by item and category so the cut at k is deterministic.
    """
    g = (df.where(F.col("quantity").isNotNull() & (F.col("item_imputed") == "No"))
           .groupBy(F.col("item"), F.col("category"))
           .agg(F.count(F.lit(1)).alias("transaction_count"),
                F.sum(F.col("quantity").cast("double")).alias("units_sold"),
                money("total_spent").cast("double").alias("recorded_sales"))
           .where(F.col("transaction_count") >= min_n))
    key = "units_sold" if by == "units" else "transaction_count"
    return (g.orderBy(F.col(key).desc(), F.col("item").asc_nulls_first(), F.col("category").asc_nulls_first())
             .limit(k))


def missing_rate(df: DataFrame, by: str = "category") -> DataFrame:
    """Records, missing-total records and their share per group."""
    miss = F.sum(F.when(F.col("total_spent").isNull(), 1).otherwise(0))
    return (df.groupBy(F.col(by))
              .agg(F.count(F.lit(1)).alias("total_records"), miss.cast("long").alias("missing_sales_records"))
              .withColumn("missing_sales_pct", F.lit(100.0) * F.col("missing_sales_records") / F.col("total_records")))


def customer_summary(df: DataFrame) -> DataFrame:
    """Per-customer activity."""
    s, n = _sales_cols()
    return (df.groupBy(F.col("customer_id"))
              .agg(F.count(F.lit(1)).alias("transaction_count"), n.alias("valid_sales_records"), s.alias("_s"))
              .select("customer_id", "transaction_count", "valid_sales_records",
                      F.col("_s").cast("double").alias("recorded_sales"),
                      safe_ratio(F.col("_s").cast("double"), F.col("valid_sales_records")).alias("average_transaction_value")))


def monthly_sales(df: DataFrame) -> DataFrame:
    """(sales_month, recorded_sales decimal)."""
    return df.groupBy(F.substring("transaction_date", 1, 7).alias("sales_month")).agg(money("total_spent").alias("rs"))


def month_over_month(df: DataFrame) -> DataFrame:
    """Recorded sales, previous month's and percent change (F1).

    The LAG window orders the monthly aggregate (one row per month, a few
    hundred rows), never the fact table.
    """
    m = monthly_sales(df)
    w = Window.orderBy(F.col("sales_month").asc_nulls_first())
    prev = F.lag("rs").over(w)
    return m.select("sales_month", F.col("rs").cast("double").alias("recorded_sales"),
                    prev.cast("double").alias("previous_month_sales"),
                    F.when(prev != 0, F.lit(100.0) * (F.col("rs") - prev).cast("double") / prev.cast("double"))
                     .alias("month_over_month_pct"))


def headline_totals(df: DataFrame) -> DataFrame:
    """Sales, valid records, average and coverage without a partial last month."""
    df = complete_month_rows(df).where(F.col("transaction_date").isNotNull())
    g = df.agg(money("total_spent").alias("_s"), F.count("total_spent").alias("valid"),
               F.count(F.lit(1)).alias("records"))
    return g.select(F.col("_s").cast("double").alias("sales"), "valid", "records",
                    safe_ratio(F.col("_s").cast("double"), F.col("valid")).alias("average"),
                    safe_ratio(F.col("valid"), F.col("records")).alias("coverage"))


def category_summary(df: DataFrame) -> DataFrame:
    """Sales, valid count and sales per valid transaction by category, without a partial last month."""
    df = complete_month_rows(df).where(F.col("transaction_date").isNotNull())
    g = df.groupBy("category").agg(money("total_spent").alias("_s"), F.count("total_spent").alias("valid"))
    return g.select("category", F.col("_s").cast("double").alias("sales"), "valid",
                    safe_ratio(F.col("_s").cast("double"), F.col("valid")).alias("sales_per_transaction"))


def channel_mean_difference(df: DataFrame, a: str = "Online", b: str = "In-store",
                            cluster: str = "customer_id") -> DataFrame:
    """Observed mean difference a - b and the number of clusters."""
    t = df.where(F.col("total_spent").isNotNull())
    g = t.agg(
        (F.sum(F.when(F.col("location") == a, F.col("total_spent").cast("decimal(28,6)"))).cast("double")
         / F.count_if(F.col("location") == a)).alias("_ma"),
        (F.sum(F.when(F.col("location") == b, F.col("total_spent").cast("decimal(28,6)"))).cast("double")
         / F.count_if(F.col("location") == b)).alias("_mb"),
        F.count_distinct(cluster).alias("clusters"))
    return g.select((F.col("_ma") - F.col("_mb")).alias("observed_difference"), "clusters")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long-form contingency table (a, b, n) of the non-empty cells of non-null pairs.

    Empty cells are implied (count 0) and never materialised: a dense grid
    grows with the product of the level counts.
    """
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


# ---- reports named by the archived dashboard summary (L group) -----------------

def revenue_by_channel(df: DataFrame) -> DataFrame:
    """L1: recorded revenue, valid and all records per channel."""
    return (df.groupBy(F.col("location").alias("channel"))
              .agg(money("total_spent").cast("double").alias("revenue"),
                   F.count("total_spent").alias("valid_records"), F.count(F.lit(1)).alias("records")))


def revenue_per_txn_ci(df: DataFrame, z: float = 1.96) -> DataFrame:
    """L2: mean total per channel with a normal-approximation interval (mean +- z sd / sqrt n)."""
    t = df.where(F.col("total_spent").isNotNull())
    g = t.groupBy(F.col("location").alias("channel")).agg(
        F.count(F.lit(1)).alias("n"), money("total_spent").alias("_s"),
        F.sum(F.col("total_spent").cast("decimal(18,2)") * F.col("total_spent").cast("decimal(18,2)")).alias("_ss"))
    s = F.col("_s").cast("double")
    mean = s / F.col("n")
    # sample variance from exact sums: (ss - s^2/n) / (n - 1)
    var = safe_ratio(F.col("_ss").cast("double") - s * s / F.col("n"), F.col("n") - 1)
    half = F.lit(z) * F.sqrt(var) / F.sqrt(F.col("n").cast("double"))
    return g.select("channel", "n", mean.alias("mean_total"), (mean - half).alias("ci_low"),
                    (mean + half).alias("ci_high"))


def outlier_sensitivity(df: DataFrame) -> DataFrame:
    """L3: sums and means with and without IQR-flagged rows, and relative changes, per channel."""
    t = df.where(F.col("total_spent").isNotNull())
    keep = F.col("total_outlier_iqr") == "No"
    g = t.groupBy(F.col("location").alias("channel")).agg(
        money("total_spent").cast("double").alias("sales_all"),
        F.count(F.lit(1)).alias("n_all"),
        F.sum(F.when(keep, F.col("total_spent").cast("decimal(28,6)"))).cast("double").alias("sales_trimmed"),
        F.count_if(keep).alias("n_trimmed"))
    return g.select("channel", "sales_all", "n_all", "sales_trimmed", "n_trimmed",
                    safe_ratio(F.col("sales_trimmed") - F.col("sales_all"), F.col("sales_all")).alias("sales_rel_change"),
                    (safe_ratio(safe_ratio(F.col("sales_trimmed"), F.col("n_trimmed")),
                                F.col("sales_all") / F.col("n_all")) - 1.0).alias("mean_rel_change"))


def median_by_category(df: DataFrame) -> DataFrame:
    """Median recorded total per category (exact, linear interpolation, no per-group buffer)."""
    from tallyspark.operators.ranks import exact_quantiles
    t = df.where(F.col("total_spent").isNotNull())
    med = exact_quantiles(t, "total_spent", [0.5], by=["category"]).select("category", F.col("q").alias("median_total"))
    n = t.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return med.join(n, "category", "inner")


def item_pareto(df: DataFrame) -> DataFrame:
    """Items by revenue (desc, then item) with cumulative revenue share (F8).

    Item revenue is aggregated first (one row per item); the running total
    is a range-partitioned scan with per-partition offsets, not a global window.
    """
    from tallyspark.operators.ranks import running_total
    g = (df.where(F.col("item").isNotNull() & F.col("total_spent").isNotNull())
           .groupBy("item").agg(money("total_spent").alias("_r")))
    total = g.agg(F.sum("_r").alias("_tot"))
    rt = running_total(g, [F.col("_r").desc(), F.col("item").asc()], "_r")
    return rt.crossJoin(F.broadcast(total)).select(
        "item", F.col("_r").cast("double").alias("revenue"), (F.col("idx") + 1).alias("revenue_rank"),
        (F.col("running").cast("double") / F.col("_tot").cast("double")).alias("cumulative_share"))


def item_rank_stability(df: DataFrame) -> DataFrame:
    """Item rank by units with recorded items only vs. with imputed items too (SQL RANK)."""
    from tallyspark.operators.ranks import rank_desc
    base = df.where(F.col("item").isNotNull() & F.col("quantity").isNotNull())
    rec = (base.where(F.col("item_imputed") == "No").groupBy("item")
               .agg(F.sum(F.col("quantity").cast("double")).alias("units_recorded")))
    allr = base.groupBy("item").agg(F.sum(F.col("quantity").cast("double")).alias("units_all"))
    j = allr.join(rec, "item", "left").fillna(0.0, ["units_recorded"])
    j = rank_desc(rank_desc(j, "units_recorded"), "units_all")
    return (j.select("item", "units_recorded", "units_all", F.col("rank_units_recorded").alias("rank_recorded"),
                     F.col("rank_units_all").alias("rank_all"))
             .withColumn("rank_change", F.col("rank_recorded") - F.col("rank_all")))


def category_channel_share(df: DataFrame) -> DataFrame:
    """Rows per (category, channel), share of the category's rows."""
    g = df.groupBy("category", F.col("location").alias("channel")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("category")))


def missing_vs_unknown(df: DataFrame) -> DataFrame:
    """Per analytical field, rows truly missing (null) vs. coded "Unknown"."""
    from tallyspark.schema import ANALYTICAL_FIELDS
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in ANALYTICAL_FIELDS],
                 *[F.count_if(F.col(c).cast("string") == "Unknown").alias(f"u_{c}") for c in ANALYTICAL_FIELDS])
    stack = ", ".join(f"'{c}', m_{c}, u_{c}" for c in ANALYTICAL_FIELDS)
    return one.selectExpr(f"stack({len(ANALYTICAL_FIELDS)}, {stack}) as (field, missing, unknown)")


def payment_mix_by_channel(df: DataFrame) -> DataFrame:
    """Payment-method counts and shares within each channel."""
    g = df.groupBy(F.col("location").alias("channel"), "payment_method").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("channel_n", F.sum("n").over(Window.partitionBy("channel"))) \
            .withColumn("share", F.col("n") / F.col("channel_n"))


def monthly_revenue_coverage(df: DataFrame) -> DataFrame:
    """Monthly revenue and sales coverage (all channels)."""
    g = (df.groupBy(F.substring("transaction_date", 1, 7).alias("sales_month"))
           .agg(money("total_spent").alias("_s"), F.count("total_spent").alias("valid"),
                F.count(F.lit(1)).alias("records")))
    return g.select("sales_month", F.col("_s").cast("double").alias("revenue"), "valid", "records",
                    safe_ratio(F.col("valid"), F.col("records")).alias("coverage"))


def dimension_values(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values of a dimension."""
    return df.select(F.col(col).alias("value")).where(F.col("value").isNotNull()).distinct().orderBy("value")

