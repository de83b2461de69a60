"""Month x channel x category cube and the dashboard's KPI queries over it.

The cube is the pre-aggregate: one row per (month, channel, category) with
additive measures, so every dashboard query is a filter + re-aggregation of a
table whose size is bounded by months x channels x categories, independent
of the number of transactions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.calendar import parsed_date

ALL = "All"


def _msum(c: str) -> Column:
    """Re-aggregate a cube money measure exactly (2-decimal values summed in DECIMAL)."""
    return F.sum(F.col(c).cast("decimal(28,6)")).cast("double")
METRICS = ("salesPerTxn", "sales", "valid", "units")


def build_cube(df: DataFrame) -> DataFrame:
    """(month, location, category, rows, valid, quantity_valid, sales, units).

    Null keys are kept as their own group; an all-null sum is 0.
    """
    return (df.groupBy(F.substring("transaction_date", 1, 7).alias("month"), "location", "category")
              .agg(F.count(F.lit(1)).alias("rows"), F.count("total_spent").alias("valid"),
                   F.count("quantity").alias("quantity_valid"),
                   F.coalesce(F.sum(F.col("total_spent").cast("decimal(28,6)")), F.lit(0)).cast("double").alias("sales"),
                   F.coalesce(F.sum(F.col("quantity").cast("double")), F.lit(0.0)).alias("units")))


def cube_json(cube: DataFrame) -> DataFrame:
    """Compact record JSON of the cube (A8), one string per row."""
    return cube.select(F.to_json(F.struct(*cube.columns)).alias("record"))


def _filters(location: str, category: str | None) -> Column:
    cond = F.lit(True)
    if location != ALL:
        cond = cond & (F.col("location") == F.lit(location))
    if category is not None and category != ALL:
        cond = cond & (F.col("category") == F.lit(category))
    return cond


def _clamp(start: str, end: str) -> tuple[str, str]:
    """An inverted range collapses to its start month."""
    return (start, start) if start > end else (start, end)


def kpi_summary(cube: DataFrame, start: str, end: str, location: str = ALL, category: str = ALL) -> DataFrame:
    """Sales, valid, rows, average (null without valid sales) and coverage (null without rows) (K1)."""
    start, end = _clamp(start, end)
    rows = cube.where((F.col("month") >= start) & (F.col("month") <= end) & _filters(location, category))
    g = rows.agg(F.coalesce(_msum("sales"), F.lit(0.0)).alias("sales"),
                 F.coalesce(F.sum("valid"), F.lit(0)).cast("long").alias("valid"),
                 F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("rows"))
    return g.select("sales", "valid", "rows",
                    F.when(F.col("valid") > 0, F.col("sales") / F.col("valid")).alias("average"),
                    F.when(F.col("rows") > 0, F.col("valid") / F.col("rows")).alias("coverage"))


def month_index(cube: DataFrame) -> DataFrame:
    """(month, mi): position of each present month in sorted order (a few hundred rows)."""
    months = cube.where(F.col("month").isNotNull()).select("month").distinct()
    return months.select("month", (F.row_number().over(Window.orderBy("month")) - 1).alias("mi"))


def delta_state(cur: Column, prev: Column) -> tuple[Column, Column]:
    """(relative change, state) of current vs previous."""
    state = (F.when(prev.isNull(), "no_prior")
              .when(prev == 0, F.when(cur == 0, "no_change").otherwise("previous_zero"))
              .otherwise("change"))
    change = F.when(prev.isNotNull() & (prev != 0), (cur - prev) / F.abs(prev))
    return change, state


def kpi_period_over_period(cube: DataFrame, start: str, end: str, location: str = ALL,
                           category: str = ALL) -> DataFrame:
    """KPIs of [start, end] vs the previous equal-length run of present months.

    One row per metric (sales, valid, average): current, previous, change and
    state. The previous period is months[s-len .. s-1] in the sorted list of
    months present in the cube; none if it would start before the first month.
    Current and previous sums come from one conditional aggregation.
    """
    start, end = _clamp(start, end)
    idx = month_index(cube)
    bounds = idx.agg(F.max(F.when(F.col("month") == start, F.col("mi"))).alias("s"),
                     F.max(F.when(F.col("month") == end, F.col("mi"))).alias("e"))
    bounds = bounds.withColumn("len", F.col("e") - F.col("s") + 1)
    has_prior = (F.col("len") >= 1) & (F.col("s") - F.col("len") >= 0)
    tagged = (cube.where(_filters(location, category)).join(idx, "month", "left")
                  .crossJoin(F.broadcast(bounds)))
    cur = (F.col("month") >= start) & (F.col("month") <= end)
    prv = has_prior & (F.col("mi") >= F.col("s") - F.col("len")) & (F.col("mi") <= F.col("s") - 1)
    g = tagged.agg(
        F.coalesce(F.sum(F.when(cur, F.col("sales").cast("decimal(28,6)"))).cast("double"), F.lit(0.0)).alias("cs"),
        F.coalesce(F.sum(F.when(cur, F.col("valid"))), F.lit(0)).cast("long").alias("cv"),
        F.sum(F.when(prv, F.col("sales").cast("decimal(28,6)"))).cast("double").alias("_ps"),
        F.sum(F.when(prv, F.col("valid"))).alias("_pv"))
    g = g.crossJoin(F.broadcast(bounds.select(has_prior.alias("hp"))))
    ps = F.when(F.col("hp"), F.coalesce(F.col("_ps"), F.lit(0.0)))
    pv = F.when(F.col("hp"), F.coalesce(F.col("_pv"), F.lit(0)).cast("long"))
    ca = F.when(F.col("cv") > 0, F.col("cs") / F.col("cv"))
    pa = F.when(pv > 0, ps / pv)
    metrics = []
    for name, c, p in (("sales", F.col("cs"), ps), ("valid", F.col("cv").cast("double"), pv.cast("double")),
                       ("average", ca, pa)):
        change, state = delta_state(c, p)
        if name == "average":
            state = F.when(F.col("cv") == 0, F.lit("no_valid_sales")).otherwise(state)
            change = F.when(F.col("cv") > 0, change)
        metrics.append(F.struct(F.lit(name).alias("metric"), c.cast("double").alias("current"),
                                p.cast("double").alias("previous"), change.cast("double").alias("change"),
                                state.alias("state")))
    # One aggregate row -> three metric rows (no re-aggregation per metric).
    return g.select(F.inline(F.array(*metrics)))


def last_date_info(clean: DataFrame) -> DataFrame:
    """One row: last transaction date, its month and whether that month is complete."""
    d = parsed_date(F.col("transaction_date"))
    return (clean.agg(F.max(d).alias("last_date"))
                 .select("last_date", F.date_format("last_date", "yyyy-MM").alias("last_month"),
                         (F.last_day("last_date") == F.col("last_date")).alias("last_month_complete")))


def monthly_trend(cube: DataFrame, last: DataFrame, start: str, end: str, location: str = ALL,
                  category: str = ALL) -> DataFrame:
    """Monthly sales under the filters, with a partial-month marker (K3)."""
    start, end = _clamp(start, end)
    rows = cube.where((F.col("month") >= start) & (F.col("month") <= end) & _filters(location, category))
    g = rows.groupBy("month").agg(_msum("sales").alias("sales"))
    return (g.crossJoin(F.broadcast(last.select("last_month", "last_month_complete")))
              .select("month", "sales",
                      ((F.col("month") == F.col("last_month")) & ~F.col("last_month_complete")).alias("partial")))


def category_breakdown(cube: DataFrame, start: str, end: str, location: str = ALL, category: str = ALL,
                       metric: str = "salesPerTxn") -> DataFrame:
    """Per-category measures under month/channel filters (category filter ignored).

    ``value`` is the chosen metric (sales per valid transaction is 0 without
    valid sales); ``selected`` marks the filtered category.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    start, end = _clamp(start, end)
    rows = cube.where((F.col("month") >= start) & (F.col("month") <= end) & _filters(location, None))
    g = rows.groupBy("category").agg(
        _msum("sales").alias("sales"), F.sum("valid").cast("long").alias("valid"),
        F.sum("units").alias("units"), F.sum("quantity_valid").cast("long").alias("quantity_valid"),
        F.sum("rows").cast("long").alias("rows"))
    value = {"salesPerTxn": F.when(F.col("valid") > 0, F.col("sales") / F.col("valid")).otherwise(F.lit(0.0)),
             "sales": F.col("sales"), "valid": F.col("valid").cast("double"), "units": F.col("units")}[metric]
    sel = F.lit(False) if category == ALL else F.coalesce(F.col("category") == F.lit(category), F.lit(False))
    return g.select("category", "sales", "valid", "units", "quantity_valid", "rows",
                    value.alias("value"), sel.alias("selected"))


def quantity_coverage(cube: DataFrame, start: str, end: str, location: str = ALL) -> DataFrame:
    """Share of rows with a quantity among the breakdown rows (K5)."""
    start, end = _clamp(start, end)
    rows = cube.where((F.col("month") >= start) & (F.col("month") <= end) & _filters(location, None))
    g = rows.agg(F.sum("quantity_valid").alias("qv"), F.sum("rows").alias("r"))
    return g.select(F.when(F.col("r") > 0, F.col("qv") / F.col("r")).otherwise(F.lit(0.0)).alias("quantity_coverage"))


def default_period(cube: DataFrame, last: DataFrame) -> DataFrame:
    """First present month -> last complete month (K6).

    When the last present month is the data's partial last month, the range
    ends one present month earlier.
    """
    months = cube.where(F.col("month").isNotNull()).select("month").distinct()
    g = months.agg(F.min("month").alias("start_month"), F.max("month").alias("max_month"))
    j = g.crossJoin(F.broadcast(last.select("last_month", "last_month_complete")))
    pm = (months.join(F.broadcast(g.select("max_month")), F.col("month") < F.col("max_month"))
                .agg(F.max("month").alias("prev_month")))
    drop_last = ((F.col("max_month") == F.col("last_month")) & ~F.col("last_month_complete")
                 & F.col("prev_month").isNotNull())
    return j.crossJoin(F.broadcast(pm)).select(
        "start_month", F.when(drop_last, F.col("prev_month")).otherwise(F.col("max_month")).alias("end_month"))
