"""End-to-end run (run_all): raw table -> cleaned table -> every report, written under one folder.

The counterpart of the reference's make targets (clean, validate, sql,
statistics, model, dashboard). Each report is a DataFrame written with a
distributed sink (JSON lines or Parquet); nothing large passes through the
driver. Validation raises, like the reference, if a check fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import cleaning as C
from tallyspark.operators import dashboard as D
from tallyspark.operators import quality as Q
from tallyspark.operators import reports as R
from tallyspark.operators import resample as RS
from tallyspark.schema import CLEAN_COLUMNS


def _json(df: DataFrame, path: str) -> None:
    """Small report -> one JSON-lines file (the report has one row per group, test or month)."""
    df.coalesce(1).write.mode("overwrite").json(path)


def run_all(spark: SparkSession, raw: DataFrame, out_dir: str, *, reps: int = 2000, seed: int = 42,
            with_model: bool = True) -> str:
    """Write the cleaned table and all reports below ``out_dir``; returns the cleaned table path.

    Reports are small (one row per group / test / month), so each is written
    as a single JSON file; the cleaned table is Parquet partitioned by year
    and month.
    """
    from tallyspark.plans.analytics import statistics_report
    from tallyspark.session import tune_session
    tune_session(spark)
    out = out_dir.rstrip("/")
    internal_path = f"{out}/clean_internal"
    C.write_clean_table(raw, internal_path, keep_internal=True, quantity_mode="auto")
    internal = spark.read.parquet(internal_path)
    clean = internal.select(*CLEAN_COLUMNS)
    clean.write.mode("overwrite").partitionBy("year", "month").parquet(f"{out}/clean")

    # cleaning log: counters, IQR rule, row accounting, missing before/after
    _json(C.transformation_counts(None, internal), f"{out}/cleaning_log/transformations")
    _json(C.iqr_bounds(internal), f"{out}/cleaning_log/outlier_rule")
    _json(Q.raw_missing_counts(raw), f"{out}/cleaning_log/missing_before")
    _json(Q.null_counts(clean), f"{out}/cleaning_log/missing_after")
    _json(Q.row_accounting(raw, clean), f"{out}/cleaning_log/rows")

    # validation (raises on a failed check, after the log is written)
    _json(Q.quality_summary(clean), f"{out}/validation/summary")
    _json(Q.validate_checks(clean), f"{out}/validation/checks")
    Q.validate_or_raise(clean)

    # SQL reports and archived dashboard reports
    for name, df in {"monthly_channel": R.monthly_channel(clean), "top_products": R.top_products(clean),
                     "missing_rate_by_category": R.missing_rate(clean, "category"),
                     "customer_summary": R.customer_summary(clean), "month_over_month": R.month_over_month(clean),
                     "revenue_by_channel": R.revenue_by_channel(clean),
                     "outlier_sensitivity": R.outlier_sensitivity(clean),
                     "median_by_category": R.median_by_category(clean),
                     "payment_mix_by_channel": R.payment_mix_by_channel(clean),
                     "monthly_revenue_coverage": R.monthly_revenue_coverage(clean)}.items():
        _json(df, f"{out}/reports/{name}")

    # statistics: 12-test family with BH, cluster bootstrap
    _json(statistics_report(clean), f"{out}/statistics/tests")
    _json(RS.cluster_bootstrap_diff(clean, reps=reps, seed=seed), f"{out}/statistics/cluster_bootstrap")

    # dashboard cube (records) and its default KPI view
    cube = D.build_cube(clean)
    cube.write.mode("overwrite").parquet(f"{out}/dashboard/cube")
    cube = spark.read.parquet(f"{out}/dashboard/cube")
    _json(cube, f"{out}/dashboard/cube_json")
    period = D.default_period(cube, D.last_date_info(clean)).first()
    _json(D.kpi_summary(cube, period["start_month"], period["end_month"]), f"{out}/dashboard/default_kpis")

    if with_model:
        from tallyspark.operators import model as MD
        r = MD.benchmark(clean)
        _json(r["cv"], f"{out}/model/cv")
        _json(r["holdout"].withColumn("selected_alpha", F.lit(r["alpha"])), f"{out}/model/holdout")
        _json(r["baseline"], f"{out}/model/baseline")
        _json(r["subgroups"], f"{out}/model/subgroups")
    return f"{out}/clean"
