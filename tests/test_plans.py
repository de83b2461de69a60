"""Plan-shape checks: no Python evaluation, column pruning and filter pushdown reach the scan."""

from pyspark.sql import functions as F

from tallyspark.operators import cleaning as C
from tallyspark.operators import reports as R
from tallyspark.sources import files as FS


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows():
    return [(f"t{i}", "CUST_1", "C", "I1", "2.5", "2", "5.0", "Cash", "Online", f"2024-0{1 + i % 3}-10", "True")
            for i in range(30)]


def test_cleaning_has_no_python_nodes(spark, raw_df):
    p = plan_of(C.clean(raw_df(_rows()), quantity_mode=False))
    for node in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "MapInPandas", "FlatMapGroupsInPandas"):
        assert node not in p


def test_report_prunes_columns_and_pushes_filters(spark, raw_df, tmp_path):
    out = str(tmp_path / "clean")
    FS.write_clean(C.clean(raw_df(_rows()), quantity_mode=False), out, partition_by_month=False)
    df = spark.read.parquet(out)
    p = plan_of(R.monthly_channel(df.where(F.col("location") == "Online")))
    scan = [line for line in p.splitlines() if "FileScan parquet" in line][0]
    assert "ReadSchema: struct<total_spent:double,location:string,transaction_date:string>" in scan
    assert "EqualTo(location,Online)" in scan


def test_partitioned_sink_prunes_months(spark, raw_df, tmp_path):
    out = str(tmp_path / "clean_p")
    FS.write_clean(C.clean(raw_df(_rows()), quantity_mode=False), out)
    p = plan_of(FS.read_clean(spark, out).where(F.col("month") == 2))
    assert "PartitionFilters: [isnotnull(month" in p and "(month#" in p
