"""Driver contract, quality checks and sinks on small fixtures."""

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import cleaning as C
from tallyspark.operators import quality as Q
from tallyspark.sources import files as FS


def _row(tid, item="I1", price="2.5", qty="2", total="5.0", date="2024-01-31", disc="True"):
    return (tid, "CUST_1", "C", item, price, qty, total, "Cash", "Online", date, disc)


def test_contract_keys():
    import __spark_entry__ as E
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    assert len(q) >= 100


def test_entry_runs_on_smallest_scale(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert [c for c in df.columns] == ["metric", "current", "previous", "change", "state"]
    assert {r["metric"] for r in rows} == {"sales", "valid", "average"}


def test_checks_pass_and_fail(spark, raw_df):
    good = C.clean(raw_df([_row("a"), _row("b", total="", qty="")]))
    assert all(ok for _, ok in Q.validate_or_raise(good))
    dup = C.clean(raw_df([_row("a"), _row("a")]))
    with pytest.raises(AssertionError):
        Q.validate_or_raise(dup)
    bad_dates = C.clean(raw_df([_row("a", date="2024-02-30")]))
    checks = dict((r["check"], r["passed"]) for r in Q.validate_checks(bad_dates).collect())
    assert checks["dates_parseable"] is False and checks["transaction_ids_unique"] is True


def test_key_uniqueness_null_semantics(spark):
    df = spark.createDataFrame([(None,), ("a",), ("b",)], "transaction_id string")
    r = Q.key_uniqueness(df).first()
    assert (r["null_keys"], r["distinct_keys"], r["duplicate_keys"]) == (1, 3, 0)
    df2 = spark.createDataFrame([(None,), (None,), ("a",)], "transaction_id string")
    assert Q.key_uniqueness(df2).first()["duplicate_keys"] == 1


def test_full_duplicates_and_table_diff(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    assert Q.full_duplicates(df).first()[0] == 1
    other = spark.createDataFrame([("a", 1), ("b", 3)], "k string, v int")
    d = {(r["k"], r["v"], r["side"]) for r in Q.table_diff(df, other).collect()}
    assert d == {("a", "1", "left_only"), ("b", "2", "left_only"), ("b", "3", "right_only")}


def test_write_clean_partitioned(spark, raw_df, tmp_path):
    df = C.clean(raw_df([_row("a"), _row("b", date="2024-02-01")]))
    out = str(tmp_path / "clean")
    FS.write_clean(df, out)
    back = FS.read_clean(spark, out)
    assert back.where(F.col("month") == 2).count() == 1
    assert back.columns == df.columns


def test_transformation_counts(spark, raw_df):
    rows = [_row("a"), _row("b", price="", total="7.5", qty="3"), _row("c", disc="maybe"), _row("d", disc=""),
            _row("e", qty="x", total="")]
    tc = {r["rule"]: r["n"] for r in C.transformation_counts(None, C.clean(raw_df(rows), keep_internal=True)).collect()}
    assert tc["rows"] == 5 and tc["price_derived"] == 1 and tc["discount_unexpected"] == 1
    assert tc["discount_missing"] == 1 and tc["invalid_quantity"] == 1 and tc["discount_unknown"] == 2


def test_run_all_writes_every_report(spark, raw_df, tmp_path):
    import os

    from tallyspark.plans.run import run_all
    rows = [(f"t{i}", f"CUST_{i % 5}", f"C{i % 3}", "" if i % 7 == 0 else f"I{i % 4}", f"{1 + i % 4}.5", str(1 + i % 3),
             f"{(1 + i % 4 + 0.5) * (1 + i % 3)}", ["Cash", "Credit Card"][i % 2], ["Online", "In-store"][i % 2],
             f"2024-{1 + i % 6:02d}-{1 + i % 27:02d}", ["True", "False", ""][i % 3]) for i in range(120)]
    out = run_all(spark, raw_df(rows), str(tmp_path / "run"), reps=50, with_model=False)
    assert spark.read.parquet(out).count() == 120
    for sub in ["cleaning_log/transformations", "validation/checks", "reports/monthly_channel", "statistics/tests",
                "statistics/cluster_bootstrap", "dashboard/cube_json"]:
        assert os.path.isdir(str(tmp_path / "run" / sub))
    assert spark.read.json(str(tmp_path / "run" / "statistics/tests")).count() == 12
