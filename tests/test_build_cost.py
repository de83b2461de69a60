"""What the shared steps do once per row, per day or per hash and not more often."""

import datetime

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.calendar import calendar_columns, iso_text
from tallyspark.operators import checked as K
from tallyspark.operators import cleaning as C
from tallyspark.operators import quality as Q
from tallyspark.operators import stats as ST
from tallyspark.operators.difference import differing_ranges
from tallyspark.operators.selection import quantiles
from tallyspark.schema import RAW_SCHEMA


def plan(df):
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "1000")
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_missing_pattern_makes_no_text_of_numbers(spark):
    df = spark.createDataFrame([(None, 1.5, None, 2.0, "Unknown"), ("i", 1.0, 1.0, 1.0, "Yes")],
                               "item string, price_per_unit double, quantity double, total_spent double, discount_applied string")
    out = df.select(C.missing_pattern_expr().alias("m"))
    assert "cast(" not in plan(out)
    assert [r["m"] for r in out.collect()] == ["Item, Quantity, Discount Applied", "Complete"]


def test_calendar_names_without_formatter(spark):
    days = [None, *[datetime.date(2024, m, 27 - m) for m in range(1, 13)], datetime.date(1, 1, 1)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    out = df.select(*[c.alias(n) for n, c in calendar_columns(F.col("d")).items()])
    assert "date_format" not in plan(out)
    want = df.select(F.date_format("d", "MMMM"), F.date_format("d", "EEEE"), F.date_format("d", "yyyy-MM-dd"))
    got = df.select(calendar_columns(F.col("d"))["month_name"], calendar_columns(F.col("d"))["weekday"], iso_text(F.col("d")))
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


def test_item_map_is_made_from_distinct_rows(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", 1.0, "x"), ("a", 2.0, "x"), ("a", 2.0, "y"), (None, 1.0, "x"), ("b", None, "x")],
                               "category string, price_per_unit double, item string")
    out = C.item_map(df)
    assert plan(out).count("Aggregate") == 2
    assert [(r["category"], float(r["_pkey"]), r["_map_item"]) for r in out.collect()] == [("a", 1.0, "x")]


def test_quantiles_without_groups_join_nothing(spark, monkeypatch):
    df = spark.range(20_001).selectExpr("cast(id * id AS double) AS v")
    monkeypatch.setattr(DataFrame, "join", lambda *a, **k: pytest.fail("rows are joined with intervals"))
    got = {r["p"]: r["q"] for r in quantiles(df, "v", [0.0, 0.25, 0.5, 1.0]).collect()}
    assert got == {0.0: 0.0, 0.25: 5000.0 ** 2, 0.5: 10_000.0 ** 2, 1.0: 20_000.0 ** 2}


def test_monthly_trend_parses_each_date_once(spark, monkeypatch):
    rows = [(f"2024-{m:02d}-0{d}", float(m * d)) for m in range(1, 7) for d in (1, 2) for _ in range(20)] + [(None, 5.0), ("2024-02-01", None)]
    df = spark.createDataFrame(rows, "transaction_date string, total_spent double")
    seen, real = [], ST.complete_month_rows
    monkeypatch.setattr(ST, "complete_month_rows", lambda d: seen.append(d.count()) or real(d))
    r = ST.monthly_trend_spearman(df).first()
    assert seen == [12] and (r["n_months"], r["statistic"]) == (5, 1.0)


def test_difference_sums_hashes_without_decimals(spark):
    a = spark.createDataFrame([(i % 5, None if i % 3 else "x") for i in range(50)], "k int, v string")
    assert "decimal" not in plan(differing_ranges(a, a, ["k"]))
    assert differing_ranges(a, a.repartition(3), ["k"]).count() == 0
    assert differing_ranges(a, a.where("k <> 4").union(a.where("k = 4").selectExpr("k", "coalesce(v, 'y')")), ["k"]).count() == 1


def test_full_duplicates_shuffle_hashes_and_compare_rows(spark, monkeypatch):
    df = spark.createDataFrame([("a", None), ("a", None), (None, "a"), (None, "a"), (None, "a"), ("b", "c")], "x string, y string")
    assert "left_semi" in plan(Q.full_duplicates(df)).lower().replace("leftsemi", "left_semi")
    assert Q.full_duplicates(df).first()[0] == 3
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(1).cast("long"))  # all hashes collide
    assert Q.full_duplicates(df).first()[0] == 3


def test_audit_marks_strip_each_column_once(spark):
    raw = spark.createDataFrame([(" a", "c", "nan", "i", "1", "1", "1", "Cash", "x  y", "2024-01-01", " YES ")], RAW_SCHEMA)
    out = C.parse_raw(raw, marks=K.audit_marks())
    assert plan(out).count("[^!-~]") == 11
    r = out.first()
    assert (r["_missing"], r["_spaced"], r["_spelling"]) == (1 << 2, (1 << 0) + (1 << 5), "YES")
