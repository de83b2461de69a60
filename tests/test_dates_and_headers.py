"""Bad dates give null or false instead of an error; the header of every raw file is checked."""

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.calendar import month_key
from tallyspark.operators import dashboard, quality, reports, stats
from tallyspark.schema import DISPLAY_NAMES, RAW_COLUMNS
from tallyspark.sources import files as FS

ROWS = [("2024-01-05", 0.125, "a"), ("2024-01-31", 2.0, "a"), ("2024-02-10", 8.0, "b"), ("garbage", 16.0, "b"), (None, 32.0, "a"), ("2024-13-40", 64.0, "a")]


@pytest.fixture(scope="module")
def dated(spark):
    return spark.createDataFrame(ROWS, "transaction_date string, total_spent double, category string")


def test_bad_dates(dated):
    assert [r[0] for r in dated.select(month_key(F.col("transaction_date"))).collect()] == ["2024-01", "2024-01", "2024-02", None, None, None]
    assert dashboard.last_date_info(dated).first()["last_month"] == "2024-02"
    assert quality.date_range(dated).first()["unique_days"] == 3


def test_partial_last_month_is_left_out(dated):
    assert {r["transaction_date"] for r in stats.complete_month_rows(dated).collect()} == {"2024-01-05", "2024-01-31", "garbage", None, "2024-13-40"}
    full = dated.where("transaction_date < '2024-02'")
    assert reports.headline_totals(full).first()["records"] == 2
    assert reports.headline_totals(dated.where("transaction_date like '2024-0%'")).first()["records"] == 2
    assert {r["category"] for r in reports.category_summary(dated.where("transaction_date like '2024-0%'")).collect()} == {"a"}


def test_swapped_second_file(spark, raw_df, tmp_path):
    row = tuple(str(i) for i in range(len(RAW_COLUMNS)))
    names = [DISPLAY_NAMES[c] for c in RAW_COLUMNS]
    swapped = [*names[:4], names[5], names[4], *names[6:]]
    (tmp_path / "a.csv").write_text(",".join(names) + "\n" + ",".join(row) + "\n")
    assert FS.read_raw_csv(spark, str(tmp_path)).count() == 1
    (tmp_path / "b.csv").write_text(",".join(swapped) + "\n" + ",".join(row) + "\n")
    with pytest.raises(Exception):
        FS.read_raw_csv(spark, str(tmp_path)).collect()
