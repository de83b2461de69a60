"""Micro-fixtures for the row-local cleaning rules (one hand-written row per case)."""

import datetime

from pyspark.sql import functions as F

from tallyspark.functions import text as X
from tallyspark.operators import cleaning as C


def one_col(spark, values, expr):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return [r[0] for r in df.select(expr(F.col("s"))).collect()]


def test_null_tokens_are_case_sensitive(spark):
    vals = ["", " ", "nan", "null", "none", "NaN", "NULL", None, "x"]
    assert one_col(spark, vals, X.clean_text) == [None, None, None, None, None, "NaN", "NULL", None, "x"]
    assert one_col(spark, ["NaN", "NULL"], lambda c: X.clean_text(c, case_insensitive=True)) == [None, None]


def test_whitespace_collapse_unicode(spark):
    vals = ["  a  b ", "a\tb", "a b", "a  b", "\u001ca\u001f"]
    assert one_col(spark, vals, X.strip_text) == ["a b", "a b", "a b", "a b", "a"]


def test_number_parse(spark):
    vals = ["1.5", " 1.5 ", "1e3", "+5", ".5", "5.", "1,000", "1_000", "0x10", "1d", "NaN", "abc", ""]
    got = one_col(spark, vals, X.parse_number)
    assert got == [1.5, 1.5, 1000.0, 5.0, 0.5, 5.0, None, None, None, None, None, None, None]
    bad = one_col(spark, vals, X.invalid_number)
    assert bad == [False] * 6 + [True] * 6 + [False]


def test_date_parse(spark):
    vals = ["2024-01-05", "2024-1-5", "2024-02-30", "2024-01-01 00:00:00", "20240101", "", None]
    got = one_col(spark, vals, X.parse_iso_date)
    d = datetime.date
    assert got == [d(2024, 1, 5), d(2024, 1, 5), None, None, None, None, None]


def test_discount_codes(spark):
    vals = ["True", "yes", "1", "FALSE", "no", "0", "", "maybe", None]
    assert one_col(spark, vals, X.discount_code) == ["Yes"] * 3 + ["No"] * 3 + ["Unknown"] * 3
    assert one_col(spark, ["", "maybe", "True"], X.discount_outcome) == ["missing", "unexpected", "mapped"]


def _row(tid, cat="C", item="I1", price="2.5", qty="2", total="5.0", date="2024-01-31", disc="True"):
    return (tid, "CUST_1", cat, item, price, qty, total, "Cash", "Online", date, disc)


def test_derive_price_and_item_map(spark, raw_df):
    rows = [
        _row("a"),                                   # recorded pair (C, 2.5) -> I1
        _row("b", price="", total="7.5", qty="3"),   # derived 2.5, item present
        _row("c", item="", price="", total="10", qty="4"),  # derived 2.5 -> impute I1
        _row("d", item="", price="", total="10", qty="0"),  # qty 0: no derivation
        _row("e", cat="D", item="I2", price="3"),
        _row("f", cat="D", item="I3", price="3"),    # (D, 3) ambiguous
        _row("g", cat="D", item="", price="3"),      # not imputed
        _row("h", cat="", item="", price="2.5"),     # null category never matches
        _row("i", item="", price="", total="7", qty="3"),   # 7/3 has no recorded pair
    ]
    out = {r["transaction_id"]: r for r in C.clean(raw_df(rows), quantity_mode="auto").collect()}
    assert out["b"]["price_imputed"] == "Yes" and out["b"]["price_per_unit"] == 2.5
    assert out["c"]["item"] == "I1" and out["c"]["item_imputed"] == "Yes"
    assert out["d"]["price_per_unit"] is None and out["d"]["price_imputed"] == "No"
    assert out["g"]["item"] is None and out["g"]["item_imputed"] == "No"
    assert out["h"]["item"] is None
    assert out["i"]["item"] is None and out["i"]["price_imputed"] == "Yes"
    assert isinstance(out["a"]["quantity"], int)
    assert out["d"]["missing_pattern"] == "Item, Price Per Unit"
    assert out["a"]["missing_pattern"] == "Complete"
    assert out["a"]["quarter"] == "Q1" and out["a"]["weekday"] == "Wednesday" and out["a"]["month_name"] == "January"


def test_strict_derivation_requires_positive(spark, raw_df):
    rows = [_row("a", price="", total="-5", qty="2"), _row("b", price="", total="5", qty="2")]
    df = C.derive_price(C.parse_raw(raw_df(rows)), strict=True)
    got = {r["transaction_id"]: r["price_imputed"] for r in df.collect()}
    assert got == {"a": "No", "b": "Yes"}


def test_arithmetic_flag(spark, raw_df):
    rows = [_row("ok"), _row("off", total="5.01"), _row("tiny", total="5.0000000001"), _row("na", total="")]
    got = {r["transaction_id"]: r["arithmetic_issue"] for r in C.clean(raw_df(rows)).collect()}
    assert got == {"ok": "No", "off": "Yes", "tiny": "No", "na": "No"}


def test_quantity_not_whole_keeps_double(spark, raw_df):
    rows = [_row("a", qty="2"), _row("b", qty="2.5", total="6.25")]
    df = C.clean(raw_df(rows))
    assert dict(df.dtypes)["quantity"] == "double"
    assert C.quantity_is_whole(C.parse_raw(raw_df(rows))).first()["non_integer_quantities"] == 1


def test_iqr_flags_inclusive_bounds(spark, raw_df):
    totals = ["1", "2", "3", "4", "100"]
    rows = [_row(str(i), price="", qty="1", total=t) for i, t in enumerate(totals)]
    b = C.iqr_bounds(C.parse_raw(raw_df(rows))).first()
    assert (b["q1"], b["q3"]) == (2.0, 4.0) and (b["lower_bound"], b["upper_bound"]) == (-1.0, 7.0)
    flags = {r["total_spent"]: r["total_outlier_iqr"] for r in C.clean(raw_df(rows)).collect()}
    assert flags == {1.0: "No", 2.0: "No", 3.0: "No", 4.0: "No", 100.0: "Yes"}


def test_no_row_is_deleted(spark, raw_df):
    rows = [_row(str(i), item="" if i % 2 else "I1") for i in range(20)]
    assert C.clean(raw_df(rows)).count() == 20
