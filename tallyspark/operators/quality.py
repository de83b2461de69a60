"""Data-quality profile and pass/fail checks of the cleaned table.

Every counter of a report is one expression inside a single aggregate, so a
report is one scan. Checks are (check, passed) rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.calendar import parsed_date
from tallyspark.functions.numeric import isclose
from tallyspark.functions.text import DISCOUNT_VALUES
from tallyspark.schema import CLEAN_COLUMNS

FLAG_COLUMNS = ["item_imputed", "price_imputed", "total_outlier_iqr"]


def _stack(one: DataFrame, names: list[str], key: str, val: str) -> DataFrame:
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return one.selectExpr(f"stack({len(names)}, {pairs}) as ({key}, {val})")


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, nulls) for every column (E12), one pass."""
    cols = columns or df.columns
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return _stack(one, cols, "column", "nulls")


def raw_missing_counts(raw: DataFrame) -> DataFrame:
    """(column, missing) of the raw table: null or a missing token after stripping."""
    from tallyspark.functions.text import clean_text
    one = raw.agg(*[F.count_if(clean_text(F.col(c)).isNull()).alias(c) for c in raw.columns])
    return _stack(one, raw.columns, "column", "missing")


def cardinality(df: DataFrame, exact: bool = True) -> DataFrame:
    """Distinct customers, categories, items, channels.

    ``exact=False`` uses HyperLogLog sketches (bounded memory per task).
    """
    cd = F.count_distinct if exact else (lambda c: F.approx_count_distinct(c, 0.01))
    return df.agg(cd("customer_id").alias("customers"), cd("category").alias("categories"),
                  cd("item").alias("items"), cd("location").alias("channels"))


def date_range(df: DataFrame) -> DataFrame:
    """First and last date and distinct days."""
    d = parsed_date(F.col("transaction_date"))
    return df.agg(F.date_format(F.min(d), "yyyy-MM-dd").alias("start"),
                  F.date_format(F.max(d), "yyyy-MM-dd").alias("end"),
                  F.count_distinct(d).alias("unique_days"))


def coverage(df: DataFrame) -> DataFrame:
    """Share of rows with a total, with a quantity, with a known discount."""
    return df.agg((F.count("total_spent") / F.count(F.lit(1))).alias("sales"),
                  (F.count("quantity") / F.count(F.lit(1))).alias("quantity"),
                  (F.count_if(F.col("discount_applied") != "Unknown") / F.count(F.lit(1))).alias("discount_known"))


def audit_counts(df: DataFrame) -> DataFrame:
    """Imputation and outlier counters, including rows whose item came from a derived price."""
    y = lambda c: F.col(c) == "Yes"
    return df.agg(F.count_if(y("item_imputed")).alias("item_internally_inferred"),
                  F.count_if(y("price_imputed")).alias("price_target_derived"),
                  F.count_if(y("item_imputed") & y("price_imputed")).alias("target_derived_item_rows"),
                  F.count_if(y("total_outlier_iqr")).alias("high_value_iqr_flags"))


def key_uniqueness(df: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Rows, null keys, distinct keys and duplicate keys.

    Null counts as one value for uniqueness (a single null passes, two fail).
    """
    g = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(key).isNull()).alias("null_keys"),
               F.count_distinct(key).alias("_d"))
    distinct_keys = F.col("_d") + F.when(F.col("null_keys") > 0, 1).otherwise(0)
    return g.select("rows", "null_keys", distinct_keys.alias("distinct_keys"),
                    (F.col("rows") - distinct_keys).alias("duplicate_keys"))


def full_duplicates(df: DataFrame) -> DataFrame:
    """Σ(n - 1) over groups of identical rows.

    Only a row hash is shuffled for all rows. Rows whose hash occurs once have no
    duplicate; the others are compared in all columns, so the result is exact.
    """
    # A null hashes like an absent column, so each value is marked as present or not.
    marked = [x for c in df.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    h = "_hash"
    while h in (c.lower() for c in df.columns):
        h = "_" + h
    hashed = df.withColumn(h, F.xxhash64(*marked))
    repeated = hashed.groupBy(h).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(h)
    g = hashed.join(repeated, h, "left_semi").groupBy(*[f"`{c}`" for c in df.columns]).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("full_duplicate_rows"))


def validate_checks(df: DataFrame, expected_columns: list[str] | None = None) -> DataFrame:
    """(check, passed) rows for the eight table checks (J1-J8, E25), one scan."""
    expected = expected_columns or CLEAN_COLUMNS
    p, q, t = F.col("price_per_unit"), F.col("quantity"), F.col("total_spent")
    complete = p.isNotNull() & q.isNotNull() & t.isNotNull()
    flags_ok = F.lit(True)
    for c in FLAG_COLUMNS:
        flags_ok = flags_ok & F.coalesce(F.col(c).isin("Yes", "No"), F.lit(False))
    one = df.agg(
        (F.count_if(F.col("transaction_id").isNull()) == 0).alias("transaction_ids_complete"),
        (F.count(F.lit(1)) == F.count_distinct("transaction_id")
         + F.when(F.count_if(F.col("transaction_id").isNull()) > 0, 1).otherwise(0)).alias("transaction_ids_unique"),
        (F.count_if(parsed_date(F.col("transaction_date")).isNull()) == 0).alias("dates_parseable"),
        (F.count_if(~F.coalesce(F.col("discount_applied").isin(DISCOUNT_VALUES), F.lit(False))) == 0)
        .alias("discount_values_valid"),
        (F.count_if(complete & ~isclose(p * q, t)) == 0).alias("arithmetic_identity_holds_for_complete_rows"),
        (F.count_if(q.isNull() != t.isNull()) == 0).alias("quantity_and_total_missingness_identical"),
        (F.count_if(~flags_ok) == 0).alias("audit_flags_valid"))
    names = ["transaction_ids_complete", "transaction_ids_unique", "dates_parseable", "discount_values_valid",
             "arithmetic_identity_holds_for_complete_rows", "quantity_and_total_missingness_identical",
             "audit_flags_valid"]
    cols_ok = F.lit(list(df.columns) == list(expected))
    one = one.withColumn("expected_columns", cols_ok)
    return _stack(one, ["expected_columns"] + names, "check", "passed")


def validate_or_raise(df: DataFrame) -> list[tuple[str, bool]]:
    """Run the checks (<= 8 booleans reach the driver) and raise if any fails."""
    rows = [(r["check"], bool(r["passed"])) for r in validate_checks(df).collect()]
    failed = [c for c, ok in rows if not ok]
    if failed:
        raise AssertionError(f"Validation failed: {failed}")
    return rows


def quality_summary(df: DataFrame) -> DataFrame:
    """One-row profile: shape, date range, cardinality, coverage, audit counts (J12), one scan."""
    d = parsed_date(F.col("transaction_date"))
    y = lambda c: F.col(c) == "Yes"
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("rows"), F.lit(len(df.columns)).alias("columns"),
        F.date_format(F.min(d), "yyyy-MM-dd").alias("start"), F.date_format(F.max(d), "yyyy-MM-dd").alias("end"),
        F.count_distinct(d).alias("unique_days"),
        F.count_distinct("customer_id").alias("customers"), F.count_distinct("category").alias("categories"),
        F.count_distinct("item").alias("items"), F.count_distinct("location").alias("channels"),
        (F.count("total_spent") / n).alias("sales_coverage"), (F.count("quantity") / n).alias("quantity_coverage"),
        (F.count_if(F.col("discount_applied") != "Unknown") / n).alias("discount_known"),
        F.count_if(y("item_imputed")).alias("item_internally_inferred"),
        F.count_if(y("price_imputed")).alias("price_target_derived"),
        F.count_if(y("item_imputed") & y("price_imputed")).alias("target_derived_item_rows"),
        F.count_if(y("total_outlier_iqr")).alias("high_value_iqr_flags"))


def row_accounting(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Rows and columns before/after cleaning and rows deleted."""
    a = raw.agg(F.count(F.lit(1)).alias("rows_before"))
    b = cleaned.agg(F.count(F.lit(1)).alias("rows_after"))
    return a.crossJoin(b).select("rows_before", "rows_after",
                                 (F.col("rows_before") - F.col("rows_after")).alias("rows_deleted"),
                                 F.lit(len(raw.columns)).alias("columns_before"),
                                 F.lit(len(cleaned.columns)).alias("columns_after"))


def table_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a not in b and of b not in a, values compared as text, multiplicity kept (G9); see ``operators.difference``."""
    from tallyspark.operators.difference import table_difference
    ta, tb = (df.select([F.col(c).cast("string").alias(c) for c in a.columns]) for df in (a, b))
    diff = table_difference(ta, tb, a.columns[:1])
    return diff.select(*a.columns, "side", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")
