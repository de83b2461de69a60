"""Column contracts of the raw and the cleaned transaction tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Source column order (display names) of the raw file.
SOURCE_COLUMNS = [
    "Transaction ID", "Customer ID", "Category", "Item", "Price Per Unit",
    "Quantity", "Total Spent", "Payment Method", "Location",
    "Transaction Date", "Discount Applied",
]

# Audit columns appended by cleaning, in output order.
AUDIT_COLUMNS = [
    "Year", "Month", "Month Name", "Quarter", "Weekday", "Item Imputed",
    "Price Imputed", "Arithmetic Issue", "Total Outlier IQR", "Missing Pattern",
]


def snake(name: str) -> str:
    return name.lower().replace(" ", "_")


RAW_COLUMNS = [snake(c) for c in SOURCE_COLUMNS]
CLEAN_COLUMNS = RAW_COLUMNS + [snake(c) for c in AUDIT_COLUMNS]
DISPLAY_NAMES = {snake(c): c for c in SOURCE_COLUMNS + AUDIT_COLUMNS}

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])

# Internal typed form of the cleaned table (quantity becomes bigint when every
# value is whole; see operators.cleaning.whole_quantity).
CLEAN_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("item", T.StringType()),
    T.StructField("price_per_unit", T.DoubleType()),
    T.StructField("quantity", T.LongType()),
    T.StructField("total_spent", T.DoubleType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("transaction_date", T.StringType()),
    T.StructField("discount_applied", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("month_name", T.StringType()),
    T.StructField("quarter", T.StringType()),
    T.StructField("weekday", T.StringType()),
    T.StructField("item_imputed", T.StringType()),
    T.StructField("price_imputed", T.StringType()),
    T.StructField("arithmetic_issue", T.StringType()),
    T.StructField("total_outlier_iqr", T.StringType()),
    T.StructField("missing_pattern", T.StringType()),
])

TEXT_COLUMNS = ["transaction_id", "customer_id", "category", "item", "payment_method", "location"]
NUMERIC_COLUMNS = ["price_per_unit", "quantity", "total_spent"]
# Fields whose absence (null or "Unknown") is reported in the missing pattern.
ANALYTICAL_FIELDS = ["item", "price_per_unit", "quantity", "total_spent", "discount_applied"]
