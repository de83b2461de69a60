"""Registry of queries (Spark) and their oracles (DuckDB SQL).

Every query reads the driver tables of ``sf_dir`` through the raw adapter,
cleans them, and runs one operator; nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import text as X
from tallyspark.functions.calendar import calendar_columns
from tallyspark.operators import cleaning as C
from tallyspark.operators import cube_store as CS
from tallyspark.operators import dashboard as D
from tallyspark.operators import quality as Q
from tallyspark.operators import reports as R
from tallyspark.operators.ordering import with_position
from tallyspark.plans import sqltext as S
from tallyspark.plans.sqltext import with_clean
from tallyspark.sources.adapter import RAW_SQL, retail_raw

_Q: dict = {}
_SQL: dict = {}

# Fixed query parameters for the registered dashboard queries (present months
# of the driver data, which spans 1995-01 .. 2001-11).
KPI_START, KPI_END = "1999-01", "1999-12"
KPI_CATEGORY = "Brand#13"


def register(key: str, sql: str | None = None):
    def deco(fn):
        _Q[key] = fn
        if sql is not None:
            _SQL[key] = sql
        return fn
    return deco


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.session import tune_session
    tune_session(spark)
    return retail_raw(spark, sf_dir)


def cleaned(spark: SparkSession, sf_dir: str, keep_internal: bool = False) -> DataFrame:
    """Cleaned table of the driver tables in ``sf_dir``.

    Built once per input fingerprint (with the audit helper columns) and
    written to the shared checkpoint folder; reports read that table.
    Quantity is kept as double (the whole-number cast only changes the type).
    """
    from tallyspark.session import tune_session
    tune_session(spark)
    if getattr(spark, "_jvm", None) is None:  # Spark Connect: no file-system gateway, plan lazily
        full = C.clean(retail_raw(spark, sf_dir), keep_internal=True, quantity_mode=False)
    else:
        full = spark.read.parquet(_clean_folder(spark, sf_dir))
    return full if keep_internal else full.select(*C.CLEAN_COLUMNS)


def _clean_folder(spark: SparkSession, sf_dir: str) -> str:
    from tallyspark.plans.materialize import materialized_path
    from tallyspark.sources.adapter import TABLES
    inputs = [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in TABLES]
    return materialized_path(spark, "clean_internal", inputs,
                             lambda path: C.write_clean_table(retail_raw(spark, sf_dir), path, keep_internal=True, quantity_mode=False))


def cube_store(spark: SparkSession, sf_dir: str) -> str:
    """The maintained cube of the cleaned table, brought up to date (a comparison of file lists if nothing changed)."""
    folder = _clean_folder(spark, sf_dir)
    store = f"{folder}-cube"
    CS.update(spark, folder, store)
    return store


def cube(spark, sf_dir):
    if getattr(spark, "_jvm", None) is None:
        return D.build_cube(cleaned(spark, sf_dir))
    return CS.read_cube(spark, cube_store(spark, sf_dir))


def last_date(spark, sf_dir):
    if getattr(spark, "_jvm", None) is None:
        return D.last_date_info(cleaned(spark, sf_dir))
    return CS.last_date_info(spark, cube_store(spark, sf_dir))


def M(c: str) -> str:
    """DuckDB exact money sum as double."""
    return f"CAST(SUM(CAST({c} AS DECIMAL(28,6))) AS DOUBLE)"


def CNT(cond: str) -> str:
    return f"COUNT(*) FILTER (WHERE {cond})"


# ----------------------------------------------------------------- sources ---

@register("scan_raw", RAW_SQL)
def q_scan_raw(spark, sf_dir):
    return raw(spark, sf_dir)


@register("scan_clean", with_clean("SELECT * EXCLUDE (quantity), CAST(quantity AS DOUBLE) AS quantity FROM clean"))
def q_scan_clean(spark, sf_dir):
    return cleaned(spark, sf_dir)


@register("clean_from_raw", with_clean("SELECT * FROM clean"))
def q_clean_from_raw(spark, sf_dir):
    """The full cleaning plan from the raw tables (not the written table); quantity type decided from the data."""
    return C.clean(retail_raw(spark, sf_dir))


@register("content_fingerprint", f"""
SELECT count(*) AS rows, CAST(sum(('0x' || substr(h, 1, 15))::BIGINT::HUGEINT) AS VARCHAR) AS bag_hash,
       CAST(sum(('0x' || substr(h, 16, 15))::BIGINT::HUGEINT) AS VARCHAR) AS bag_hash_2
FROM (SELECT md5(concat_ws(chr(31), {", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in C.RAW_COLUMNS)})) AS h FROM ({RAW_SQL}))""")
def q_content_fingerprint(spark, sf_dir):
    from tallyspark.sources.files import content_fingerprint
    return content_fingerprint(raw(spark, sf_dir))


@register("cube_json")
def q_cube_json(spark, sf_dir):
    return D.cube_json(cube(spark, sf_dir))


# ------------------------------------------------------ row-level cleaning ---

_TXT = ", ".join(f"{S.strip(c)} AS {c}" for c in S.TEXT)


@register("normalize_text", f"SELECT {_TXT} FROM ({RAW_SQL})")
def q_normalize_text(spark, sf_dir):
    r = raw(spark, sf_dir)
    return r.select([X.strip_text(F.col(c)).alias(c) for c in S.TEXT])


_TOK = ", ".join(f"{S.tok(S.strip(c))} AS {c}" for c in S.TEXT)


@register("null_tokens", f"SELECT {_TOK} FROM ({RAW_SQL})")
def q_null_tokens(spark, sf_dir):
    r = raw(spark, sf_dir)
    return r.select([X.clean_text(F.col(c)).alias(c) for c in S.TEXT])


_NUMS = ", ".join(f"{S.num(S.tok(S.strip(c)))} AS {c}" for c in S.NUMS)


@register("parse_numeric", f"SELECT {S.strip('transaction_id')} AS transaction_id, {_NUMS} FROM ({RAW_SQL})")
def q_parse_numeric(spark, sf_dir):
    p = C.parse_raw(raw(spark, sf_dir))
    return p.select("transaction_id", *S.NUMS)


@register("invalid_numeric_counts", with_clean(
    "SELECT " + ", ".join(f"{CNT('bad_' + c)} AS {c}" for c in S.NUMS) + " FROM cleanx"))
def q_invalid_numeric_counts(spark, sf_dir):
    p = C.parse_raw(raw(spark, sf_dir))
    return p.agg(*[F.count_if(f"_bad_{c}").alias(c) for c in S.NUMS])


@register("parse_date", with_clean(
    f"SELECT transaction_id, d AS parsed_date, (SELECT {CNT('d IS NULL')} FROM cleanx) AS invalid_dates FROM cleanx"))
def q_parse_date(spark, sf_dir):
    p = C.parse_raw(raw(spark, sf_dir))
    bad = p.agg(F.count_if(F.col("_date").isNull()).alias("invalid_dates"))
    return p.select("transaction_id", F.col("_date").alias("parsed_date")).crossJoin(F.broadcast(bad))


@register("date_iso", with_clean("SELECT transaction_id, transaction_date FROM clean"))
def q_date_iso(spark, sf_dir):
    return C.parse_raw(raw(spark, sf_dir)).select("transaction_id", "transaction_date")


@register("standardize_discount", with_clean("SELECT transaction_id, discount_applied, discount_outcome FROM cleanx"))
def q_standardize_discount(spark, sf_dir):
    return C.parse_raw(raw(spark, sf_dir)).select("transaction_id", "discount_applied",
                                                  F.col("_discount_outcome").alias("discount_outcome"))


@register("derive_price", with_clean("SELECT transaction_id, price_per_unit, price_imputed FROM clean"))
def q_derive_price(spark, sf_dir):
    return C.derive_price(C.parse_raw(raw(spark, sf_dir))).select("transaction_id", "price_per_unit", "price_imputed")


_STRICT = """
SELECT transaction_id,
       CASE WHEN m THEN total_spent / quantity ELSE price_per_unit END AS price_per_unit,
       CASE WHEN m THEN 'Yes' ELSE 'No' END AS price_imputed
FROM (SELECT *, (price_per_unit IS NULL AND quantity IS NOT NULL AND quantity <> 0 AND total_spent IS NOT NULL
                 AND total_spent / quantity > 0
                 AND abs(total_spent / quantity * quantity - total_spent)
                     <= greatest(1e-9 * greatest(abs(total_spent / quantity * quantity), abs(total_spent)), 1e-9)) AS m
      FROM parsed)"""


@register("derive_price_strict", with_clean(_STRICT))
def q_derive_price_strict(spark, sf_dir):
    return (C.derive_price(C.parse_raw(raw(spark, sf_dir)), strict=True)
             .select("transaction_id", "price_per_unit", "price_imputed"))


@register("item_category_price_map", with_clean(
    "SELECT category, CAST(pkey AS DOUBLE) AS price_key, map_item AS item FROM itemmap"))
def q_item_map(spark, sf_dir):
    p = C.derive_price(C.parse_raw(raw(spark, sf_dir)))
    return C.item_map(p).select("category", F.col("_pkey").cast("double").alias("price_key"),
                                F.col("_map_item").alias("item"))


@register("impute_item", with_clean("SELECT transaction_id, item, item_imputed FROM clean"))
def q_impute_item(spark, sf_dir):
    return cleaned(spark, sf_dir).select("transaction_id", "item", "item_imputed")


@register("item_price_map", with_clean("""
SELECT item, min(price_recorded) AS price FROM cleanx
WHERE item IS NOT NULL AND price_recorded IS NOT NULL AND item_imputed = 'No'
GROUP BY item HAVING count(DISTINCT TRY_CAST(price_recorded AS DECIMAL(18,6))) = 1"""))
def q_item_price_map(spark, sf_dir):
    return C.item_price_map(C.derive_price(C.parse_raw(raw(spark, sf_dir))))


@register("arithmetic_issue", with_clean("SELECT transaction_id, arithmetic_issue FROM clean"))
def q_arithmetic_issue(spark, sf_dir):
    return cleaned(spark, sf_dir).select("transaction_id", "arithmetic_issue")


@register("quantity_whole", with_clean(f"""
SELECT coalesce(bool_and(abs(quantity - floor(quantity)) <= 1e-8), true) AS quantity_whole,
       {CNT('abs(quantity - floor(quantity)) > 1e-8')} AS non_integer_quantities
FROM parsed WHERE quantity IS NOT NULL"""))
def q_quantity_whole(spark, sf_dir):
    return C.quantity_is_whole(C.parse_raw(raw(spark, sf_dir)))


@register("calendar_parts", with_clean(
    "SELECT transaction_id, year, month, month_name, quarter, weekday FROM clean"))
def q_calendar_parts(spark, sf_dir):
    p = C.parse_raw(raw(spark, sf_dir))
    return p.select("transaction_id", *[c.alias(n) for n, c in calendar_columns(F.col("_date")).items()])


@register("outlier_iqr", with_clean(f"""
SELECT b.q1, b.q3, b.lower_bound, b.upper_bound,
       (SELECT {CNT("total_outlier_iqr = 'Yes'")} FROM clean) AS flagged_rows FROM bounds b"""))
def q_outlier_iqr(spark, sf_dir):
    df = cleaned(spark, sf_dir, keep_internal=True)
    flagged = df.agg(F.count_if(F.col("total_outlier_iqr") == "Yes").alias("flagged_rows"))
    return C.iqr_bounds(C.parse_raw(raw(spark, sf_dir))).crossJoin(flagged)


@register("outlier_flags", with_clean("SELECT transaction_id, total_spent, total_outlier_iqr FROM clean"))
def q_outlier_flags(spark, sf_dir):
    return cleaned(spark, sf_dir).select("transaction_id", "total_spent", "total_outlier_iqr")


@register("missing_pattern", with_clean("SELECT transaction_id, missing_pattern FROM clean"))
def q_missing_pattern(spark, sf_dir):
    return cleaned(spark, sf_dir).select("transaction_id", "missing_pattern")


@register("missing_label", with_clean(
    "SELECT transaction_id, CASE WHEN total_spent IS NULL THEN 'Missing' ELSE 'Present' END AS missing_total FROM clean"))
def q_missing_label(spark, sf_dir):
    return cleaned(spark, sf_dir).select(
        "transaction_id", F.when(F.col("total_spent").isNull(), "Missing").otherwise("Present").alias("missing_total"))


@register("month_key", with_clean("SELECT transaction_id, substr(transaction_date, 1, 7) AS month FROM clean"))
def q_month_key(spark, sf_dir):
    from tallyspark.functions.calendar import month_key
    return cleaned(spark, sf_dir).select("transaction_id", month_key(F.col("transaction_date")).alias("month"))


@register("last_month_complete", with_clean("""
SELECT strftime(max(d), '%Y-%m-%d') AS last_date, strftime(max(d), '%Y-%m') AS last_month,
       last_day(max(d)) = max(d) AS last_month_complete FROM cleanx"""))
def q_last_month_complete(spark, sf_dir):
    info = D.last_date_info(cleaned(spark, sf_dir))
    return info.select(F.date_format("last_date", "yyyy-MM-dd").alias("last_date"), "last_month",
                       "last_month_complete")


_TC = f"""
SELECT * FROM (SELECT
  COUNT(*) AS rows,
  {CNT('bad_price_per_unit')} AS invalid_price_per_unit,
  {CNT('bad_quantity')} AS invalid_quantity,
  {CNT('bad_total_spent')} AS invalid_total_spent,
  {CNT('d IS NULL')} AS invalid_dates,
  {CNT("price_imputed = 'Yes'")} AS price_derived,
  {CNT("item_imputed = 'Yes'")} AS item_inferred,
  {CNT("discount_applied = 'Unknown'")} AS discount_unknown,
  {CNT("discount_outcome = 'missing'")} AS discount_missing,
  {CNT("discount_outcome = 'unexpected'")} AS discount_unexpected,
  {CNT("arithmetic_issue = 'Yes'")} AS arithmetic_issues,
  {CNT("total_outlier_iqr = 'Yes'")} AS iqr_flagged
FROM cleanx) UNPIVOT (n FOR rule IN (rows, invalid_price_per_unit, invalid_quantity, invalid_total_spent,
  invalid_dates, price_derived, item_inferred, discount_unknown, discount_missing, discount_unexpected,
  arithmetic_issues, iqr_flagged))"""


@register("transformation_counts", with_clean(_TC))
def q_transformation_counts(spark, sf_dir):
    return C.transformation_counts(None, cleaned(spark, sf_dir, keep_internal=True))


@register("mask_imputed_items", with_clean(f"""
SELECT transaction_id, CASE WHEN item_imputed = 'Yes' THEN '{C.MASKED_ITEM}' ELSE item END AS item
FROM clean WHERE total_spent IS NOT NULL"""))
def q_mask_imputed_items(spark, sf_dir):
    df = cleaned(spark, sf_dir).where(F.col("total_spent").isNotNull())
    return df.select("transaction_id", F.when(F.col("item_imputed") == "Yes", F.lit(C.MASKED_ITEM))
                     .otherwise(F.col("item")).alias("item"))


@register("complete_cases", with_clean(
    "SELECT transaction_id, price_per_unit, CAST(quantity AS DOUBLE) AS quantity FROM clean "
    "WHERE price_per_unit IS NOT NULL AND quantity IS NOT NULL"))
def q_complete_cases(spark, sf_dir):
    return cleaned(spark, sf_dir).na.drop(subset=["price_per_unit", "quantity"]).select(
        "transaction_id", "price_per_unit", "quantity")


@register("known_discount", with_clean(
    "SELECT transaction_id, discount_applied, total_spent FROM clean "
    "WHERE discount_applied IN ('Yes', 'No') AND total_spent IS NOT NULL"))
def q_known_discount(spark, sf_dir):
    return (cleaned(spark, sf_dir).where(F.col("discount_applied").isin("Yes", "No") & F.col("total_spent").isNotNull())
            .select("transaction_id", "discount_applied", "total_spent"))


@register("exclude_partial_month", with_clean("""
SELECT c.transaction_id, c.transaction_date FROM clean c,
  (SELECT strftime(max(d), '%Y-%m') AS lm, last_day(max(d)) = max(d) AS complete FROM cleanx) l
WHERE l.complete OR substr(c.transaction_date, 1, 7) <> l.lm"""))
def q_exclude_partial_month(spark, sf_dir):
    from tallyspark.operators.stats import complete_month_rows
    return complete_month_rows(cleaned(spark, sf_dir)).select("transaction_id", "transaction_date")


# ------------------------------------------------------------- SQL reports ---

_MONTHLY = with_clean(f"""
SELECT substr(transaction_date, 1, 7) AS sales_month, location AS channel, COUNT(*) AS total_records,
       COUNT(total_spent) AS valid_sales_records, {M('total_spent')} AS recorded_sales,
       {M('total_spent')} / NULLIF(COUNT(total_spent), 0) AS sales_per_valid_transaction,
       100.0::DOUBLE * COUNT(total_spent) / COUNT(*) AS sales_coverage_pct
FROM clean GROUP BY 1, 2""")


def placed(sql: str, order: str) -> str:
    """``sql`` with the 1-based place of each row."""
    return f"SELECT *, ROW_NUMBER() OVER (ORDER BY {order}) AS position FROM ({sql})"


@register("sql_monthly_channel", placed(_MONTHLY, "sales_month NULLS LAST, channel NULLS LAST"))
def q_monthly_channel(spark, sf_dir):
    return with_position(R.monthly_channel(cleaned(spark, sf_dir)), [("sales_month", "asc"), ("channel", "asc")])


_TOP = """
SELECT item, category, COUNT(*) AS transaction_count, SUM(CAST(quantity AS DOUBLE)) AS units_sold,
       {m} AS recorded_sales
FROM clean WHERE quantity IS NOT NULL AND item_imputed = 'No'
GROUP BY item, category HAVING COUNT(*) >= 20
ORDER BY {key} DESC, item ASC NULLS FIRST, category ASC NULLS FIRST LIMIT 10"""


@register("top_products", with_clean(_TOP.format(m=M("total_spent"), key="units_sold")))
def q_top_products(spark, sf_dir):
    return R.top_products(cleaned(spark, sf_dir))


@register("top_items_units", with_clean(_TOP.format(m=M("total_spent"), key="units_sold")))
def q_top_items_units(spark, sf_dir):
    return R.top_products(cleaned(spark, sf_dir), by="units")


@register("top_items_transactions", with_clean(_TOP.format(m=M("total_spent"), key="transaction_count")))
def q_top_items_transactions(spark, sf_dir):
    return R.top_products(cleaned(spark, sf_dir), by="transactions")


_MISS = """
SELECT {by}, COUNT(*) AS total_records, COUNT(*) FILTER (WHERE total_spent IS NULL) AS missing_sales_records,
       100.0::DOUBLE * COUNT(*) FILTER (WHERE total_spent IS NULL) / COUNT(*) AS missing_sales_pct
FROM clean GROUP BY {by}"""


@register("missing_rate_by_category", with_clean(_MISS.format(by="category")))
def q_missing_rate_by_category(spark, sf_dir):
    return R.missing_rate(cleaned(spark, sf_dir), "category")


@register("missing_rate_by_channel", with_clean(_MISS.format(by="location")))
def q_missing_rate_by_channel(spark, sf_dir):
    return R.missing_rate(cleaned(spark, sf_dir), "location")


@register("customer_summary", with_clean(f"""
SELECT customer_id, COUNT(*) AS transaction_count, COUNT(total_spent) AS valid_sales_records,
       {M('total_spent')} AS recorded_sales, {M('total_spent')} / NULLIF(COUNT(total_spent), 0) AS average_transaction_value
FROM clean GROUP BY customer_id"""))
def q_customer_summary(spark, sf_dir):
    return R.customer_summary(cleaned(spark, sf_dir))


@register("month_over_month", with_clean("""
SELECT sales_month, CAST(rs AS DOUBLE) AS recorded_sales, CAST(prev AS DOUBLE) AS previous_month_sales,
       CASE WHEN prev <> 0 THEN 100.0::DOUBLE * CAST(rs - prev AS DOUBLE) / CAST(prev AS DOUBLE) END AS month_over_month_pct
FROM (SELECT sales_month, rs, LAG(rs) OVER (ORDER BY sales_month ASC NULLS FIRST) AS prev
      FROM (SELECT substr(transaction_date, 1, 7) AS sales_month, SUM(CAST(total_spent AS DECIMAL(28,6))) AS rs
            FROM clean GROUP BY 1))"""))
def q_month_over_month(spark, sf_dir):
    return R.month_over_month(cleaned(spark, sf_dir))


_CUBE = """
SELECT substr(transaction_date, 1, 7) AS month, location, category, COUNT(*) AS rows,
       COUNT(total_spent) AS valid, COUNT(quantity) AS quantity_valid,
       coalesce(CAST(SUM(CAST(total_spent AS DECIMAL(28,6))) AS DOUBLE), 0.0) AS sales,
       coalesce(SUM(CAST(quantity AS DOUBLE)), 0.0) AS units
FROM clean GROUP BY 1, 2, 3"""


@register("dashboard_cube", with_clean(_CUBE))
def q_dashboard_cube(spark, sf_dir):
    return cube(spark, sf_dir)


# The last month counts only if the data reaches its last day; rows without a date do not count.
COMPLETE_MONTHS = """transaction_date IS NOT NULL AND (substr(CAST(transaction_date AS VARCHAR), 1, 7)
    <> (SELECT substr(CAST(MAX(transaction_date) AS VARCHAR), 1, 7) FROM clean)
  OR (SELECT last_day(CAST(MAX(transaction_date) AS DATE)) = CAST(MAX(transaction_date) AS DATE) FROM clean))"""


@register("headline_totals", with_clean(f"""
SELECT {M('total_spent')} AS sales, COUNT(total_spent) AS valid, COUNT(*) AS records,
       {M('total_spent')} / NULLIF(COUNT(total_spent), 0) AS average,
       COUNT(total_spent) / NULLIF(COUNT(*), 0) AS coverage
FROM clean WHERE {COMPLETE_MONTHS}"""))
def q_headline_totals(spark, sf_dir):
    return R.headline_totals(cleaned(spark, sf_dir))


@register("category_summary", placed(with_clean(f"""
SELECT category, {M('total_spent')} AS sales, COUNT(total_spent) AS valid,
       {M('total_spent')} / NULLIF(COUNT(total_spent), 0) AS sales_per_transaction
FROM clean WHERE {COMPLETE_MONTHS} GROUP BY category"""), "sales_per_transaction NULLS LAST, category NULLS LAST"))
def q_category_summary(spark, sf_dir):
    return with_position(R.category_summary(cleaned(spark, sf_dir)), [("sales_per_transaction", "asc")])


@register("channel_mean_difference", with_clean("""
SELECT CAST(SUM(CAST(total_spent AS DECIMAL(28,6))) FILTER (WHERE location = 'Online') AS DOUBLE)
         / COUNT(*) FILTER (WHERE location = 'Online')
       - CAST(SUM(CAST(total_spent AS DECIMAL(28,6))) FILTER (WHERE location = 'In-store') AS DOUBLE)
         / COUNT(*) FILTER (WHERE location = 'In-store') AS observed_difference,
       COUNT(DISTINCT customer_id) AS clusters
FROM clean WHERE total_spent IS NOT NULL"""))
def q_channel_mean_difference(spark, sf_dir):
    return R.channel_mean_difference(cleaned(spark, sf_dir))


@register("contingency_table", with_clean(
    "SELECT location AS a, payment_method AS b, COUNT(*) AS n FROM clean "
    "WHERE location IS NOT NULL AND payment_method IS NOT NULL GROUP BY 1, 2"))
def q_contingency_table(spark, sf_dir):
    return R.contingency(cleaned(spark, sf_dir), "location", "payment_method")


# Spark SQL text versions of the five reports (temp view ``retail_sales``); same oracles.
def _sql_text_query(name):
    def q(spark, sf_dir):
        from tallyspark.plans.sql_reports import run_sql_report
        return run_sql_report(spark, cleaned(spark, sf_dir), name)
    return q


for _name in ("monthly_channel", "top_products", "missing_rate_by_category", "customer_summary", "month_over_month"):
    register(f"sqltext_{_name}", _MONTHLY if _name == "monthly_channel" else _SQL[_name])(_sql_text_query(_name))


# ----------------------------------------------------------------- quality ---

_NC = ", ".join(f"{CNT(c + ' IS NULL')} AS {c}" for c in
                ["transaction_id", "customer_id", "category", "item", "price_per_unit", "quantity", "total_spent",
                 "payment_method", "location", "transaction_date", "discount_applied", "year", "month", "month_name",
                 "quarter", "weekday", "item_imputed", "price_imputed", "arithmetic_issue", "total_outlier_iqr",
                 "missing_pattern"])


@register("null_counts", with_clean(f"SELECT * FROM (SELECT {_NC} FROM clean) UNPIVOT (nulls FOR \"column\" IN (COLUMNS(*)))"))
def q_null_counts(spark, sf_dir):
    return Q.null_counts(cleaned(spark, sf_dir))


@register("raw_missing_counts", f"""
SELECT * FROM (SELECT {", ".join(f"{CNT(S.tok(S.strip(c)) + ' IS NULL')} AS {c}" for c in
    ["transaction_id", "customer_id", "category", "item", "price_per_unit", "quantity", "total_spent",
     "payment_method", "location", "transaction_date", "discount_applied"])} FROM ({RAW_SQL}))
UNPIVOT (missing FOR "column" IN (COLUMNS(*)))""")
def q_raw_missing_counts(spark, sf_dir):
    return Q.raw_missing_counts(raw(spark, sf_dir))


@register("cardinality", with_clean("""
SELECT COUNT(DISTINCT customer_id) AS customers, COUNT(DISTINCT category) AS categories,
       COUNT(DISTINCT item) AS items, COUNT(DISTINCT location) AS channels FROM clean"""))
def q_cardinality(spark, sf_dir):
    return Q.cardinality(cleaned(spark, sf_dir))


@register("date_range", with_clean("""
SELECT strftime(min(CAST(transaction_date AS DATE)), '%Y-%m-%d') AS start,
       strftime(max(CAST(transaction_date AS DATE)), '%Y-%m-%d') AS "end",
       COUNT(DISTINCT transaction_date) AS unique_days FROM clean"""))
def q_date_range(spark, sf_dir):
    return Q.date_range(cleaned(spark, sf_dir))


@register("coverage", with_clean("""
SELECT COUNT(total_spent) / COUNT(*) AS sales, COUNT(quantity) / COUNT(*) AS quantity,
       COUNT(*) FILTER (WHERE discount_applied <> 'Unknown') / COUNT(*) AS discount_known FROM clean"""))
def q_coverage(spark, sf_dir):
    return Q.coverage(cleaned(spark, sf_dir))


@register("audit_counts", with_clean(f"""
SELECT {CNT("item_imputed = 'Yes'")} AS item_internally_inferred,
       {CNT("price_imputed = 'Yes'")} AS price_target_derived,
       {CNT("item_imputed = 'Yes' AND price_imputed = 'Yes'")} AS target_derived_item_rows,
       {CNT("total_outlier_iqr = 'Yes'")} AS high_value_iqr_flags FROM clean"""))
def q_audit_counts(spark, sf_dir):
    return Q.audit_counts(cleaned(spark, sf_dir))


@register("key_uniqueness", with_clean("""
SELECT rows, null_keys, d + CASE WHEN null_keys > 0 THEN 1 ELSE 0 END AS distinct_keys,
       rows - (d + CASE WHEN null_keys > 0 THEN 1 ELSE 0 END) AS duplicate_keys
FROM (SELECT COUNT(*) AS rows, COUNT(*) FILTER (WHERE transaction_id IS NULL) AS null_keys,
             COUNT(DISTINCT transaction_id) AS d FROM clean)"""))
def q_key_uniqueness(spark, sf_dir):
    return Q.key_uniqueness(cleaned(spark, sf_dir))


@register("full_duplicates", with_clean("""
SELECT CAST(coalesce(SUM(n - 1), 0) AS BIGINT) AS full_duplicate_rows
FROM (SELECT COUNT(*) AS n FROM clean GROUP BY ALL_COLUMNS_PLACEHOLDER)"""))
def q_full_duplicates(spark, sf_dir):
    return Q.full_duplicates(cleaned(spark, sf_dir))


@register("row_accounting", with_clean("""
SELECT (SELECT COUNT(*) FROM raw) AS rows_before, (SELECT COUNT(*) FROM clean) AS rows_after,
       (SELECT COUNT(*) FROM raw) - (SELECT COUNT(*) FROM clean) AS rows_deleted,
       11 AS columns_before, 21 AS columns_after"""))
def q_row_accounting(spark, sf_dir):
    return Q.row_accounting(raw(spark, sf_dir), cleaned(spark, sf_dir))


_CHECK_NAMES = ["expected_columns", "transaction_ids_complete", "transaction_ids_unique", "dates_parseable",
                "discount_values_valid", "arithmetic_identity_holds_for_complete_rows",
                "quantity_and_total_missingness_identical", "audit_flags_valid"]


@register("validate_checks", with_clean(f"""
SELECT * FROM (SELECT true AS expected_columns,
  COUNT(*) FILTER (WHERE transaction_id IS NULL) = 0 AS transaction_ids_complete,
  COUNT(*) = COUNT(DISTINCT transaction_id) + CASE WHEN COUNT(*) FILTER (WHERE transaction_id IS NULL) > 0 THEN 1 ELSE 0 END
    AS transaction_ids_unique,
  COUNT(*) FILTER (WHERE TRY_CAST(transaction_date AS DATE) IS NULL) = 0 AS dates_parseable,
  COUNT(*) FILTER (WHERE NOT coalesce(discount_applied IN ('Yes', 'No', 'Unknown'), false)) = 0 AS discount_values_valid,
  COUNT(*) FILTER (WHERE price_per_unit IS NOT NULL AND quantity IS NOT NULL AND total_spent IS NOT NULL
                   AND NOT (abs(price_per_unit * quantity - total_spent) <= 1e-9 + 1e-9 * abs(total_spent))) = 0
    AS arithmetic_identity_holds_for_complete_rows,
  COUNT(*) FILTER (WHERE (quantity IS NULL) <> (total_spent IS NULL)) = 0 AS quantity_and_total_missingness_identical,
  COUNT(*) FILTER (WHERE NOT (coalesce(item_imputed IN ('Yes','No'), false) AND coalesce(price_imputed IN ('Yes','No'), false)
                   AND coalesce(total_outlier_iqr IN ('Yes','No'), false))) = 0 AS audit_flags_valid
FROM clean) UNPIVOT (passed FOR "check" IN ({", ".join(_CHECK_NAMES)}))"""))
def q_validate_checks(spark, sf_dir):
    return Q.validate_checks(cleaned(spark, sf_dir))


@register("validate_or_raise")
def q_validate_or_raise(spark, sf_dir):
    """Runs the checks (a handful of booleans reach the driver) and raises if any fails."""
    rows = Q.validate_or_raise(cleaned(spark, sf_dir))
    return spark.createDataFrame(rows, "check string, passed boolean")


@register("write_clean")
def q_write_clean(spark, sf_dir):
    """Cleaned-table sink: Parquet partitioned by year/month in a fresh folder of the shared checkpoint dir;
    returns rows per partition read back with partition pruning available on (year, month)."""
    import uuid

    from tallyspark.session import checkpoint_dir
    from tallyspark.sources.files import read_clean, write_clean
    out = f"{checkpoint_dir(spark).rstrip('/')}/tallyspark/clean-export-{uuid.uuid4().hex[:12]}"
    write_clean(cleaned(spark, sf_dir), out, partition_by_month=True)
    return read_clean(spark, out).groupBy("year", "month").agg(F.count(F.lit(1)).alias("rows"))


@register("quality_summary", with_clean(f"""
SELECT COUNT(*) AS rows, 21 AS columns,
  strftime(min(CAST(transaction_date AS DATE)), '%Y-%m-%d') AS start,
  strftime(max(CAST(transaction_date AS DATE)), '%Y-%m-%d') AS "end",
  COUNT(DISTINCT transaction_date) AS unique_days,
  COUNT(DISTINCT customer_id) AS customers, COUNT(DISTINCT category) AS categories,
  COUNT(DISTINCT item) AS items, COUNT(DISTINCT location) AS channels,
  COUNT(total_spent) / COUNT(*) AS sales_coverage, COUNT(quantity) / COUNT(*) AS quantity_coverage,
  COUNT(*) FILTER (WHERE discount_applied <> 'Unknown') / COUNT(*) AS discount_known,
  {CNT("item_imputed = 'Yes'")} AS item_internally_inferred,
  {CNT("price_imputed = 'Yes'")} AS price_target_derived,
  {CNT("item_imputed = 'Yes' AND price_imputed = 'Yes'")} AS target_derived_item_rows,
  {CNT("total_outlier_iqr = 'Yes'")} AS high_value_iqr_flags
FROM clean"""))
def q_quality_summary(spark, sf_dir):
    return Q.quality_summary(cleaned(spark, sf_dir))


@register("table_diff", with_clean("SELECT NULL::VARCHAR AS transaction_id, NULL::VARCHAR AS side WHERE false"))
def q_table_diff(spark, sf_dir):
    """Cleaning is idempotent on the source columns: re-cleaning the cleaned table's text changes nothing."""
    first = cleaned(spark, sf_dir)
    again_raw = first.select([F.col(c).cast("string").alias(c) for c in C.RAW_COLUMNS])
    again = C.clean(again_raw, quantity_mode=False)
    keep = ["transaction_id", "customer_id", "category", "item", "price_per_unit", "quantity",
            "total_spent", "payment_method", "location", "transaction_date", "discount_applied"]
    return Q.table_diff(first.select(*keep), again.select(*keep)).select("transaction_id", "side")


# --------------------------------------------------- distribution reports ---

@register("quantiles", with_clean("""
SELECT CAST(q[1] AS DOUBLE) AS p25, CAST(q[2] AS DOUBLE) AS p50, CAST(q[3] AS DOUBLE) AS p75,
       CAST(q[4] AS DOUBLE) AS p90
FROM (SELECT quantile_cont(total_spent, [0.25, 0.5, 0.75, 0.9]) AS q FROM clean WHERE total_spent IS NOT NULL)"""))
def q_quantiles(spark, sf_dir):
    from tallyspark.operators.ranks import exact_quantiles
    qs = exact_quantiles(cleaned(spark, sf_dir), "total_spent", [0.25, 0.5, 0.75, 0.9])
    names = ["p25", "p50", "p75", "p90"]
    return qs.groupBy().agg(*[F.max(F.when(F.col("pi") == i, F.col("q"))).alias(n) for i, n in enumerate(names)])


@register("revenue_by_channel", with_clean(f"""
SELECT location AS channel, {M('total_spent')} AS revenue, COUNT(total_spent) AS valid_records, COUNT(*) AS records
FROM clean GROUP BY 1"""))
def q_revenue_by_channel(spark, sf_dir):
    return R.revenue_by_channel(cleaned(spark, sf_dir))


@register("revenue_per_txn_ci", with_clean("""
SELECT channel, n, s / n AS mean_total,
       s / n - 1.96 * sqrt(v) / sqrt(CAST(n AS DOUBLE)) AS ci_low, s / n + 1.96 * sqrt(v) / sqrt(CAST(n AS DOUBLE)) AS ci_high
FROM (SELECT channel, n, s, CASE WHEN n - 1 <> 0 THEN (ss - s * s / n) / (n - 1) END AS v
      FROM (SELECT location AS channel, COUNT(*) AS n, CAST(SUM(CAST(total_spent AS DECIMAL(18,2))) AS DOUBLE) AS s,
                   CAST(SUM(CAST(total_spent AS DECIMAL(18,2)) * CAST(total_spent AS DECIMAL(18,2))) AS DOUBLE) AS ss
            FROM clean WHERE total_spent IS NOT NULL GROUP BY 1))"""))
def q_revenue_per_txn_ci(spark, sf_dir):
    return R.revenue_per_txn_ci(cleaned(spark, sf_dir))


@register("outlier_sensitivity", with_clean("""
SELECT channel, sales_all, n_all, sales_trimmed, n_trimmed,
       CASE WHEN sales_all <> 0 THEN (sales_trimmed - sales_all) / sales_all END AS sales_rel_change,
       CASE WHEN sales_all / n_all <> 0 THEN (CASE WHEN n_trimmed <> 0 THEN sales_trimmed / n_trimmed END) / (sales_all / n_all) END - 1.0
         AS mean_rel_change
FROM (SELECT location AS channel, CAST(SUM(CAST(total_spent AS DECIMAL(28,6))) AS DOUBLE) AS sales_all, COUNT(*) AS n_all,
             CAST(SUM(CAST(total_spent AS DECIMAL(28,6))) FILTER (WHERE total_outlier_iqr = 'No') AS DOUBLE) AS sales_trimmed,
             COUNT(*) FILTER (WHERE total_outlier_iqr = 'No') AS n_trimmed
      FROM clean WHERE total_spent IS NOT NULL GROUP BY 1)"""))
def q_outlier_sensitivity(spark, sf_dir):
    return R.outlier_sensitivity(cleaned(spark, sf_dir))


@register("median_by_category", with_clean("""
SELECT category, CAST(median(total_spent) AS DOUBLE) AS median_total, COUNT(*) AS n
FROM clean WHERE total_spent IS NOT NULL AND category IS NOT NULL GROUP BY category"""))
def q_median_by_category(spark, sf_dir):
    return R.median_by_category(cleaned(spark, sf_dir))


@register("item_pareto", with_clean("""
SELECT item, CAST(r AS DOUBLE) AS revenue, ROW_NUMBER() OVER w AS revenue_rank,
       CAST(SUM(r) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / CAST(SUM(r) OVER () AS DOUBLE)
         AS cumulative_share
FROM (SELECT item, SUM(CAST(total_spent AS DECIMAL(28,6))) AS r FROM clean
      WHERE item IS NOT NULL AND total_spent IS NOT NULL GROUP BY item)
WINDOW w AS (ORDER BY r DESC, item ASC)"""))
def q_item_pareto(spark, sf_dir):
    return R.item_pareto(cleaned(spark, sf_dir))


@register("item_rank_stability", with_clean("""
SELECT item, units_recorded, units_all, rank_recorded, rank_all, rank_recorded - rank_all AS rank_change
FROM (SELECT a.item, coalesce(r.units_recorded, 0.0) AS units_recorded, a.units_all,
             RANK() OVER (ORDER BY coalesce(r.units_recorded, 0.0) DESC) AS rank_recorded,
             RANK() OVER (ORDER BY a.units_all DESC) AS rank_all
      FROM (SELECT item, SUM(CAST(quantity AS DOUBLE)) AS units_all FROM clean
            WHERE item IS NOT NULL AND quantity IS NOT NULL GROUP BY item) a
      LEFT JOIN (SELECT item, SUM(CAST(quantity AS DOUBLE)) AS units_recorded FROM clean
                 WHERE item IS NOT NULL AND quantity IS NOT NULL AND item_imputed = 'No' GROUP BY item) r
      ON a.item = r.item)"""))
def q_item_rank_stability(spark, sf_dir):
    return R.item_rank_stability(cleaned(spark, sf_dir))


@register("category_channel_share", with_clean("""
SELECT category, channel, n, n / SUM(n) OVER (PARTITION BY category) AS share
FROM (SELECT category, location AS channel, COUNT(*) AS n FROM clean GROUP BY 1, 2)"""))
def q_category_channel_share(spark, sf_dir):
    return R.category_channel_share(cleaned(spark, sf_dir))


@register("missing_vs_unknown", with_clean("""
SELECT 'item' AS field, COUNT(*) FILTER (WHERE item IS NULL) AS missing, COUNT(*) FILTER (WHERE item = 'Unknown') AS unknown FROM clean
UNION ALL SELECT 'price_per_unit', COUNT(*) FILTER (WHERE price_per_unit IS NULL), 0 FROM clean
UNION ALL SELECT 'quantity', COUNT(*) FILTER (WHERE quantity IS NULL), 0 FROM clean
UNION ALL SELECT 'total_spent', COUNT(*) FILTER (WHERE total_spent IS NULL), 0 FROM clean
UNION ALL SELECT 'discount_applied', COUNT(*) FILTER (WHERE discount_applied IS NULL),
                 COUNT(*) FILTER (WHERE discount_applied = 'Unknown') FROM clean"""))
def q_missing_vs_unknown(spark, sf_dir):
    return R.missing_vs_unknown(cleaned(spark, sf_dir))


@register("payment_mix_by_channel", with_clean("""
SELECT channel, payment_method, n, SUM(n) OVER (PARTITION BY channel) AS channel_n,
       n / SUM(n) OVER (PARTITION BY channel) AS share
FROM (SELECT location AS channel, payment_method, COUNT(*) AS n FROM clean GROUP BY 1, 2)"""))
def q_payment_mix_by_channel(spark, sf_dir):
    return R.payment_mix_by_channel(cleaned(spark, sf_dir))


@register("monthly_revenue_coverage", with_clean(f"""
SELECT substr(transaction_date, 1, 7) AS sales_month, {M('total_spent')} AS revenue, COUNT(total_spent) AS valid,
       COUNT(*) AS records, COUNT(total_spent) / COUNT(*) AS coverage FROM clean GROUP BY 1"""))
def q_monthly_revenue_coverage(spark, sf_dir):
    return R.monthly_revenue_coverage(cleaned(spark, sf_dir))


@register("dimension_values", with_clean("SELECT DISTINCT location AS value FROM clean WHERE location IS NOT NULL"))
def q_dimension_values(spark, sf_dir):
    return R.dimension_values(cleaned(spark, sf_dir), "location")


# ------------------------------------------------------- dashboard queries ---

def _cube_sql(select: str) -> str:
    return with_clean(f"WITH cube AS ({_CUBE}) {select}")


@register("kpi_summary", _cube_sql(f"""
SELECT sales, valid, rows, CASE WHEN valid > 0 THEN sales / valid END AS average,
       CASE WHEN rows > 0 THEN valid / rows END AS coverage
FROM (SELECT coalesce(CAST(SUM(CAST(sales AS DECIMAL(28,6))) AS DOUBLE), 0.0) AS sales,
             CAST(coalesce(SUM(valid), 0) AS BIGINT) AS valid, CAST(coalesce(SUM(rows), 0) AS BIGINT) AS rows
      FROM cube WHERE month >= '{KPI_START}' AND month <= '{KPI_END}' AND location = 'Online')"""))
def q_kpi_summary(spark, sf_dir):
    return D.kpi_summary(cube(spark, sf_dir), KPI_START, KPI_END, location="Online")


_POP = f"""
, idx AS (SELECT month, ROW_NUMBER() OVER (ORDER BY month) - 1 AS mi FROM (SELECT DISTINCT month FROM cube WHERE month IS NOT NULL)),
b AS (SELECT s, e, e - s + 1 AS len, (e - s + 1 >= 1 AND s - (e - s + 1) >= 0) AS hp FROM
      (SELECT max(CASE WHEN month = '{{start}}' THEN mi END) AS s, max(CASE WHEN month = '{{end}}' THEN mi END) AS e FROM idx)),
g AS (SELECT coalesce(CAST(SUM(CAST(sales AS DECIMAL(28,6))) FILTER (WHERE month >= '{{start}}' AND month <= '{{end}}') AS DOUBLE), 0.0) AS cs,
             CAST(coalesce(SUM(valid) FILTER (WHERE month >= '{{start}}' AND month <= '{{end}}'), 0) AS BIGINT) AS cv,
             CAST(SUM(CAST(sales AS DECIMAL(28,6))) FILTER (WHERE b.hp AND mi >= b.s - b.len AND mi <= b.s - 1) AS DOUBLE) AS ps0,
             SUM(valid) FILTER (WHERE b.hp AND mi >= b.s - b.len AND mi <= b.s - 1) AS pv0
      FROM cube LEFT JOIN idx USING (month) CROSS JOIN b WHERE {{filt}}),
v AS (SELECT cs, cv, CASE WHEN hp THEN coalesce(ps0, 0.0) END AS ps,
             CASE WHEN hp THEN CAST(coalesce(pv0, 0) AS BIGINT) END AS pv FROM g CROSS JOIN (SELECT hp FROM b)),
m AS (SELECT 'sales' AS metric, cs AS cur, ps AS prev, cv FROM v
      UNION ALL SELECT 'valid', CAST(cv AS DOUBLE), CAST(pv AS DOUBLE), cv FROM v
      UNION ALL SELECT 'average', CASE WHEN cv > 0 THEN cs / cv END, CASE WHEN pv > 0 THEN ps / pv END, cv FROM v)
SELECT metric, cur AS current, prev AS previous,
       CASE WHEN metric = 'average' AND cv = 0 THEN NULL
            WHEN prev IS NOT NULL AND prev <> 0 THEN (cur - prev) / abs(prev) END AS change,
       CASE WHEN metric = 'average' AND cv = 0 THEN 'no_valid_sales'
            WHEN prev IS NULL THEN 'no_prior'
            WHEN prev = 0 THEN CASE WHEN cur = 0 THEN 'no_change' ELSE 'previous_zero' END
            ELSE 'change' END AS state
FROM m"""


def _pop_sql(start, end, filt="true"):
    body = _POP.format(start=start, end=end, filt=filt)
    return with_clean(f"WITH cube AS ({_CUBE}){body}")


@register("kpi_period_over_period", _pop_sql(KPI_START, KPI_END))
def q_kpi_period_over_period(spark, sf_dir):
    return D.kpi_period_over_period(cube(spark, sf_dir), KPI_START, KPI_END)


@register("kpi_period_over_period_filtered", _pop_sql("1995-01", "1995-06", f"location = 'In-store' AND category = '{KPI_CATEGORY}'"))
def q_kpi_pop_filtered(spark, sf_dir):
    return D.kpi_period_over_period(cube(spark, sf_dir), "1995-01", "1995-06", location="In-store",
                                    category=KPI_CATEGORY)


_LAST = "(SELECT strftime(max(d), '%Y-%m') AS last_month, last_day(max(d)) = max(d) AS last_month_complete FROM cleanx)"


@register("monthly_trend", _cube_sql(f"""
SELECT month, sales, (month = l.last_month AND NOT l.last_month_complete) AS partial
FROM (SELECT month, CAST(SUM(CAST(sales AS DECIMAL(28,6))) AS DOUBLE) AS sales FROM cube
      WHERE month >= '2000-01' AND month <= '2001-12' GROUP BY month) CROSS JOIN {_LAST} l"""))
def q_monthly_trend(spark, sf_dir):
    return D.monthly_trend(cube(spark, sf_dir), last_date(spark, sf_dir), "2000-01", "2001-12")


@register("category_breakdown", placed(_cube_sql(f"""
SELECT category, sales, valid, units, quantity_valid, rows,
       CASE WHEN valid > 0 THEN sales / valid ELSE 0.0 END AS value,
       coalesce(category = '{KPI_CATEGORY}', false) AS selected
FROM (SELECT category, CAST(SUM(CAST(sales AS DECIMAL(28,6))) AS DOUBLE) AS sales, CAST(SUM(valid) AS BIGINT) AS valid,
             SUM(units) AS units, CAST(SUM(quantity_valid) AS BIGINT) AS quantity_valid, CAST(SUM(rows) AS BIGINT) AS rows
      FROM cube WHERE month >= '{KPI_START}' AND month <= '{KPI_END}' GROUP BY category)"""), "value DESC NULLS LAST, category NULLS LAST"))
def q_category_breakdown(spark, sf_dir):
    return with_position(D.category_breakdown(cube(spark, sf_dir), KPI_START, KPI_END, category=KPI_CATEGORY), [("value", "desc")])


@register("category_breakdown_units", placed(_cube_sql(f"""
SELECT category, sales, valid, units, quantity_valid, rows, units AS value, false AS selected
FROM (SELECT category, CAST(SUM(CAST(sales AS DECIMAL(28,6))) AS DOUBLE) AS sales, CAST(SUM(valid) AS BIGINT) AS valid,
             SUM(units) AS units, CAST(SUM(quantity_valid) AS BIGINT) AS quantity_valid, CAST(SUM(rows) AS BIGINT) AS rows
      FROM cube WHERE month >= '{KPI_START}' AND month <= '{KPI_END}' AND location = 'Online' GROUP BY category)"""), "value DESC NULLS LAST, category NULLS LAST"))
def q_category_breakdown_units(spark, sf_dir):
    return with_position(D.category_breakdown(cube(spark, sf_dir), KPI_START, KPI_END, location="Online", metric="units"), [("value", "desc")])


@register("quantity_coverage", _cube_sql(f"""
SELECT CASE WHEN SUM(rows) > 0 THEN SUM(quantity_valid) / SUM(rows) ELSE 0.0 END AS quantity_coverage
FROM cube WHERE month >= '{KPI_START}' AND month <= '{KPI_END}'"""))
def q_quantity_coverage(spark, sf_dir):
    return D.quantity_coverage(cube(spark, sf_dir), KPI_START, KPI_END)


@register("default_period", _cube_sql(f"""
SELECT g.start_month, CASE WHEN g.max_month = l.last_month AND NOT l.last_month_complete AND pm.prev_month IS NOT NULL
                          THEN pm.prev_month ELSE g.max_month END AS end_month
FROM (SELECT min(month) AS start_month, max(month) AS max_month FROM cube WHERE month IS NOT NULL) g
CROSS JOIN {_LAST} l
CROSS JOIN (SELECT max(month) AS prev_month FROM cube WHERE month < (SELECT max(month) FROM cube)) pm"""))
def q_default_period(spark, sf_dir):
    return D.default_period(cube(spark, sf_dir), last_date(spark, sf_dir))


def queries():
    from tallyspark.plans import analytics, faulty  # noqa: F401  (register statistics / model queries and those over faulty rows)
    return dict(_Q)


def oracle_sql():
    from tallyspark.plans import analytics, faulty  # noqa: F401
    out = dict(_SQL)
    cols = ", ".join(C.CLEAN_COLUMNS)
    out["full_duplicates"] = out["full_duplicates"].replace("ALL_COLUMNS_PLACEHOLDER", cols)
    return out


def flagship(spark, sf_dir):
    """Cleaned table -> cube -> KPIs of the last twelve complete months vs the twelve before.

    The month list is one row per calendar month present (a few hundred at
    most), so reading it on the driver is bounded.
    """
    cb = cube(spark, sf_dir)
    period = D.default_period(cb, last_date(spark, sf_dir)).first()
    months = [r["month"] for r in D.month_index(cb).orderBy("mi").collect()]
    end = period["end_month"]
    start = months[max(0, months.index(end) - 11)] if end in months else period["start_month"]
    return D.kpi_period_over_period(cb, start, end)
