"""DuckDB SQL text of the cleaning pipeline, used by the oracle queries.

Written independently of the DataFrame code so each registered query can be
checked against a second engine on the same Parquet tables.
"""

from __future__ import annotations

from tallyspark.sources.adapter import RAW_SQL
from tallyspark.sources.dirty import FAULTY_SQL

# RE2 class of Unicode whitespace as Python's str.isspace sees it.
WS = (r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")
NUM = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
DATE = r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
TOKENS = "('', 'nan', 'null', 'none')"


def strip(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}', ' ', 'g'))"


def tok(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {c} IN {TOKENS} THEN NULL ELSE {c} END"


def num(c: str) -> str:
    return f"CASE WHEN regexp_full_match({c}, '{NUM}') THEN TRY_CAST({c} AS DOUBLE) END"


TEXT = ["transaction_id", "customer_id", "category", "item", "payment_method", "location"]
NUMS = ["price_per_unit", "quantity", "total_spent"]

_stripped = ",\n       ".join(f"{strip(c)} AS {c}" for c in TEXT + NUMS + ["transaction_date", "discount_applied"])
_texts = ",\n       ".join(f"{tok(c)} AS {c}" for c in TEXT)
_nums = ",\n       ".join(f"{num(tok(c))} AS {c}" for c in NUMS)
_bad = ",\n       ".join(f"({tok(c)} IS NOT NULL AND {num(tok(c))} IS NULL) AS bad_{c}" for c in NUMS)

def clean_cte(raw_sql: str, quantity: str) -> str:
    """The cleaning CTEs over a raw table; ``quantity`` is the quantity's expression in the cleaned table."""
    return f"""
raw AS ({raw_sql}),
s AS (SELECT {_stripped} FROM raw),
parsed AS (
  SELECT {_texts},
       {_nums},
       CASE WHEN regexp_full_match(transaction_date, '{DATE}') THEN TRY_CAST(transaction_date AS DATE) END AS d,
       CASE lower(discount_applied) WHEN 'true' THEN 'Yes' WHEN 'yes' THEN 'Yes' WHEN '1' THEN 'Yes'
            WHEN 'false' THEN 'No' WHEN 'no' THEN 'No' WHEN '0' THEN 'No' ELSE 'Unknown' END AS discount_applied,
       CASE WHEN {tok('lower(discount_applied)')} IS NULL THEN 'missing'
            WHEN lower(discount_applied) IN ('true','yes','1','false','no','0') THEN 'mapped'
            ELSE 'unexpected' END AS discount_outcome,
       {_bad}
  FROM s),
derived AS (
  SELECT *, price_per_unit AS price_recorded,
         (price_per_unit IS NULL AND quantity IS NOT NULL AND quantity <> 0 AND total_spent IS NOT NULL) AS pmask
  FROM parsed),
priced AS (
  SELECT * EXCLUDE (price_per_unit, pmask),
         CASE WHEN pmask THEN total_spent / quantity ELSE price_per_unit END AS price_per_unit,
         CASE WHEN pmask THEN 'Yes' ELSE 'No' END AS price_imputed
  FROM derived),
itemmap AS (
  SELECT category, TRY_CAST(price_recorded AS DECIMAL(18,6)) AS pkey, min(item) AS map_item
  FROM priced WHERE category IS NOT NULL AND price_recorded IS NOT NULL AND item IS NOT NULL
  GROUP BY 1, 2 HAVING count(DISTINCT item) = 1),
imputed AS (
  SELECT p.* EXCLUDE (item),
         CASE WHEN p.item IS NULL AND p.category IS NOT NULL AND p.price_per_unit IS NOT NULL
              THEN m.map_item ELSE p.item END AS item,
         CASE WHEN p.item IS NULL AND p.category IS NOT NULL AND p.price_per_unit IS NOT NULL
                   AND m.map_item IS NOT NULL THEN 'Yes' ELSE 'No' END AS item_imputed
  FROM priced p LEFT JOIN itemmap m
    ON p.item IS NULL AND p.category = m.category AND TRY_CAST(p.price_per_unit AS DECIMAL(18,6)) = m.pkey),
bounds AS (
  SELECT q[1] AS q1, q[2] AS q3, q[1] - 1.5 * (q[2] - q[1]) AS lower_bound, q[2] + 1.5 * (q[2] - q[1]) AS upper_bound
  FROM (SELECT quantile_cont(total_spent, [0.25, 0.75]) AS q FROM parsed WHERE total_spent IS NOT NULL)),
cleanx AS (
  SELECT transaction_id, customer_id, category, item, price_per_unit,
         {quantity} AS quantity, total_spent, payment_method, location,
         strftime(d, '%Y-%m-%d') AS transaction_date, discount_applied,
         CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, monthname(d) AS month_name,
         'Q' || CAST(quarter(d) AS VARCHAR) AS quarter, dayname(d) AS weekday,
         item_imputed, price_imputed,
         CASE WHEN price_per_unit IS NOT NULL AND quantity IS NOT NULL AND total_spent IS NOT NULL
                   AND NOT (abs(price_per_unit * {quantity} - total_spent) <= 1e-9 + 1e-9 * abs(total_spent))
              THEN 'Yes' ELSE 'No' END AS arithmetic_issue,
         CASE WHEN total_spent IS NOT NULL AND NOT (total_spent BETWEEN b.lower_bound AND b.upper_bound)
              THEN 'Yes' ELSE 'No' END AS total_outlier_iqr,
         coalesce(nullif(concat_ws(', ',
             CASE WHEN item IS NULL THEN 'Item' END,
             CASE WHEN price_per_unit IS NULL THEN 'Price Per Unit' END,
             CASE WHEN quantity IS NULL THEN 'Quantity' END,
             CASE WHEN total_spent IS NULL THEN 'Total Spent' END,
             CASE WHEN discount_applied = 'Unknown' THEN 'Discount Applied' END), ''), 'Complete') AS missing_pattern,
         d, discount_outcome, bad_price_per_unit, bad_quantity, bad_total_spent, price_recorded
  FROM imputed CROSS JOIN bounds b),
clean AS (
  SELECT transaction_id, customer_id, category, item, price_per_unit, quantity, total_spent, payment_method,
         location, transaction_date, discount_applied, year, month, month_name, quarter, weekday,
         item_imputed, price_imputed, arithmetic_issue, total_outlier_iqr, missing_pattern
  FROM cleanx)
"""


CLEAN_CTE = clean_cte(RAW_SQL, "CAST(quantity AS BIGINT)")


def with_clean(select: str) -> str:
    """Oracle query over the cleaned table: ``WITH <cleaning CTEs> <select>``."""
    return f"WITH {CLEAN_CTE},\nq AS ({select})\nSELECT * FROM q"


def with_faulty(select: str) -> str:
    """The same over the raw view with faults, whose quantities are not all whole numbers."""
    return f"WITH {clean_cte(FAULTY_SQL, 'quantity')},\nq AS ({select})\nSELECT * FROM q"
