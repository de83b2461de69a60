"""The raw view with faults: what real exports contain, put in by a checksum of the transaction id.

The driver tables are clean, so most cleaning rules would never fire on
``adapter.retail_raw``. Here about a tenth of the rows get one fault each:
numbers and dates that do not parse, other spellings of the discount flag,
missing-value words, stray white space, wrong totals, fractional quantities,
repeated and missing ids, and rows that occur twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.schema import RAW_COLUMNS
from tallyspark.sources.adapter import RAW_SQL

NBSP = " "


def fault_number(transaction_id: Column) -> Column:
    """0 to 999, from the first 16 bits of the id's MD5."""
    return F.conv(F.substring(F.md5(transaction_id), 1, 4), 16, 10).cast("int") % 1000


def with_faults(raw: DataFrame) -> DataFrame:
    """``raw`` with faults; rows with number 110 to 113 occur twice."""
    z = F.col("_z")
    c = {name: F.col(name) for name in RAW_COLUMNS}
    between = z.between
    faulty = {
        "transaction_id": F.when(between(85, 86), F.lit("DUP")).when(z == 87, F.lit(" null ")).when(between(92, 93), F.concat(F.lit("\t"), c["transaction_id"])),
        "customer_id": F.when(z == 94, F.lit("")),
        "category": F.when(between(60, 64), F.lit(" none")),
        "item": F.when(between(65, 69), F.lit("none")),
        "price_per_unit": F.when(between(0, 4), F.lit("abc")).when(between(50, 54), F.concat(c["price_per_unit"], F.lit(" "))),
        "quantity": F.when(between(5, 9), F.lit("n/a")).when(between(80, 82), F.lit("2.5")).when(z == 83, F.lit("0")),
        "total_spent": F.when(between(10, 14), F.concat(F.lit("1,"), c["total_spent"]))
                        .when(between(55, 59) & (c["total_spent"] != ""), F.concat(F.lit("9"), c["total_spent"])),
        "payment_method": F.when(between(70, 74), F.concat(F.lit(NBSP), c["payment_method"], F.lit("\t "))),
        "location": F.when(between(75, 79), F.concat(c["location"], F.lit("  "))),
        "transaction_date": F.when(between(15, 19), F.lit("1999-02-30")).when(between(20, 24), F.lit("31/12/1999")).when(z == 25, F.lit("")),
        "discount_applied": F.when(between(26, 34), F.lit("YES")).when(between(35, 44), F.lit(" 0 ")).when(between(45, 49), F.lit("maybe"))
                             .when(between(100, 104), F.lit("NULL")).when(between(105, 109), F.lit("tRuE")),
    }
    numbered = raw.withColumn("_z", fault_number(F.col("transaction_id")))
    twice = numbered.withColumn("_copy", F.explode(F.when(between(110, 113), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return twice.select(*[faulty[n].otherwise(c[n]).alias(n) for n in RAW_COLUMNS])


# DuckDB text of the same view.
FAULTY_SQL = f"""
SELECT CASE WHEN z BETWEEN 85 AND 86 THEN 'DUP' WHEN z = 87 THEN ' null ' WHEN z BETWEEN 92 AND 93 THEN chr(9) || transaction_id ELSE transaction_id END AS transaction_id,
       CASE WHEN z = 94 THEN '' ELSE customer_id END AS customer_id,
       CASE WHEN z BETWEEN 60 AND 64 THEN ' none' ELSE category END AS category,
       CASE WHEN z BETWEEN 65 AND 69 THEN 'none' ELSE item END AS item,
       CASE WHEN z BETWEEN 0 AND 4 THEN 'abc' WHEN z BETWEEN 50 AND 54 THEN price_per_unit || ' ' ELSE price_per_unit END AS price_per_unit,
       CASE WHEN z BETWEEN 5 AND 9 THEN 'n/a' WHEN z BETWEEN 80 AND 82 THEN '2.5' WHEN z = 83 THEN '0' ELSE quantity END AS quantity,
       CASE WHEN z BETWEEN 10 AND 14 THEN '1,' || total_spent WHEN z BETWEEN 55 AND 59 AND total_spent <> '' THEN '9' || total_spent
            ELSE total_spent END AS total_spent,
       CASE WHEN z BETWEEN 70 AND 74 THEN chr(160) || payment_method || chr(9) || ' ' ELSE payment_method END AS payment_method,
       CASE WHEN z BETWEEN 75 AND 79 THEN location || '  ' ELSE location END AS location,
       CASE WHEN z BETWEEN 15 AND 19 THEN '1999-02-30' WHEN z BETWEEN 20 AND 24 THEN '31/12/1999' WHEN z = 25 THEN '' ELSE transaction_date END AS transaction_date,
       CASE WHEN z BETWEEN 26 AND 34 THEN 'YES' WHEN z BETWEEN 35 AND 44 THEN ' 0 ' WHEN z BETWEEN 45 AND 49 THEN 'maybe'
            WHEN z BETWEEN 100 AND 104 THEN 'NULL' WHEN z BETWEEN 105 AND 109 THEN 'tRuE' ELSE discount_applied END AS discount_applied
FROM (SELECT *, ('0x' || substr(md5(transaction_id), 1, 4))::INT % 1000 AS z FROM ({RAW_SQL})) f
     JOIN (VALUES (1), (2)) copies(n) ON n = 1 OR z BETWEEN 110 AND 113
"""
