"""Queries over the raw view with faults, where every cleaning rule and check has something to do, and checked cleaning."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import text as X
from tallyspark.operators import checked as K
from tallyspark.operators import cleaning as C
from tallyspark.operators import quality as Q
from tallyspark.operators.difference import table_difference
from tallyspark.plans import sqltext as S
from tallyspark.plans.catalog import CNT, cleaned, raw, register
from tallyspark.plans.sqltext import with_clean, with_faulty
from tallyspark.schema import CLEAN_COLUMNS, NUMERIC_COLUMNS, RAW_COLUMNS, TEXT_COLUMNS
from tallyspark.session import checkpoint_dir
from tallyspark.sources.adapter import TABLES
from tallyspark.sources.dirty import FAULTY_SQL, with_faults


def faulty_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_faults(raw(spark, sf_dir))


def faulty_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned table of the faulty rows, written once per input to the shared folder."""
    from tallyspark.plans.materialize import materialized
    return materialized(spark, "faulty_internal", input_files(sf_dir),
                        lambda path: C.write_clean_table(faulty_raw(spark, sf_dir), path, keep_internal=True))


def input_files(sf_dir: str) -> list[str]:
    return [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in TABLES]


@register("faulty_scan_raw", FAULTY_SQL)
def q_faulty_scan_raw(spark, sf_dir):
    return faulty_raw(spark, sf_dir)


@register("faulty_clean", with_faulty("SELECT * FROM clean"))
def q_faulty_clean(spark, sf_dir):
    return faulty_clean(spark, sf_dir).select(*CLEAN_COLUMNS)


@register("faulty_strict_price", with_faulty("""
SELECT transaction_id, CASE WHEN pmask AND total_spent / quantity > 0
         AND abs((total_spent / quantity) * quantity - total_spent) <= greatest(1e-9 * greatest(abs((total_spent / quantity) * quantity), abs(total_spent)), 1e-9)
       THEN 'Yes' ELSE 'No' END AS price_imputed
FROM derived"""))
def q_faulty_strict_price(spark, sf_dir):
    return C.derive_price(C.parse_raw(faulty_raw(spark, sf_dir)), strict=True).select("transaction_id", "price_imputed")


@register("faulty_invalid_numbers", with_faulty(f"""
SELECT {", ".join(f"{CNT('bad_' + c)} AS {c}" for c in NUMERIC_COLUMNS)} FROM parsed"""))
def q_faulty_invalid_numbers(spark, sf_dir):
    return C.parse_raw(faulty_raw(spark, sf_dir)).agg(*[F.count_if(f"_bad_{c}").alias(c) for c in NUMERIC_COLUMNS])


@register("faulty_discount_outcomes", with_faulty("""
SELECT discount_outcome, discount_applied, COUNT(*) AS rows FROM parsed GROUP BY 1, 2"""))
def q_faulty_discount_outcomes(spark, sf_dir):
    return (C.parse_raw(faulty_raw(spark, sf_dir)).groupBy(F.col("_discount_outcome").alias("discount_outcome"), "discount_applied")
             .agg(F.count(F.lit(1)).alias("rows")))


_CHECKS = ["transaction_ids_complete", "transaction_ids_unique", "dates_parseable", "discount_values_valid",
           "arithmetic_identity_holds_for_complete_rows", "quantity_and_total_missingness_identical", "audit_flags_valid"]


@register("faulty_validate_checks", with_faulty(f"""
SELECT * FROM (SELECT true AS expected_columns,
  {CNT("transaction_id IS NULL")} = 0 AS transaction_ids_complete,
  COUNT(*) = COUNT(DISTINCT coalesce(transaction_id, chr(0))) AS transaction_ids_unique,
  {CNT("TRY_CAST(transaction_date AS DATE) IS NULL")} = 0 AS dates_parseable,
  {CNT("NOT coalesce(discount_applied IN ('Yes', 'No', 'Unknown'), false)")} = 0 AS discount_values_valid,
  {CNT("arithmetic_issue = 'Yes'")} = 0 AS arithmetic_identity_holds_for_complete_rows,
  {CNT("(quantity IS NULL) <> (total_spent IS NULL)")} = 0 AS quantity_and_total_missingness_identical,
  {CNT("item_imputed NOT IN ('Yes','No') OR price_imputed NOT IN ('Yes','No') OR total_outlier_iqr NOT IN ('Yes','No')")} = 0 AS audit_flags_valid
FROM clean) UNPIVOT (passed FOR "check" IN (expected_columns, {", ".join(_CHECKS)}))"""))
def q_faulty_validate_checks(spark, sf_dir):
    return Q.validate_checks(faulty_clean(spark, sf_dir).select(*CLEAN_COLUMNS))


@register("faulty_key_uniqueness", with_faulty(f"""
SELECT COUNT(*) AS rows, {CNT("transaction_id IS NULL")} AS null_keys, COUNT(DISTINCT coalesce(transaction_id, chr(0))) AS distinct_keys,
       COUNT(*) - COUNT(DISTINCT coalesce(transaction_id, chr(0))) AS duplicate_keys FROM clean"""))
def q_faulty_key_uniqueness(spark, sf_dir):
    return Q.key_uniqueness(faulty_clean(spark, sf_dir))


@register("faulty_full_duplicates", with_faulty(f"""
SELECT CAST(SUM(n - 1) AS BIGINT) AS full_duplicate_rows FROM (SELECT COUNT(*) AS n FROM clean GROUP BY {", ".join(CLEAN_COLUMNS)})"""))
def q_faulty_full_duplicates(spark, sf_dir):
    return Q.full_duplicates(faulty_clean(spark, sf_dir).select(*CLEAN_COLUMNS))


_TYPED = ", ".join("CAST(quantity AS DOUBLE) AS quantity" if c == "quantity" else c for c in CLEAN_COLUMNS)
_PLAIN, _FAULTY = (f"({w(f'SELECT {_TYPED} FROM clean')})" for w in (with_clean, with_faulty))


@register("table_difference", f"""
SELECT {", ".join(CLEAN_COLUMNS)}, CASE WHEN SUM(s) > 0 THEN 'left_only' ELSE 'right_only' END AS side, CAST(abs(SUM(s)) AS BIGINT) AS copies
FROM (SELECT *, 1 AS s FROM {_PLAIN} UNION ALL BY NAME SELECT *, -1 AS s FROM {_FAULTY}) GROUP BY {", ".join(CLEAN_COLUMNS)} HAVING SUM(s) <> 0""")
def q_table_difference(spark, sf_dir):
    """What the faults change in the cleaned table: every row that only one side has, in all columns, with its multiplicity."""
    typed = lambda df: df.select(*CLEAN_COLUMNS).withColumn("quantity", F.col("quantity").cast("double"))
    return table_difference(typed(cleaned(spark, sf_dir)), typed(faulty_clean(spark, sf_dir)), ["transaction_id"])


def _log_sql(committed: bool) -> str:
    """Every counter and check of a checked run over the CTEs ``raw``, ``parsed`` and ``cleanx``."""
    missing = lambda c: f"{S.strip(c)} IS NULL OR {S.strip(c)} IN {S.TOKENS}"
    before = {f"missing_before_{c}": CNT(missing(c)) for c in RAW_COLUMNS}
    before |= {f"whitespace_{c}": CNT(f"NOT ({missing(c)}) AND {S.strip(c)} <> {c}") for c in TEXT_COLUMNS}
    flag = S.strip("discount_applied")
    for word, code in X.DISCOUNT_CODES.items():
        forms = [word, word.capitalize(), word.upper()] if word.isalpha() else [word]
        for name, form in zip(("lower", "title", "upper"), forms):
            if form != code:
                before[f"discount_{word}_{name}_to_{code}"] = CNT(f"{flag} = '{form}'")
        if word.isalpha():
            before[f"discount_{word}_mixed_to_{code}"] = CNT(f"lower({flag}) = '{word}' AND {flag} NOT IN ({', '.join(repr(f) for f in forms)})")
    before["rows_before"] = "COUNT(*)"
    yes = lambda c: CNT(f"{c} = 'Yes'")
    after = {"rows_after": "COUNT(*)", **{f"missing_after_{c}": CNT(f"{c} IS NULL") for c in RAW_COLUMNS},
             **{f"invalid_{c}": CNT(f"bad_{c}") for c in NUMERIC_COLUMNS}, "invalid_dates": CNT("d IS NULL"),
             "discount_missing": CNT("discount_outcome = 'missing'"), "discount_unexpected": CNT("discount_outcome = 'unexpected'"),
             "discount_unknown": CNT("discount_applied = 'Unknown'"), "discount_outside_code": CNT("discount_applied NOT IN ('Yes', 'No', 'Unknown')"),
             "price_derived": yes("price_imputed"), "item_inferred": yes("item_imputed"),
             "non_integer_quantities": CNT("quantity <> floor(quantity)"), "arithmetic_issues": yes("arithmetic_issue"),
             "iqr_flagged": yes("total_outlier_iqr"), "repeated_ids": "COUNT(*) - COUNT(DISTINCT coalesce(transaction_id, chr(0)))"}
    checks = {"check_raw_unchanged": "1", "check_row_count_unchanged": "(rows_before = rows_after)::BIGINT",
              "check_transaction_ids_complete": "(missing_after_transaction_id = 0)::BIGINT", "check_transaction_ids_unique": "(repeated_ids = 0)::BIGINT",
              "check_no_arithmetic_issues": "(arithmetic_issues = 0)::BIGINT", "check_all_dates_parseable": "(invalid_dates = 0)::BIGINT",
              "check_discount_standardized": "(discount_outside_code = 0)::BIGINT", "committed": str(int(committed))}
    named = lambda d: ", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in d.items())
    return (f"SELECT counter, n FROM (SELECT *, {named(checks)} FROM (SELECT {named(before)} FROM raw) CROSS JOIN (SELECT {named(after)} FROM cleanx)) "
            f"UNPIVOT (n FOR counter IN ({', '.join([*before, *after, *checks])}))")


def _target(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/tallyspark/checked-{uuid.uuid4().hex[:12]}"


@register("checked_cleaning", with_clean(_log_sql(True)))
def q_checked_cleaning(spark, sf_dir):
    """Clean with all checks: the log of a run that commits its table."""
    path = _target(spark)
    log = K.clean_checked(raw(spark, sf_dir), path, f"{path}.log.json", input_files(sf_dir))
    return K.log_counters(spark, log, committed=spark.read.parquet(path).count() == log["counters"]["rows_after"])


@register("checked_cleaning_rejected", with_faulty(_log_sql(False)))
def q_checked_cleaning_rejected(spark, sf_dir):
    """The same over the faulty rows: the log of a run whose checks fail, and no table."""
    path = _target(spark)
    try:
        log = K.clean_checked(faulty_raw(spark, sf_dir), path, f"{path}.log.json", input_files(sf_dir))
    except K.CleaningRejected as refused:
        log = refused.log
    fs, p = K._fs(spark, path)
    return K.log_counters(spark, log, committed=fs.exists(p))


@register("input_hash_tree")
def q_input_hash_tree(spark, sf_dir):
    """Root hash, ranges and lines of every input file (no SQL equivalent: it reads files, not tables)."""
    from tallyspark.sources import hash_tree
    return hash_tree.hash_tree(spark, input_files(sf_dir), range_bytes=1 << 20).roots
