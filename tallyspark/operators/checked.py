"""Cleaning that commits its table only when all checks hold.

The parsed rows are written once to the shared folder. The pass that writes the
cleaned table carries all counters as observed metrics: they are taken in the
last stage, under the writer, where each task counts once however often it was
tried. Each row takes narrow audit marks along (bit masks of the columns that
were missing or had their white space changed, and the discount spelling), so no
counter needs a pass of its own. Ids are checked for uniqueness on the staged
table, and a hash tree of the input files shows that nothing changed them
meanwhile.

Then the log is written, and only if every check holds the staged folder is
renamed to its place. A failing run leaves its log, no table, and whatever table
an earlier run committed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import text as X
from tallyspark.operators import cleaning as C
from tallyspark.schema import CLEAN_COLUMNS, NUMERIC_COLUMNS, RAW_COLUMNS, TEXT_COLUMNS
from tallyspark.session import checkpoint_dir
from tallyspark.sources import hash_tree

# How a discount word is spelled in the log: lower case, capitalised, upper case, or any other mixture.
SPELLINGS = ("lower", "title", "upper", "mixed")
CHECKS = ("raw_unchanged", "row_count_unchanged", "transaction_ids_complete", "transaction_ids_unique", "no_arithmetic_issues",
          "all_dates_parseable", "discount_standardized")


class CleaningRejected(AssertionError):
    """A check failed; ``log`` is the log that was written, and no table was committed."""

    def __init__(self, log: dict):
        super().__init__("checks failed: " + ", ".join(k for k, ok in log["checks"].items() if not ok))
        self.log = log


def audit_marks() -> dict[str, Column]:
    """Marks of a row (see ``parse_raw``): which columns are missing, in which text columns white space changes, and the discount flag's spelling."""
    stripped = {c: F.col(c) for c in RAW_COLUMNS}
    missing = [F.when(X.null_token(stripped[c]).isNull(), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(RAW_COLUMNS)]
    spaced = [F.when(X.null_token(stripped[c]).isNotNull() & (stripped[c] != F.col(f"_raw_{c}")), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(TEXT_COLUMNS)]
    add = lambda parts: sum(parts[1:], parts[0])
    return {"_missing": add(missing), "_spaced": add(spaced), "_spelling": stripped["discount_applied"]}


def spelling_counters() -> dict[str, Column]:
    """One counter per discount word and spelling that is mapped to another text: ``discount_true_upper_to_Yes`` and so on."""
    s, out = F.col("_spelling"), {}
    for word, code in X.DISCOUNT_CODES.items():
        forms = {"lower": word, "title": word.capitalize(), "upper": word.upper()} if word.isalpha() else {"lower": word}
        for name, form in forms.items():
            if form != code:
                out[f"discount_{word}_{name}_to_{code}"] = F.count_if(s == form)
        if word.isalpha():
            out[f"discount_{word}_mixed_to_{code}"] = F.count_if((F.lower(s) == word) & ~s.isin(list(forms.values())))
    return out


def counters() -> dict[str, Column]:
    """Every counter of the log, over the cleaned rows with their audit marks."""
    bit = lambda mark, k: F.count_if(F.col(mark).bitwiseAND(F.lit(1 << k)) != 0)
    yes = lambda c: F.count_if(F.col(c) == "Yes")
    q = F.col("quantity")
    return {
        "rows_after": F.count(F.lit(1)),
        **{f"missing_before_{c}": bit("_missing", k) for k, c in enumerate(RAW_COLUMNS)},
        **{f"missing_after_{c}": F.count_if(F.col(c).isNull()) for c in RAW_COLUMNS},
        **{f"whitespace_{c}": bit("_spaced", k) for k, c in enumerate(TEXT_COLUMNS)},
        **{f"invalid_{c}": F.count_if(f"_bad_{c}") for c in NUMERIC_COLUMNS},
        "invalid_dates": F.count_if(F.col("_date").isNull()),
        **spelling_counters(),
        "discount_missing": F.count_if(F.col("_discount_outcome") == "missing"),
        "discount_unexpected": F.count_if(F.col("_discount_outcome") == "unexpected"),
        "discount_unknown": F.count_if(F.col("discount_applied") == "Unknown"),
        "discount_outside_code": F.count_if(~F.coalesce(F.col("discount_applied").isin(X.DISCOUNT_VALUES), F.lit(False))),
        "price_derived": yes("price_imputed"),
        "item_inferred": yes("item_imputed"),
        "non_integer_quantities": F.count_if(q.isNotNull() & (F.abs(q - F.round(q)) > 1e-8)),
        "arithmetic_issues": yes("arithmetic_issue"),
        "iqr_flagged": yes("total_outlier_iqr"),
    }


def repeated_keys(df: DataFrame, key: str = "transaction_id") -> int:
    """Rows beyond the first of each key (null is one key)."""
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return int(groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0])


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file on any file system that Spark reaches; it appears whole or not at all."""
    fs, final = _fs(spark, path)
    _, part = _fs(spark, f"{path}.part-{uuid.uuid4().hex[:8]}")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(final, False)
    if not fs.rename(part, final):
        raise RuntimeError(f"could not write {path}")


def commit(spark: SparkSession, staged: str, path: str) -> None:
    """Put a complete folder in its place; a table that stood there is moved aside first and deleted last."""
    fs, source = _fs(spark, staged)
    _, target = _fs(spark, path)
    _, aside = _fs(spark, f"{path}.old-{uuid.uuid4().hex[:8]}")
    replaced = fs.exists(target)
    if replaced and not fs.rename(target, aside):
        raise RuntimeError(f"could not replace {path}")
    if not fs.rename(source, target):
        if replaced:
            fs.rename(aside, target)
        raise RuntimeError(f"could not commit {path}")
    if replaced:
        fs.delete(aside, True)


def clean_checked(raw: DataFrame, path: str, log_path: str, inputs: list[str] | None = None, *, strict_price: bool = False,
                  partition_by: list[str] | None = None, range_bytes: int = hash_tree.RANGE_BYTES) -> dict:
    """Clean ``raw`` into the Parquet folder ``path`` if every check holds; the log goes to the file ``log_path`` and is returned.

    ``inputs`` are the files behind ``raw``, hashed before and after. Raises ``CleaningRejected`` if a check fails."""
    spark = raw.sparkSession
    scratch = f"{checkpoint_dir(spark).rstrip('/')}/tallyspark/parsed-{uuid.uuid4().hex[:12]}"
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex[:12]}"
    before = hash_tree.hash_tree(spark, inputs, range_bytes) if inputs else None
    try:
        C.parse_raw(raw, marks=audit_marks()).write.parquet(scratch)
        parsed = spark.read.parquet(scratch)
        rows_before = parsed.count()
        bounds = C.iqr_bounds(parsed).first()
        whole = bool(C.quantity_is_whole(parsed).first()["quantity_whole"])
        limits = spark.createDataFrame([bounds], "q1 double, q3 double, lower_bound double, upper_bound double")
        out = C.clean_parsed(parsed, strict_price=strict_price, quantity_mode=whole, keep_internal=True, bounds=limits)
        seen = Observation()
        writer = out.observe(seen, *[F.coalesce(e.cast("long"), F.lit(0)).alias(n) for n, e in counters().items()]).select(*CLEAN_COLUMNS).write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staged)
        found = {n: int(v) for n, v in seen.get.items()}
        repeated = repeated_keys(spark.read.parquet(staged))
        changed = [] if before is None else hash_tree.differences(before, hash_tree.hash_tree(spark, inputs, range_bytes)).orderBy("file", "start").limit(1000).collect()
        passed = (not changed, rows_before == found["rows_after"], found["missing_after_transaction_id"] == 0, repeated == 0,
                  found["arithmetic_issues"] == 0, found["invalid_dates"] == 0, found["discount_outside_code"] == 0)
        log = {
            "output": path, "rows_before": rows_before, "counters": found | {"rows_before": rows_before, "repeated_ids": repeated},
            "outlier_rule": {"method": "IQR 1.5", **bounds.asDict()},
            "inputs": [] if before is None else [r.asDict() for r in before.roots.orderBy("file").limit(1000).collect()],
            "changed_ranges": [r.asDict() for r in changed],
            "checks": dict(zip(CHECKS, passed)),
        }
        write_text(spark, log_path, json.dumps(log, indent=2))
        if not all(passed):
            raise CleaningRejected(log)
        commit(spark, staged, path)
        return log
    finally:
        for left in (scratch, staged):
            fs, p = _fs(spark, left)
            fs.delete(p, True)


def log_counters(spark: SparkSession, log: dict, committed: bool) -> DataFrame:
    """(counter, n): the log's counters, its checks as 0 or 1, and whether the table was committed."""
    rows = [(k, int(v)) for k, v in log["counters"].items()] + [(f"check_{k}", int(v)) for k, v in log["checks"].items()]
    return spark.createDataFrame([*rows, ("committed", int(committed))], "counter string, n long")
