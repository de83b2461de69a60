"""Raw text table -> typed, imputed and audit-flagged table.

Row-local rules are Column expressions; the two whole-table rules (the
(category, price) -> item lookup and the IQR bounds) are side aggregates
joined back, so cleaning is one lazy plan. Nothing is deleted: every raw row
yields exactly one cleaned row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import numeric as N
from tallyspark.functions import text as X
from tallyspark.functions.calendar import calendar_columns, iso_text
from tallyspark.operators.ranks import DEFAULT_BUCKETS, exact_quantiles
from tallyspark.schema import ANALYTICAL_FIELDS, CLEAN_COLUMNS, NUMERIC_COLUMNS, RAW_COLUMNS, TEXT_COLUMNS
from tallyspark.session import delete_folder, write_table, written_once

# Lookup keys compare prices at this many decimals: equality of doubles
# breaks when a price is recovered as total / quantity.
PRICE_KEY = "decimal(18,6)"
# Fixed value: item token used when an imputed item is hidden from a model.
MASKED_ITEM = "Unknown_at_prediction"


def price_key(c):
    return c.try_cast(PRICE_KEY)


def parse_raw(raw: DataFrame, case_insensitive: bool = False, keep: list[str] | None = None,
              marks: dict[str, F.Column] | None = None) -> DataFrame:
    """Row-local parsing of the eleven raw columns; the columns in ``keep`` are passed on.

    ``marks`` adds columns made from the whitespace-normalised columns (under their names)
    and the raw text columns (as ``_raw_<name>``), which are computed once for both.

    Text columns are whitespace-normalised and null-token mapped; numbers are
    parsed (garbage -> null); the date is strictly parsed and re-emitted as ISO
    text; the discount flag is standardised. ``_date`` keeps the parsed date and
    the ``_bad_*`` booleans feed the audit counters.

    Written as stacked projections so each regular expression runs once per
    value (Catalyst does not collapse projections that would repeat them).
    """
    keep, marks = keep or [], marks or {}
    before = [F.col(c).alias(f"_raw_{c}") for c in TEXT_COLUMNS] if marks else []
    stripped = raw.select(*[X.strip_text(F.col(c)).alias(c) for c in RAW_COLUMNS], *before, *keep)
    tokened = stripped.select(
        *[X.null_token(F.col(c), case_insensitive).alias(c) for c in TEXT_COLUMNS + NUMERIC_COLUMNS],
        F.col("transaction_date").alias("_date_text"),
        F.lower(F.col("discount_applied")).alias("_disc"),
        X.null_token(F.col("discount_applied"), True).isNull().alias("_disc_missing"), *[m.alias(n) for n, m in marks.items()], *keep)
    keep = [*marks, *keep]
    numbers = tokened.select(
        *[F.col(c) for c in TEXT_COLUMNS],
        *[F.when(F.col(c).rlike(X.NUMBER_PATTERN), F.col(c).try_cast("double")).alias(c) for c in NUMERIC_COLUMNS],
        *[F.col(c).isNotNull().alias(f"_present_{c}") for c in NUMERIC_COLUMNS],
        F.when(F.col("_date_text").rlike(X.DATE_PATTERN), F.col("_date_text").try_cast("date")).alias("_date"),
        "_disc", "_disc_missing", *keep)
    codes = None
    for key, code in X.DISCOUNT_CODES.items():
        cond = F.col("_disc") == key
        codes = F.when(cond, code) if codes is None else codes.when(cond, code)
    return numbers.select(
        *[F.col(c) for c in RAW_COLUMNS if c not in ("transaction_date", "discount_applied")],
        iso_text(F.col("_date")).alias("transaction_date"),
        codes.otherwise(F.lit("Unknown")).alias("discount_applied"),
        "_date",
        *[(F.col(f"_present_{c}") & F.col(c).isNull()).alias(f"_bad_{c}") for c in NUMERIC_COLUMNS],
        F.when(F.col("_disc_missing"), "missing")
         .when(F.col("_disc").isin(list(X.DISCOUNT_CODES)), "mapped")
         .otherwise("unexpected").alias("_discount_outcome"),
        *keep,
    ).select(*RAW_COLUMNS, "_date", *[f"_bad_{c}" for c in NUMERIC_COLUMNS], "_discount_outcome", *keep)


def derive_price(df: DataFrame, strict: bool = False) -> DataFrame:
    """Fill a missing unit price with total / quantity and flag it.

    Applies when price is null, quantity is present and non-zero and total is
    present. ``strict`` also demands a positive price that multiplies back to
    the total (symmetric 1e-9 tolerance). Keeps the recorded price in
    ``_price_recorded`` for the item lookup.
    """
    p, q, t = F.col("price_per_unit"), F.col("quantity"), F.col("total_spent")
    mask = p.isNull() & q.isNotNull() & (q != 0) & t.isNotNull()
    derived = F.try_divide(t, q)
    if strict:
        mask = mask & (derived > 0) & N.isclose_symmetric(derived * q, t)
    return (df.withColumn("_price_recorded", p)
              .withColumn("price_imputed", N.yes_no(mask))
              .withColumn("price_per_unit", F.when(mask, derived).otherwise(p)))


def item_map(df: DataFrame) -> DataFrame:
    """(category, _pkey, _map_item): pairs of category and recorded price that
    identify exactly one recorded item.

    Built from rows where category, recorded price and recorded item are all
    present; one row per distinct pair. Rows are first made distinct by hash,
    so neither the decimal key nor the smallest and largest item (text, which
    Spark aggregates by sorting) is made for every row.
    """
    price = F.col("_price_recorded") if "_price_recorded" in df.columns else F.col("price_per_unit")
    src = df.where(F.col("category").isNotNull() & price.isNotNull() & F.col("item").isNotNull())
    # The row count keeps the optimizer from merging both steps, as it does with a distinct() below min and max.
    return (src.groupBy("category", price.alias("_price"), "item").agg(F.count(F.lit(1)).alias("_n"))
               .groupBy("category", price_key(F.col("_price")).alias("_pkey"))
               .agg(F.min("item").alias("_map_item"), F.max("item").alias("_max_item"), F.sum("_n").alias("_rows"))
               .where((F.col("_map_item") == F.col("_max_item")) & (F.col("_rows") > 0))
               .select("category", "_pkey", "_map_item"))


def item_price_map(df: DataFrame) -> DataFrame:
    """(item, price): items whose recorded price is a single value."""
    price = F.col("_price_recorded") if "_price_recorded" in df.columns else F.col("price_per_unit")
    src = df.where(F.col("item").isNotNull() & price.isNotNull())
    return (src.groupBy("item")
               .agg(F.count_distinct(price_key(price)).alias("_n"), F.min(price).alias("price"))
               .where(F.col("_n") == 1).select("item", "price"))


def impute_item(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Fill a missing item from the unique (category, price) mapping and flag it.

    Only rows that need the lookup (item missing, category and price present)
    take part in the join; the rest bypass it, so the fact table is never
    shuffled for it and a hot (category, price) pair touches only the rows
    that are missing an item. AQE broadcasts the mapping when its measured
    size is small and splits skewed partitions otherwise. A null key never
    matches.
    """
    need = F.col("item").isNull() & F.col("category").isNotNull() & F.col("price_per_unit").isNotNull()
    cols = df.columns
    rest = df.where(~need).withColumn("item_imputed", F.lit("No"))
    todo = (df.where(need).withColumn("_pkey", price_key(F.col("price_per_unit")))
              .join(mapping, ["category", "_pkey"], "left")
              .withColumn("item_imputed", N.yes_no(F.col("_map_item").isNotNull()))
              .withColumn("item", F.coalesce(F.col("item"), F.col("_map_item")))
              .select(*cols, "item_imputed"))
    return rest.unionByName(todo)


def quantity_is_whole(df: DataFrame) -> DataFrame:
    """One row: are all present quantities whole numbers (|q - floor q| <= 1e-8)?"""
    q = F.col("quantity")
    return df.agg(
        F.coalesce(F.bool_and(F.when(q.isNotNull(), F.abs(q - F.floor(q)) <= 1e-8)), F.lit(True))
         .alias("quantity_whole"),
        F.count_if(q.isNotNull() & (F.abs(q - F.floor(q)) > 1e-8)).alias("non_integer_quantities"))


def whole_quantity(df: DataFrame, mode: str | bool = "auto") -> DataFrame:
    """Cast quantity to bigint when every present value is whole.

    ``mode``: "auto" decides from the data (one boolean aggregate), True
    forces the cast, False keeps double.
    """
    if mode == "auto":
        mode = bool(quantity_is_whole(df).first()["quantity_whole"])
    if mode:
        return df.withColumn("quantity", F.round(F.col("quantity")).cast("bigint"))
    return df


def iqr_bounds(df: DataFrame, col: str = "total_spent", k: float = 1.5,
               buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """One row (q1, q3, lower, upper) from exact linear-interpolated quartiles."""
    qs = exact_quantiles(df, col, [0.25, 0.75], buckets)
    row = qs.groupBy().agg(F.max(F.when(F.col("pi") == 0, F.col("q"))).alias("q1"),
                           F.max(F.when(F.col("pi") == 1, F.col("q"))).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return row.select("q1", "q3", (F.col("q1") - k * iqr).alias("lower_bound"),
                      (F.col("q3") + k * iqr).alias("upper_bound"))


def flag_outliers(df: DataFrame, bounds: DataFrame, col: str = "total_spent") -> DataFrame:
    """Flag (never drop) values outside the inclusive IQR bounds.

    The bounds are one row by construction, so broadcasting them is safe.
    """
    b = F.broadcast(bounds.select("lower_bound", "upper_bound"))
    v = F.col(col)
    return (df.crossJoin(b)
              .withColumn("total_outlier_iqr",
                          N.yes_no(v.isNotNull() & ~v.between(F.col("lower_bound"), F.col("upper_bound"))))
              .drop("lower_bound", "upper_bound"))


def arithmetic_issue(df: DataFrame, rtol: float = 1e-9, atol: float = 1e-9) -> DataFrame:
    """Flag complete rows where price x quantity differs from the total."""
    p, q, t = F.col("price_per_unit"), F.col("quantity"), F.col("total_spent")
    complete = p.isNotNull() & q.isNotNull() & t.isNotNull()
    return df.withColumn("arithmetic_issue", N.yes_no(complete & ~N.isclose(p * q, t, rtol, atol)))


def missing_pattern_expr() -> F.Column:
    """Comma-joined names of analytical fields that are null or "Unknown", else "Complete"."""
    from tallyspark.schema import DISPLAY_NAMES
    parts = []
    for c in ANALYTICAL_FIELDS:
        col = F.col(c)
        # A number is never "Unknown", and turning it into text costs more than all other rules of the row.
        gone = col.isNull() if c in NUMERIC_COLUMNS else col.isNull() | (col.cast("string") == "Unknown")
        parts.append(F.when(gone, F.lit(DISPLAY_NAMES[c])))
    joined = F.concat_ws(", ", *parts)
    return F.when(joined == "", F.lit("Complete")).otherwise(joined)


def add_audit_columns(df: DataFrame) -> DataFrame:
    """Calendar parts and the missing pattern, from the parsed date."""
    cal = calendar_columns(F.col("_date"))
    return df.select("*", *[c.alias(n) for n, c in cal.items()],
                     missing_pattern_expr().alias("missing_pattern"))


def clean_parsed(parsed: DataFrame, *, strict_price: bool = False, quantity_mode: str | bool = "auto",
                 buckets: int = DEFAULT_BUCKETS, keep_internal: bool = False, bounds: DataFrame | None = None) -> DataFrame:
    """Cleaning rules after ``parse_raw``; ``bounds`` (one row, see ``iqr_bounds``) are computed here if not given.

    Order of rules: derive price -> item lookup (map from recorded prices,
    applied to recorded-or-derived prices) -> whole-quantity cast ->
    arithmetic flag -> calendar parts -> IQR flag -> missing pattern.
    """
    priced = derive_price(parsed, strict=strict_price)
    mapping = item_map(priced)
    imputed = impute_item(priced, mapping)
    if quantity_mode == "auto":
        quantity_mode = bool(quantity_is_whole(parsed).first()["quantity_whole"])
    typed = whole_quantity(imputed, quantity_mode)
    flagged = arithmetic_issue(typed)
    audited = add_audit_columns(flagged)
    # Quartiles depend only on the parsed totals, so they are computed from
    # the parsed table (before the lookup join), not from the imputed one.
    bounded = flag_outliers(audited, iqr_bounds(parsed, buckets=buckets) if bounds is None else bounds)
    if keep_internal:
        return bounded
    return bounded.select(*CLEAN_COLUMNS)


def clean(raw: DataFrame, *, case_insensitive: bool = False, strict_price: bool = False,
          quantity_mode: str | bool = "auto", buckets: int = DEFAULT_BUCKETS,
          keep_internal: bool = False) -> DataFrame:
    """Full cleaning: raw text table -> 21-column cleaned table.

    The parsed table is written once to the shared folder (see ``write_clean_table``);
    the result is lazy and reads it, so the folder stays.
    """
    parsed, _ = written_once(parse_raw(raw, case_insensitive), "parsed")
    return clean_parsed(parsed, strict_price=strict_price, quantity_mode=quantity_mode,
                        buckets=buckets, keep_internal=keep_internal)


def write_clean_table(raw: DataFrame, path: str, *, case_insensitive: bool = False, strict_price: bool = False,
                      quantity_mode: str | bool = "auto", buckets: int = DEFAULT_BUCKETS,
                      keep_internal: bool = False, partition_by: list[str] | None = None) -> None:
    """Cleaning ETL: parse once, derive every side aggregate from that, write Parquet.

    The parsed table feeds the main rows, the item map, the lookup branch and
    every counting round of the IQR bounds, so it is written to the shared folder
    for the duration of the write instead of re-reading and re-parsing the input
    for each consumer. Each reads only its columns of it, memory does not grow
    with the table, and filters on parsed values stop at the file: pushed below the
    parsing projections they would hold every regular expression several times.
    """
    parsed, scratch = written_once(parse_raw(raw, case_insensitive), "parsed")
    try:
        out = clean_parsed(parsed, strict_price=strict_price, quantity_mode=quantity_mode, buckets=buckets,
                           keep_internal=keep_internal)
        write_table(out, path, "overwrite", partition_by)
    finally:
        delete_folder(raw.sparkSession, scratch)


def transformation_counts(raw: DataFrame, cleaned_internal: DataFrame | None = None) -> DataFrame:
    """Long (rule, n) table of per-rule counters in a single pass over the data."""
    df = cleaned_internal if cleaned_internal is not None else clean(raw, keep_internal=True)
    exprs = {
        "rows": F.count(F.lit(1)),
        "invalid_price_per_unit": F.count_if("_bad_price_per_unit"),
        "invalid_quantity": F.count_if("_bad_quantity"),
        "invalid_total_spent": F.count_if("_bad_total_spent"),
        "invalid_dates": F.count_if(F.col("_date").isNull()),
        "price_derived": F.count_if(F.col("price_imputed") == "Yes"),
        "item_inferred": F.count_if(F.col("item_imputed") == "Yes"),
        "discount_unknown": F.count_if(F.col("discount_applied") == "Unknown"),
        "discount_missing": F.count_if(F.col("_discount_outcome") == "missing"),
        "discount_unexpected": F.count_if(F.col("_discount_outcome") == "unexpected"),
        "arithmetic_issues": F.count_if(F.col("arithmetic_issue") == "Yes"),
        "iqr_flagged": F.count_if(F.col("total_outlier_iqr") == "Yes"),
    }
    one = df.agg(*[e.cast("long").alias(k) for k, e in exprs.items()])
    stack = ", ".join(f"'{k}', `{k}`" for k in exprs)
    return one.selectExpr(f"stack({len(exprs)}, {stack}) as (rule, n)")
