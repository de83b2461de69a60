"""Row-local parsing rules for the raw text columns, as JVM-side Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that mean "missing" after stripping (case-sensitive).
NULL_TOKENS = ["", "nan", "null", "none"]

# Discount spellings (lower-cased) and their standard code;
# anything else, missing included, becomes "Unknown".
DISCOUNT_CODES = {"true": "Yes", "yes": "Yes", "1": "Yes", "false": "No", "no": "No", "0": "No"}
DISCOUNT_VALUES = ["Yes", "No", "Unknown"]

# Unicode whitespace as Python's str.isspace sees it (Java's
# Unicode \s plus the information separators U+001C..U+001F), spelled as an
# explicit character class, which is cheaper than a Unicode property.
WHITESPACE_RUN = (r"[\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                  r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")

# Plain decimal or scientific notation, optional sign. Rejects thousands
# separators, underscores, hex, Java type suffixes (1d, 1f) and NaN/Infinity.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Year-month-day with 1- or 2-digit month and day; calendar validity is left
# to the date cast (2024-02-30 fails).
DATE_PATTERN = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"


def strip_text(c: Column) -> Column:
    """Collapse every whitespace run to one space, then drop the outer spaces.

    Most texts hold nothing outside the visible ASCII range: one range test passes them on, which is cheaper than the whitespace class."""
    return F.when(c.rlike("[^!-~]"), F.trim(F.regexp_replace(c, WHITESPACE_RUN, " "))).otherwise(c)


def null_token(c: Column, case_insensitive: bool = False) -> Column:
    """Null when the (already stripped) value is a missing-value token."""
    probe = F.lower(c) if case_insensitive else c
    return F.when(c.isNull() | probe.isin(NULL_TOKENS), F.lit(None).cast("string")).otherwise(c)


def clean_text(c: Column, case_insensitive: bool = False) -> Column:
    return null_token(strip_text(c), case_insensitive)


def is_present(c: Column, case_insensitive: bool = False) -> Column:
    return clean_text(c, case_insensitive).isNotNull()


def parse_number(c: Column, case_insensitive: bool = False) -> Column:
    """Tolerant numeric parse: unparseable text becomes null (counted elsewhere)."""
    s = clean_text(c, case_insensitive)
    return F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))


def invalid_number(c: Column, case_insensitive: bool = False) -> Column:
    """True when a value is present but does not parse as a number."""
    return is_present(c, case_insensitive) & parse_number(c, case_insensitive).isNull()


def parse_iso_date(c: Column) -> Column:
    """Strict year-month-day parse; anything else, blank included, is null."""
    s = strip_text(c)
    return F.when(s.rlike(DATE_PATTERN), s.try_cast("date"))


def discount_code(c: Column) -> Column:
    """Standardise the discount flag to Yes / No / Unknown."""
    key = F.lower(strip_text(c))
    expr = None
    for raw, code in DISCOUNT_CODES.items():
        expr = (F.when(key == raw, code) if expr is None else expr.when(key == raw, code))
    return expr.otherwise(F.lit("Unknown"))


def discount_outcome(c: Column) -> Column:
    """Audit label of the discount rule: missing, unexpected or mapped."""
    key = F.lower(strip_text(c))
    return (F.when(clean_text(c, case_insensitive=True).isNull(), "missing")
            .when(key.isin(list(DISCOUNT_CODES)), "mapped")
            .otherwise("unexpected"))
