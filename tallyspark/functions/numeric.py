"""Numeric predicates and small expressions shared by cleaning and statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def isclose(a: Column, b: Column, rtol: float = 1e-9, atol: float = 1e-9) -> Column:
    """Asymmetric closeness test: |a - b| <= atol + rtol * |b|."""
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def isclose_symmetric(a: Column, b: Column, rel_tol: float = 1e-9, abs_tol: float = 1e-9) -> Column:
    """Symmetric closeness test: |a - b| <= max(rel_tol * max(|a|, |b|), abs_tol)."""
    return F.abs(a - b) <= F.greatest(F.lit(rel_tol) * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_tol))


def yes_no(cond: Column) -> Column:
    """Audit flag text: "Yes" where the condition holds, "No" otherwise (null included)."""
    return F.when(cond, F.lit("Yes")).otherwise(F.lit("No"))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, null when den is 0 or null."""
    return F.when(den != 0, num / den)
