"""Calendar expressions over the parsed transaction date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.text import DATE_PATTERN

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def parsed_date(d: Column) -> Column:
    """The date of ISO date text (or of a date); null for text that is no date, instead of an error under ANSI rules."""
    text = d.cast("string")
    return F.when(text.rlike(DATE_PATTERN), text.try_cast("date"))


def month_key(d: Column) -> Column:
    """yyyy-MM text month of a date or ISO date text."""
    return F.date_format(parsed_date(d), "yyyy-MM")


def iso_text(d: Column) -> Column:
    """yyyy-MM-dd text of a date; years before 1 go through the slower formatter, which counts them by era."""
    return F.when(F.year(d) >= 1, d.cast("string")).otherwise(F.date_format(d, "yyyy-MM-dd"))


def calendar_columns(d: Column) -> dict[str, Column]:
    """Year, month, English month name, quarter label and weekday name."""
    return {
        "year": F.year(d),
        "month": F.month(d),
        "month_name": F.when(d.isNotNull(), F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(d))),
        "quarter": F.when(d.isNotNull(), F.concat(F.lit("Q"), F.quarter(d).cast("string"))),
        "weekday": F.when(d.isNotNull(), F.element_at(F.array(*[F.lit(w) for w in WEEKDAYS]), F.weekday(d) + 1)),
    }


def is_month_end(d: Column) -> Column:
    return F.last_day(d) == d
