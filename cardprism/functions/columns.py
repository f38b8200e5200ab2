"""Scalar column helpers.

All helpers return ``Column`` expressions built from ``pyspark.sql.functions``
so they stay inside whole-stage codegen.  Null rules follow the reference's
pandas semantics (see SURVEY §1.5): a predicate over a missing value is
False but the row still counts in the denominator of a ratio.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hour_of(ts) -> Column:
    return F.hour(col_(ts))


def month_of(ts) -> Column:
    return F.month(col_(ts))


def weekday_mon0(ts) -> Column:
    """Day of week with Monday = 0 (``dayofweek`` would give Sunday = 1)."""
    return F.weekday(col_(ts))


def is_weekend(ts, days=(5, 6)) -> Column:
    return F.coalesce(weekday_mon0(ts).isin(list(days)), F.lit(False))


def is_holiday(ts, months=(11, 12, 1)) -> Column:
    return F.coalesce(month_of(ts).isin(list(months)), F.lit(False))


def day_part_flag(hour, start: int, end: int) -> Column:
    h = col_(hour)
    return F.coalesce((h >= start) & (h < end), F.lit(False))


def flag_ratio(flag) -> Column:
    """Mean of a boolean over all rows (nulls already mapped to False)."""
    return F.avg(col_(flag).cast("double"))


def safe_div(num, den) -> Column:
    """x / 0 -> NULL instead of an ANSI error or +-Inf."""
    return F.try_divide(col_(num), col_(den))


def elapsed_days(start, end) -> Column:
    """Whole elapsed 24 h days between two timestamps (not calendar days)."""
    return F.timestamp_diff("DAY", col_(start), col_(end))


def nan_to_null(c) -> Column:
    x = col_(c)
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def round6(c) -> Column:
    return F.round(col_(c), 6)
