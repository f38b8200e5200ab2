"""Column-expression helpers (JVM-side, codegen-friendly)."""

from cardprism.functions.columns import (  # noqa: F401
    day_part_flag, elapsed_days, flag_ratio, hour_of, is_holiday, is_weekend,
    month_of, nan_to_null, safe_div, weekday_mon0,
)
