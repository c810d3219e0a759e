from basketry.functions.numbers import (
    all_known,
    exact_mean,
    exact_sum,
    money_mean,
    money_sum,
    ratio,
    round_digits,
)
from basketry.functions.text import abbreviate_id, format_currency, format_fixed, format_percent
from basketry.functions.times import (
    add_seconds,
    day_of_week,
    elapsed_days,
    late_flag,
    month_key,
    parse_timestamp,
    subtract,
)

__all__ = [
    "all_known",
    "abbreviate_id",
    "add_seconds",
    "day_of_week",
    "elapsed_days",
    "exact_mean",
    "exact_sum",
    "format_currency",
    "format_fixed",
    "format_percent",
    "late_flag",
    "money_mean",
    "money_sum",
    "month_key",
    "parse_timestamp",
    "ratio",
    "round_digits",
    "subtract",
]
