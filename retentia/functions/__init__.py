from retentia.functions.columns import (
    clip,
    flag,
    ieq,
    ine_or_null,
    is_missing,
    month_of,
    nan_to_null,
    not_missing,
    ntz,
    recency_days,
    safe_ratio,
    week_of,
    whole_days,
)

__all__ = [
    "clip",
    "flag",
    "ieq",
    "ine_or_null",
    "is_missing",
    "month_of",
    "nan_to_null",
    "not_missing",
    "ntz",
    "recency_days",
    "safe_ratio",
    "week_of",
    "whole_days",
]
