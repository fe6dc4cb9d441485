from carelake.functions.clean import (
    as_utc_timestamp,
    blank_to_null,
    clean_id,
    guarded_int,
    is_numeric_key,
    keep_nonblank_key,
    keep_nonnull_key,
    keep_numeric_key,
    map_values,
    parse_bool,
    parse_price,
    to_utc,
)
from carelake.functions.keys import hashed_name, patient_key, surrogate
from carelake.functions.measures import (
    age_bucket,
    age_years,
    calendar_month,
    date_id,
    exact_mean,
    fingerprint,
    growth,
    label,
    month_of_date_id,
    pct,
    waiting_minutes,
)

__all__ = [
    "age_bucket",
    "age_years",
    "as_utc_timestamp",
    "blank_to_null",
    "calendar_month",
    "clean_id",
    "date_id",
    "exact_mean",
    "fingerprint",
    "growth",
    "guarded_int",
    "hashed_name",
    "is_numeric_key",
    "keep_nonblank_key",
    "keep_nonnull_key",
    "keep_numeric_key",
    "label",
    "map_values",
    "month_of_date_id",
    "parse_bool",
    "parse_price",
    "patient_key",
    "pct",
    "surrogate",
    "to_utc",
    "waiting_minutes",
]
