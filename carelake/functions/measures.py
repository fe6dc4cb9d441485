"""Measures shared by the fact table, the marts and the dashboard queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Age groups (inclusive bounds), the catch-all and the label for no birth date.
AGE_GROUPS = ((18, 25, "18-25"), (26, 35, "26-35"), (36, 45, "36-45"), (46, 60, "46-60"))
AGE_OTHER = "60+"
AGE_UNKNOWN = "N/I"
NOT_INFORMED = "N/I"
SPECIALTY_NOT_INFORMED = "Não informada"

MICROS_PER_MINUTE = 60_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_date(as_of: dt.date | str | None) -> Column:
    if as_of is None:
        return F.current_date()
    return F.lit(as_of if isinstance(as_of, dt.date) else dt.date.fromisoformat(as_of))


def age_years(birth: Column | str, as_of: dt.date | str | None = None) -> Column:
    """Years completed at midnight of ``as_of`` (today when not given)."""
    b, r = _col(birth), as_date(as_of)
    b_day = F.month(b) * 100 + F.dayofmonth(b)
    r_day = F.month(r) * 100 + F.dayofmonth(r)
    later_that_day = b > F.date_trunc("day", b)
    pending = (b_day > r_day) | ((b_day == r_day) & later_that_day)
    return F.year(r) - F.year(b) - pending.cast("int")


def age_bucket(
    birth: Column | str, as_of: dt.date | str | None = None, strict_minor_bucket: bool = False
) -> Column:
    """Age group label.  Minors fall in the catch-all unless ``strict_minor_bucket``."""
    years = age_years(birth, as_of)
    out = F.when(_col(birth).isNull(), F.lit(AGE_UNKNOWN))
    if strict_minor_bucket:
        out = out.when(years < AGE_GROUPS[0][0], F.lit("<18"))
    for low, high, name in AGE_GROUPS:
        out = out.when(years.between(low, high), F.lit(name))
    return out.otherwise(F.lit(AGE_OTHER))


def _ratio(a: Column, b: Column) -> Column:
    return a.cast("decimal(20,0)") / F.nullif(b.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))


def pct(a: Column | str, b: Column | str) -> Column:
    """``a / b`` in percent, two decimals, NULL when ``b`` is 0; wide enough for any two counts."""
    return F.round(_ratio(_col(a), _col(b)) * 100, 2).cast("decimal(24,2)")


def growth(current: Column | str, previous: Column | str) -> Column:
    """Change against ``previous`` in percent; NULL without a positive ``previous``."""
    cur, prev = _col(current), _col(previous)
    return F.when(prev > 0, pct(cur - prev, prev))


def exact_mean(total: Column | str, n: Column | str) -> Column:
    """Mean of an exact sum, rounded half up once (no intermediate rounding of the average)."""
    count = F.nullif(_col(n).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return F.round(_col(total).cast("decimal(24,2)") / count, 2).cast("decimal(18,2)")


def waiting_minutes(created: Column | str, appointment: Column | str) -> Column:
    """Whole minutes from creation to appointment, rounded down (so -30 s is -1)."""
    micros = F.timestamp_diff("MICROSECOND", _col(created), _col(appointment))
    whole = micros - F.pmod(micros, F.lit(MICROS_PER_MINUTE))
    return F.call_function("div", whole, F.lit(MICROS_PER_MINUTE))


def date_id(c: Column | str) -> Column:
    """yyyymmdd; NULL for years that such a key cannot hold, so that one odd cell ends no run."""
    d = _col(c)
    return (F.year(d).cast("bigint") * 10000 + F.month(d) * 100 + F.dayofmonth(d)).try_cast("int")


def calendar_month(c: Column | str) -> Column:
    return F.trunc(_col(c).cast("date"), "month")


def date_of_id(c: Column | str) -> Column:
    i = _col(c)
    return F.make_date(
        F.call_function("div", i, F.lit(10000)).cast("int"),
        F.call_function("div", i % 10000, F.lit(100)).cast("int"),
        (i % 100).cast("int"),
    )


def month_of_date_id(c: Column | str) -> Column:
    """First day of the month of a yyyymmdd key; arithmetic instead of a date join."""
    i = _col(c)
    return F.make_date(
        F.call_function("div", i, F.lit(10000)).cast("int"),
        F.call_function("div", i % 10000, F.lit(100)).cast("int"),
        F.lit(1),
    )


def fingerprint(appointment_id: Column | str, date_key: Column | str) -> Column:
    return F.md5(
        F.concat(
            F.coalesce(_col(appointment_id), F.lit("")),
            F.lit("|"),
            F.coalesce(_col(date_key).cast("string"), F.lit("")),
        )
    )


def label(c: Column | str, default: str = NOT_INFORMED) -> Column:
    return F.coalesce(_col(c), F.lit(default))
