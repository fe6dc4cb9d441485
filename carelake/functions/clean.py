"""Cleaning rules from raw text to typed values.

Every function maps a Column to a Column with built-in expressions, so a whole typed
table is one projection inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted spellings of true and false.
TRUE_WORDS = ("true", "t", "1", "yes", "y", "sim", "s")
FALSE_WORDS = ("false", "f", "0", "no", "n", "nao", "não")

# Appointment modality labels and the spellings that lead to them.
MODALITY = {
    "Online": ("online", "telemed", "teleconsulta", "remote", "remoto", "video"),
    "Presencial": ("presencial", "clinic", "local", "face-to-face"),
}
MODALITY_DEFAULT = "Outro"

# \A and \z: Java's $ would accept a trailing newline.
_DIGITS = r"\A[0-9]+\z"
# A full date, alone or with a time of day down to seconds: Spark reads these itself.  It also reads bare years,
# year-months and times of day, which count for nothing here.
_PLAIN_TIME = r"\A[0-9]{4,6}-[0-9]{1,2}-[0-9]{1,2}(?:[T ][0-9]{1,2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:[Zz]|[+-][0-9]{2}(?::?[0-9]{2})?)?)?\z"
_FULL_DATE = r"\A[0-9]{4,6}-[0-9]{1,2}-[0-9]{1,2}(?:[T ][0-9]|\z)"
_ZONED = r"(?:[Zz]|UTC|GMT|(?::[0-9]{2}|[Tt ][0-9]{4}|[Tt ][0-9]{6})(?:\.[0-9]+)?[ ]*[+-][0-9]{1,2}(?::?[0-9]{2})?)\z"
_HALF_DAY = r"[ ]*([AaPp][Mm])\z"
# Fixed value: the months' names, three letters each.
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_EPOCH_UNITS = {"s": 1_000_000, "ms": 1_000, "us": 1}


@dataclass(frozen=True)
class TimeRule:
    """How a partner writes times.

    ``order``: ``mdy`` or ``dmy``, for dates with slashes or dashes that begin with day or month.
    ``zone``: the zone of texts without one.  ``epoch``: whole numbers are seconds (``s``), ``ms`` or ``us``
    since 1970 in UTC.
    """

    order: str = "mdy"
    zone: str = "UTC"
    epoch: str | None = None

    def __post_init__(self) -> None:
        if self.order not in ("mdy", "dmy"):
            raise ValueError(f"unknown date order: {self.order!r}")
        if self.epoch is not None and self.epoch not in _EPOCH_UNITS:
            raise ValueError(f"unknown epoch unit: {self.epoch!r}")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_id(c: Column | str) -> Column:
    """Strip spaces; empty becomes NULL."""
    return F.nullif(F.trim(_col(c)), F.lit(""))


def blank_to_null(c: Column | str) -> Column:
    """Empty becomes NULL; blanks inside or around free text survive."""
    return F.nullif(_col(c), F.lit(""))


def is_numeric_key(c: Column | str) -> Column:
    return F.trim(_col(c)).rlike(_DIGITS)


def guarded_int(c: Column | str) -> Column:
    """Digits only, after trimming; everything else (and overflow) is NULL."""
    t = F.trim(_col(c))
    return F.when(t.rlike(_DIGITS), t.try_cast("int"))


def parse_bool(c: Column | str) -> Column:
    word = F.lower(F.trim(_col(c)))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _replaced(t: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    for pattern, form in steps:
        t = F.regexp_replace(t, pattern, form)
    return t


def _dashed(t: Column, order: str) -> Column:
    """The other ways to write a date, as year-month-day; a month's name may still stand in the middle."""
    slashed = "$3-$1-$2" if order == "mdy" else "$3-$2-$1"
    return _replaced(
        t,
        (
            (r"\A([0-9]{4})([0-9]{2})([0-9]{2})(?=\z|[Tt ])", "$1-$2-$3"),
            (r"\A([0-9]{4,6})[/.]([0-9]{1,2})[/.]([0-9]{1,2})", "$1-$2-$3"),
            (r"\A([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})", slashed),
            (r"\A([A-Za-z]{3,9})[- ]([0-9]{1,2})[-, ]+([0-9]{4})", "$3-$1-$2"),
            (r"\A([0-9]{1,2})[- ]([A-Za-z]{3,9})[-, ]+([0-9]{4})", "$3-$2-$1"),
        ),
    )


def _month_number(t: Column) -> Column:
    name = F.lower(F.regexp_extract(t, r"\A[0-9]{4,6}-([A-Za-z]{3})[a-z]*-", 1))
    # 1 to 12 by the name's place in the list; a name that is none gives 0, which no cast reads
    month = F.concat(F.lit("-"), F.ceil(F.instr(F.lit(_MONTHS), name) / 3).cast("string"), F.lit("-"))
    return F.when(name == "", t).otherwise(F.regexp_replace(t, F.lit("-[A-Za-z]+-"), month))


def _full_clock(t: Column) -> Column:
    """Times without seconds or signs, and short zones, as Spark reads them."""
    return _replaced(
        t,
        (
            (r"(?<=[0-9])(?:[Tt]|[ ]+)(?=[0-9])", "T"),
            (r"T([0-9]{2})([0-9]{2})(?=\z|[^0-9:])", "T$1:$2"),
            (r"T([0-9]{2})([0-9]{2})([0-9]{2})(?=\z|[^0-9:])", "T$1:$2:$3"),
            (r"T([0-9]{1,2}):([0-9]{2})(?=\z|[^0-9:])", "T$1:$2:00"),
            (r"[ ]*(?:[Zz]|UTC|GMT)\z", "Z"),
            (r"[ ]+(?=[+-][0-9:]+\z)", ""),
            (r"(:[0-9]{2}(?:\.[0-9]+)?[+-])([0-9])(?=\z|:)", "$10$2"),
        ),
    )


def _instant(t: Column) -> Column:
    twelve_hours = F.regexp_replace(F.upper(t), "[ ]*([AP]M)", " $1")
    half = F.try_to_timestamp(twelve_hours, F.lit("y-M-d'T'h:mm:ss a"))
    return F.when(t.rlike(_HALF_DAY), half).when(t.rlike(_FULL_DATE), t.try_cast("timestamp"))


def as_utc_timestamp(c: Column | str, rule: TimeRule = TimeRule()) -> Column:  # noqa: B008
    """Full dates, with or without time of day and zone; anything else is NULL.

    Dates: dashes, slashes, compact, month names.  Times: with or without seconds, compact, AM and PM.  Zones: Z, UTC,
    GMT, or an offset of hours with or without minutes.
    """
    t = F.trim(_col(c))
    other = _let(_dashed(t, rule.order), lambda d: _let(_full_clock(_month_number(d)), _instant))
    # A text without a digit is no time in any form: blanks and words are spared the other forms' patterns.
    read = F.when(t.rlike(_PLAIN_TIME), t.try_cast("timestamp")).when(t.rlike("[0-9]"), other)
    if rule.zone != "UTC":
        read = F.when(t.rlike(_ZONED), read).otherwise(F.to_utc_timestamp(read, rule.zone))
    if rule.epoch is None:
        return read
    micros = F.try_multiply(t.try_cast("bigint"), F.lit(_EPOCH_UNITS[rule.epoch]).cast("bigint"))
    return F.when(t.rlike(r"\A-?[0-9]+\z"), F.timestamp_micros(micros)).otherwise(read)


def to_utc(c: Column | str, rule: TimeRule = TimeRule()) -> Column:  # noqa: B008
    """Text timestamp, with or without offset, as UTC wall clock (needs a UTC session zone)."""
    return as_utc_timestamp(c, rule).cast("timestamp_ntz")


def parse_price(c: Column | str, locale: str | None = None) -> Column:
    """Keep digits, comma, dot and minus; comma is the decimal mark.

    ``locale='pt'`` also reads dots as thousands separators when a comma is present.
    """
    kept = F.regexp_replace(F.trim(_col(c)), "[^0-9,.-]", "")
    if locale == "pt":
        kept = F.when(F.contains(kept, F.lit(",")), F.replace(kept, F.lit("."), F.lit(""))).otherwise(kept)
    elif locale is not None:
        raise ValueError(f"unknown price locale: {locale!r}")
    return F.replace(kept, F.lit(","), F.lit(".")).try_cast("decimal(10,2)")


def map_values(
    c: Column | str,
    mapping: Mapping[str, tuple[str, ...]] = MODALITY,
    default: str | None = MODALITY_DEFAULT,
) -> Column:
    """Map spellings (compared in lower case) to labels; unknown and NULL give ``default``."""
    word = F.lower(_col(c))
    out = None
    for target, spellings in mapping.items():
        hit = word.isin(*(s.lower() for s in spellings))
        out = F.when(hit, F.lit(target)) if out is None else out.when(hit, F.lit(target))
    fallback = F.lit(default).cast("string")
    return fallback if out is None else out.otherwise(fallback)


def keep_numeric_key(df: DataFrame, c: str) -> DataFrame:
    return df.filter(is_numeric_key(c))


def keep_nonblank_key(df: DataFrame, c: str) -> DataFrame:
    return df.filter(clean_id(c).isNotNull())


def keep_nonnull_key(df: DataFrame, c: str) -> DataFrame:
    return df.filter(F.col(c).isNotNull())
