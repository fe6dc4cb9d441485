"""Raw text to typed rows: one projection, one filter and one deduplication per table."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.functions import clean
from carelake.operators.dedup import any_per_key, latest_per_key, newest, newest_touched
from carelake.schemas import Column, TableSpec

ISO = clean.TimeRule()

_KEEP = {
    "numeric": clean.keep_numeric_key,
    "nonblank": clean.keep_nonblank_key,
    "nonnull": clean.keep_nonnull_key,
}


def _cleaned(column: Column, price_locale: str | None, times: clean.TimeRule) -> SparkColumn:
    rules = {
        "id": clean.clean_id,
        "trim": F.trim,
        "text": clean.blank_to_null,
        "asis": F.col,
        "int": clean.guarded_int,
        "bool": clean.parse_bool,
        "time": lambda c: clean.to_utc(c, times),
        "price": lambda c: clean.parse_price(c, price_locale),
    }
    return rules[column.rule](column.source)


def deciding(spec: TableSpec, columns: Collection[str]) -> list[Column]:
    """The columns that settle which row of a key has ``columns``.

    Ties are settled by the columns in their order.  Rows that tie up to the last one of ``columns`` agree in all of them, so
    what follows decides nothing that is asked for.
    """
    names = [c.target for c in spec.columns]
    if unknown := set(columns) - set(names):
        raise ValueError(f"not columns of {spec.name}: {sorted(unknown)}")
    last = max((names.index(c) for c in columns), default=-1)
    always = {spec.key} if spec.dedup == "any" else {spec.key, "created_at", "updated_at"}
    return [c for i, c in enumerate(spec.columns) if i <= last or c.target in always]


def clean_rows(
    raw: DataFrame,
    spec: TableSpec,
    price_locale: str | None = None,
    times: clean.TimeRule = ISO,
    columns: Collection[str] | None = None,
) -> DataFrame:
    """Eligible rows with typed columns, duplicates still in; all columns, or those that decide about ``columns``."""
    kept = _KEEP[spec.key_rule](raw, spec.raw_key)
    chosen = spec.columns if columns is None else deciding(spec, columns)
    typed = kept.select(*[_cleaned(c, price_locale, times).alias(c.target) for c in chosen])
    # A numeric key too large for its type cannot identify a row.  Said of every key: where a plan names a table twice, joins
    # would add it to one of them, and the two no longer share a shuffle.
    return typed.filter(F.col(spec.key).isNotNull())


def deduplicate(typed: DataFrame, spec: TableSpec) -> DataFrame:
    if spec.dedup == "any":
        return any_per_key(typed, [spec.key])
    order = newest() if spec.dedup == "updated" else newest_touched()
    return latest_per_key(typed, [spec.key], [order])


def build_typed(
    raw: DataFrame,
    spec: TableSpec,
    price_locale: str | None = None,
    times: clean.TimeRule = ISO,
    columns: Collection[str] | None = None,
) -> DataFrame:
    """One row per key: all columns, or, with the same values, ``columns`` and what has to be sorted to find them.

    Catalyst cannot drop a column that a sort for one row per key names, so what is not wanted is left out here.
    """
    return deduplicate(clean_rows(raw, spec, price_locale, times, columns), spec)


def rejected_values(
    raw: DataFrame, spec: TableSpec, price_locale: str | None = None, times: clean.TimeRule = ISO
) -> DataFrame:
    """Per typed column, how many filled raw values could not be read: (column_name, rejected)."""
    lossy = [c for c in spec.columns if c.lossy]
    if not lossy:
        raise ValueError(f"{spec.name} has no column that can reject values")
    counts = raw.agg(
        *[
            F.count_if(
                clean.clean_id(c.source).isNotNull() & _cleaned(c, price_locale, times).isNull()
            ).alias(c.target)
            for c in lossy
        ]
    )
    return counts.unpivot([], [c.target for c in lossy], "column_name", "rejected")
