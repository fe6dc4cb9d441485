"""Configuration: where sources live, how a partner names things, which options apply."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from carelake.functions.clean import TimeRule
from carelake.schemas import PII_COLUMNS


@dataclass(frozen=True)
class ValueMap:
    """Spellings per label for one column; ``default`` for everything else."""

    labels: Mapping[str, tuple[str, ...]]
    default: str | None = None


@dataclass(frozen=True)
class FieldMap:
    """A partner's names and values, by entity.

    ``tables``: entity -> source table name.  ``columns``: entity -> {source column: raw column}.
    ``values``: entity -> {raw column: ValueMap}.  ``pii``: columns nulled on load.  ``times``: how times are written.
    """

    tables: Mapping[str, str] = field(default_factory=dict)
    columns: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    values: Mapping[str, Mapping[str, ValueMap]] = field(default_factory=dict)
    pii: tuple[str, ...] = PII_COLUMNS
    times: TimeRule = field(default_factory=TimeRule)

    def table_name(self, entity: str) -> str:
        return self.tables.get(entity, entity)

    @classmethod
    def from_json(cls, text: str) -> FieldMap:
        raw = json.loads(text)
        values = {
            entity: {
                column: ValueMap({k: tuple(v) for k, v in spec["labels"].items()}, spec.get("default"))
                for column, spec in columns.items()
            }
            for entity, columns in raw.get("values", {}).items()
        }
        return cls(
            tables=raw.get("tables", {}),
            columns=raw.get("columns", {}),
            values=values,
            pii=tuple(raw.get("pii", PII_COLUMNS)),
            times=TimeRule(**raw.get("times", {})),
        )


@dataclass(frozen=True)
class SourceConfig:
    """``format``: parquet | csv | orc | json | jdbc | table.

    File formats read ``<path>/<table>`` (or ``<path>/<table>.<format>``).  csv needs ``multiLine``.
    For jdbc give ``url`` and ``partitionColumn``/``lowerBound``/``upperBound``/``numPartitions`` (or
    ``singlePartition=true``) in ``options`` or, per entity, in ``table_options``.
    """

    format: str = "parquet"
    path: str | None = None
    database: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)
    table_options: Mapping[str, Mapping[str, str]] = field(default_factory=dict)


@dataclass(frozen=True)
class RefreshConfig:
    root: str
    source: SourceConfig = field(default_factory=SourceConfig)
    fields: FieldMap = field(default_factory=FieldMap)
    as_of: str | None = None
    price_locale: str | None = None
    strict_minor_bucket: bool = False
    key_salt: str = ""
    seed_empty_tables: bool = False
    #: Facts of appointments that have moved to another date stay beside the new ones, as in the source system.
    keep_superseded: bool = False
    #: Published runs whose tables are kept.
    keep_runs: int = 3
