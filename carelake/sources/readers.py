"""Source tables to the raw layer: scan, rename, align, cast to text, null personal data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.config import FieldMap, SourceConfig
from carelake.functions import map_values
from carelake.schemas import PII_COLUMNS, SEED_ROWS, TableSpec

_FILE_FORMATS = ("parquet", "csv", "orc", "json")


class SourceTableMissing(LookupError):
    """A source table was not found."""


def read_source(spark: SparkSession, cfg: SourceConfig, table: str) -> DataFrame:
    """One source table; Spark splits the scan, nothing passes through the driver."""
    options = {**cfg.options, **cfg.table_options.get(table, {})}
    if cfg.format == "csv":
        # Text stays text: no schema inference, no extra pass.
        options = {"header": "true", "inferSchema": "false", "escape": '"', **options}
        if "multiLine" not in options:
            raise ValueError(
                "say for csv whether values hold line breaks: multiLine=false lets Spark split files,"
                " multiLine=true reads each file, of any size, in one task"
            )
    try:
        if cfg.format in _FILE_FORMATS:
            return _read_files(spark, cfg, table, options)
        if cfg.format == "table":
            return spark.table(quoted_name(cfg.database, table, "`"))
        if cfg.format == "jdbc":
            options = jdbc_options(cfg.database, table, options)
            return spark.read.format("jdbc").options(**options).load()
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"):
            raise SourceTableMissing(f"source table {table!r} not found") from error
        raise
    raise ValueError(f"unknown source format: {cfg.format!r}")


def quoted_name(database: str | None, table: str, quote: str) -> str:
    """Every part quoted, since a schema's name may hold a hyphen; ``database`` may have several parts."""
    parts = [*(database.split(".") if database else []), table]
    return ".".join(quote + part.replace(quote, quote * 2) + quote for part in parts)


_PARTITIONING = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")


def jdbc_options(database: str | None, table: str, options: Mapping[str, str]) -> dict[str, str]:
    """Options of a jdbc read, with its quoted name (``quote`` sets the sign, ``"`` by default)."""
    options = dict(options)
    single = options.pop("singlePartition", "false").lower() == "true"
    name = quoted_name(database, table, options.pop("quote", '"'))
    if not single and not all(o in options for o in _PARTITIONING):
        raise ValueError(f"{table}: set {', '.join(_PARTITIONING)}, or singlePartition=true to read it in one task")
    return {**options, "dbtable": options.get("dbtable", name)}


def _read_files(spark: SparkSession, cfg: SourceConfig, table: str, options: Mapping[str, str]) -> DataFrame:
    reader = spark.read.format(cfg.format).options(**options)
    try:
        return reader.load(f"{cfg.path}/{table}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return reader.load(f"{cfg.path}/{table}.{cfg.format}")


def rename(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Partner column names to raw column names."""
    return df.withColumnsRenamed(dict(columns))


def align(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly ``columns``, in order: absent ones NULL, others dropped before the scan."""
    present = set(df.columns)
    return df.select(
        [F.col(c) if c in present else F.lit(None).cast("string").alias(c) for c in columns]
    )


def _iso(c: Column, with_zone: bool) -> Column:
    zone = "xxx" if with_zone else ""
    base = "yyyy-MM-dd'T'HH:mm:ss"
    whole = F.date_trunc("second", c) == c
    return F.when(whole, F.date_format(c, base + zone)).otherwise(F.date_format(c, base + ".SSSSSS" + zone))


def to_text(df: DataFrame) -> DataFrame:
    """Every column as text: times as ISO-8601, booleans as True/False, NULL stays NULL."""

    def text(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, T.StringType):
            return c
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            return _iso(c, isinstance(field.dataType, T.TimestampType)).alias(field.name)
        if isinstance(field.dataType, T.BooleanType):
            return F.when(c, "True").when(~c, "False").alias(field.name)
        return c.cast("string").alias(field.name)

    return df.select([text(f) for f in df.schema.fields])


def null_pii(df: DataFrame, columns: Sequence[str] = PII_COLUMNS) -> DataFrame:
    present = [c for c in df.columns if c in set(columns)]
    return df.withColumns({c: F.lit(None).cast("string") for c in present}) if present else df


def apply_value_maps(df: DataFrame, fields: FieldMap, entity: str) -> DataFrame:
    maps = fields.values.get(entity, {})
    mapped = {c: map_values(c, m.labels, m.default) for c, m in maps.items() if c in df.columns}
    return df.withColumns(mapped) if mapped else df


def seed_if_empty(df: DataFrame, row: Mapping[str, str]) -> DataFrame:
    """One sample row for an empty table.  Puts invented rows in the marts: off by default."""
    if not df.isEmpty():
        return df
    values = tuple(row.get(c) for c in df.columns)
    return df.sparkSession.createDataFrame([values], df.schema)


def empty_df(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def raw_table(source: DataFrame, spec: TableSpec, fields: FieldMap, seed: bool = False) -> DataFrame:
    """A source table in raw layout."""
    renamed = rename(source, fields.columns.get(spec.name, {}))
    # PII columns are nulled before they are cast, so their bytes are never read.
    aligned = null_pii(align(renamed, spec.raw_columns), fields.pii)
    raw = apply_value_maps(to_text(aligned), fields, spec.name)
    # The sample row holds personal data of nobody; it is nulled like any other.
    return null_pii(seed_if_empty(raw, SEED_ROWS.get(spec.name, {})), fields.pii) if seed else raw
