"""Consistency checks.  Each returns its violations; an empty result is a pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.functions import month_of_date_id
from carelake.operators.dedup import latest_per_key
from carelake.operators.marts import COMPLETED, status_is
from carelake.operators.upsert import upsert_metrics


def check_duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with the count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_duplicate_fingerprints(fact: DataFrame) -> DataFrame:
    return check_duplicate_keys(fact, ["appointment_fingerprint"])


def check_surrogate_collisions(df: DataFrame, surrogate: str, natural: Sequence[str]) -> DataFrame:
    """Surrogate keys shared by different natural keys."""
    different = df.select(surrogate, *natural).distinct()
    return check_duplicate_keys(different, [surrogate])


def completed_totals(mart: DataFrame, fact: DataFrame) -> DataFrame:
    """One row: completed appointments in the mart and in the facts it covers."""
    in_mart = mart.agg(F.coalesce(F.sum("completed_appointments"), F.lit(0)).alias("mart_completed"))
    covered = fact.filter(F.col("professional_id").isNotNull())
    in_fact = covered.agg(F.count_if(status_is(COMPLETED)).alias("fact_completed"))
    one = F.lit(1).alias("_one")
    return in_mart.select("*", one).join(in_fact.select("*", one), "_one").drop("_one")


def check_completed_totals(mart: DataFrame, fact: DataFrame) -> DataFrame:
    return completed_totals(mart, fact).filter("mart_completed <> fact_completed")


def completed_by_month(mart: DataFrame, fact: DataFrame) -> DataFrame:
    """(month, mart_completed, fact_completed) for every month of either side; one aggregate of each."""
    in_mart = mart.groupBy(F.col("appointment_period").alias("month")).agg(F.sum("completed_appointments").alias("mart_completed"))
    in_fact = (
        fact.filter(F.col("professional_id").isNotNull())
        .groupBy(month_of_date_id("date_id").alias("month"))
        .agg(F.count_if(status_is(COMPLETED)).alias("fact_completed"))
    )
    both = in_mart.join(in_fact, "month", "full_outer")
    return both.select("month", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("mart_completed", "fact_completed")])


def check_completed_by_month(mart: DataFrame, fact: DataFrame) -> DataFrame:
    return completed_by_month(mart, fact).filter("mart_completed <> fact_completed")


# Fact column -> dimension it must resolve in.
FACT_REFERENCES = {
    "created_date_id": ("dim_date", "date_id"),
    "date_id": ("dim_date", "date_id"),
    "professional_id": ("dim_professional", "professional_id"),
    "patient_id": ("dim_patient", "patient_id"),
    "clinic_id": ("dim_clinic", "clinic_id"),
    "report_id": ("dim_report", "report_id"),
}


def reference_counts(fact: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    """(column_name, orphans, nulls) per fact reference, from one scan of the facts.

    Values are counted per column and distinct key before the join, so a hot key is one row in it.
    """
    names = list(FACT_REFERENCES)
    used = (
        fact.select([F.col(c).cast("string").alias(c) for c in names])
        .unpivot([], names, "column_name", "k")
        .groupBy("column_name", "k")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = None
    for column, (dim, key) in FACT_REFERENCES.items():
        part = dims[dim].select(F.lit(column).alias("column_name"), F.col(key).cast("string").alias("k")).distinct()
        known = part if known is None else known.unionByName(part)
    joined = used.join(known.withColumn("known", F.lit(True)), ["column_name", "k"], "left")
    counted = joined.groupBy("column_name").agg(
        F.sum(F.when(F.col("k").isNotNull() & F.col("known").isNull(), F.col("n"))).alias("orphans"),
        F.sum(F.when(F.col("k").isNull(), F.col("n"))).alias("nulls"),
    )
    every = fact.sparkSession.createDataFrame([(c,) for c in names], "column_name string")
    zero = F.lit(0).cast("bigint")
    return every.join(counted, "column_name", "left").select(
        "column_name", F.coalesce("orphans", zero).alias("orphans"), F.coalesce("nulls", zero).alias("nulls")
    )


def check_references(fact: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    """References that do not resolve, and facts without a date."""
    counts = reference_counts(fact, dims)
    return counts.filter((F.col("orphans") > 0) | ((F.col("column_name") == "date_id") & (F.col("nulls") > 0)))


def check_rerun_inserts(target: DataFrame, src: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A second load of the same source must insert nothing."""
    return upsert_metrics(target, src, keys).filter("inserted > 0")


def deduplicate_facts(fact: DataFrame) -> DataFrame:
    """Old facts, one kept per fingerprint: the smallest fact id."""
    return latest_per_key(fact, ["appointment_fingerprint"], [F.col("id_fact_appointment").asc()])


def filled_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, filled) for columns that should be empty."""
    counts = df.agg(*[F.count(c).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "filled")


# Model columns that hold no names; a filled name is the hash of one (hexadecimal, 32 digits).
MODEL_NAMES = {"dim_patient": ("first_name", "last_name"), "dim_professional": ("full_name",)}
_HASHED_NAMES = ("full_name",)


def model_pii(model: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, filled): personal values found in the star schema, names that are no hash included."""
    parts = []
    for table, columns in MODEL_NAMES.items():
        if table not in model:
            continue
        counts = model[table].agg(
            *[
                F.count_if(F.col(c).isNotNull() & ~F.col(c).rlike(r"\A[0-9a-f]{32}\z") if c in _HASHED_NAMES else F.col(c).isNotNull()).alias(c)
                for c in columns
            ]
        )
        parts.append(counts.unpivot([], list(columns), "column_name", "filled").select(F.lit(table).alias("table_name"), "column_name", "filled"))
    return reduce(DataFrame.unionByName, parts)


def check_model_pii(model: Mapping[str, DataFrame]) -> DataFrame:
    return model_pii(model).filter("filled > 0")


def check_pii(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    if not present:
        return filled_counts(df.withColumn("_none", F.lit(None).cast("string")), ["_none"]).filter("filled > 0")
    return filled_counts(df, present).filter("filled > 0")
