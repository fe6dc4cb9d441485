"""The four marts.  Every aggregate is algebraic, so hot groups shrink before the shuffle."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelake.functions import (
    age_bucket,
    calendar_month,
    exact_mean,
    growth,
    label,
    month_of_date_id,
    pct,
)
from carelake.functions.measures import SPECIALTY_NOT_INFORMED, date_of_id

# Status and modality labels the marts count.
COMPLETED = "completed"
CANCELLED = "cancelled"
ONLINE = "Online"
ON_SITE = "Presencial"


def status_is(value: str) -> Column:
    return F.lower(F.coalesce(F.col("status"), F.lit(""))) == value


def _active() -> Column:
    return F.coalesce(F.col("is_active"), F.lit(False))


def month_growth(monthly: DataFrame, month: str, total: str) -> DataFrame:
    """(month, growth_rate) against the previous month that is present.

    ``monthly`` holds one row per calendar month, so the ordered window over all of it is small.
    """
    previous = F.lag(total).over(Window.orderBy(month))
    return monthly.select(month, growth(F.col(total), previous).alias("growth_rate"))


def patient_counts(
    dim_patient: DataFrame, as_of: dt.date | str | None = None, strict_minor_bucket: bool = False
) -> DataFrame:
    """Active and inactive patients per group and month of registration; a month's rows need that month's alone."""
    base = dim_patient.filter(F.col("created_at").isNotNull()).select(
        calendar_month("created_at").alias("period_month"),
        age_bucket("birth_date", as_of, strict_minor_bucket).alias("age_group"),
        label("gender_identity").alias("gender_identity"),
        label("sexual_orientation").alias("sexual_orientation"),
        label("ethnic_group").alias("ethnic_group"),
        _active().alias("is_active"),
    )
    # patient_id is the dimension's key and never NULL, so active + inactive is the total.
    return base.groupBy(
        "period_month", "age_group", "gender_identity", "sexual_orientation", "ethnic_group"
    ).agg(
        F.count_if(F.col("is_active")).alias("active_patients"),
        F.count_if(~F.col("is_active")).alias("inactive_patients"),
    )


def patients_from_counts(counted: DataFrame) -> DataFrame:
    # Both uses of this aggregate read the same two counts and so share one shuffle.
    total = F.col("active_patients") + F.col("inactive_patients")
    monthly = counted.groupBy("period_month").agg(F.sum(total).alias("month_total"))
    return counted.join(month_growth(monthly, "period_month", "month_total"), "period_month").select(
        "period_month",
        "age_group",
        "gender_identity",
        "sexual_orientation",
        "ethnic_group",
        total.alias("total_patients"),
        "active_patients",
        "inactive_patients",
        pct(F.col("active_patients"), total).alias("active_percentage"),
        "growth_rate",
    )


def mart_patients(
    dim_patient: DataFrame, as_of: dt.date | str | None = None, strict_minor_bucket: bool = False
) -> DataFrame:
    return patients_from_counts(patient_counts(dim_patient, as_of, strict_minor_bucket))


def mart_patient_disability(dim_patient: DataFrame) -> DataFrame:
    types = dim_patient.filter(F.col("created_at").isNotNull()).select(
        calendar_month("created_at").alias("period_month"),
        F.explode("disability_type").alias("disability_type"),
        _active().alias("is_active"),
    )
    return (
        types.withColumn("disability_type", F.trim("disability_type"))
        .groupBy("period_month", "disability_type")
        .agg(
            F.count(F.lit(1)).alias("total_patients"),
            F.count_if(F.col("is_active")).alias("active_patients"),
            F.count_if(~F.col("is_active")).alias("inactive_patients"),
        )
    )


def ratings_by(fact: DataFrame, dim_report: DataFrame, key: str) -> DataFrame:
    """(key, rating_sum, rating_count) of the reports linked to facts."""
    rated = dim_report.filter(F.col("evaluation").isNotNull()).select("report_id", "evaluation")
    return (
        fact.select(key, "report_id")
        .join(rated, "report_id")
        .groupBy(key)
        .agg(F.sum("evaluation").alias("rating_sum"), F.count(F.lit(1)).alias("rating_count"))
    )


def _rating_totals(counted: DataFrame, dim_report: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """``counted`` (by, report_id, n and ``sums``) without reports: their ratings are summed up."""
    rated = dim_report.filter(F.col("evaluation").isNotNull()).select("report_id", "evaluation")
    return (
        counted.join(rated, "report_id", "left")
        .groupBy(*by)
        .agg(
            *[F.sum(c).alias(c) for c in sums],
            F.sum(F.col("evaluation") * F.col("n")).alias("rating_sum"),
            F.sum(F.when(F.col("evaluation").isNotNull(), F.col("n"))).alias("rating_count"),
        )
    )


def _professionals(dim_professional: DataFrame, totals: DataFrame) -> DataFrame:
    rating = F.coalesce(exact_mean("rating_sum", "rating_count"), F.lit(0).cast("decimal(18,2)"))
    return dim_professional.join(totals, "professional_id", "left").select(
        F.col("professional_id").alias("professional_sk"),
        "sexual_orientation",
        "ethnic_group",
        "gender_identity",
        "specialty",
        "state",
        "profile_status",
        "active",
        F.coalesce("total_appointments", F.lit(0)).alias("total_appointments"),
        rating.alias("avg_feedback_rating"),
    )


def mart_professionals(dim_professional: DataFrame, fact: DataFrame, dim_report: DataFrame) -> DataFrame:
    """One aggregation of the facts, per professional and report; reports are joined to its few rows."""
    counted = (
        fact.filter(F.col("professional_id").isNotNull())
        .groupBy("professional_id", "report_id")
        .agg(F.count_if(status_is(COMPLETED)).alias("total_appointments"), F.count(F.lit(1)).alias("n"))
    )
    return _professionals(dim_professional, _rating_totals(counted, dim_report, ["professional_id"], ["total_appointments"]))


_COUNTS = (
    "total_appointments",
    "completed_appointments",
    "completed_appointments_online",
    "completed_appointments_presencial",
    "cancelled_appointments_online",
    "cancelled_appointments_presencial",
)


def _appointment_sums() -> list[Column]:
    online, on_site = F.col("type") == ONLINE, F.col("type") == ON_SITE
    waited = F.nullif(F.col("waiting_time"), F.lit(0).cast("bigint"))
    return [
        F.count(F.lit(1)).alias("total_appointments"),
        F.count_if(status_is(COMPLETED)).alias("completed_appointments"),
        F.count_if(status_is(COMPLETED) & online).alias("completed_appointments_online"),
        F.count_if(status_is(COMPLETED) & on_site).alias("completed_appointments_presencial"),
        F.count_if(status_is(CANCELLED) & online).alias("cancelled_appointments_online"),
        F.count_if(status_is(CANCELLED) & on_site).alias("cancelled_appointments_presencial"),
        F.sum(waited).alias("waited_sum"),
        F.count(waited).alias("waited_count"),
        F.max("created_date_id").alias("last_created"),
    ]


def appointment_states(fact: DataFrame, dim_report: DataFrame) -> DataFrame:
    """Sums per professional and month, from which both marts of professionals follow.

    A month's rows need that month's facts alone, so a change of facts is carried over by making their months anew:
    the latest creation date needs no trace of those before it.
    """
    month = month_of_date_id("date_id").alias("period_month")
    kept = fact.filter(F.col("professional_id").isNotNull() & F.col("date_id").isNotNull())
    keys = ["professional_id", "period_month"]
    rated = (
        kept.filter(F.col("report_id").isNotNull())
        .groupBy("professional_id", month, "report_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ratings = _rating_totals(rated, dim_report, keys, [])
    return kept.groupBy("professional_id", month).agg(*_appointment_sums()).join(ratings, keys, "left")


def professionals_from_states(dim_professional: DataFrame, states: DataFrame) -> DataFrame:
    totals = states.groupBy("professional_id").agg(
        F.sum("completed_appointments").alias("total_appointments"),
        F.sum("rating_sum").alias("rating_sum"),
        F.sum("rating_count").alias("rating_count"),
    )
    return _professionals(dim_professional, totals)


def professional_appointments_from_states(dim_professional: DataFrame, states: DataFrame) -> DataFrame:
    """One row per state: a professional has one specialty, so the dimension is joined to sums."""
    specialties = dim_professional.select("professional_id", "specialty")
    total = F.col("total_appointments")
    return states.join(specialties, "professional_id", "left").select(
        F.col("professional_id").alias("professional_sk"),
        F.col("period_month").alias("appointment_period"),
        label("specialty", SPECIALTY_NOT_INFORMED).alias("specialty"),
        *_COUNTS,
        pct(F.col("completed_appointments"), total).alias("completion_rate"),
        pct(F.col("cancelled_appointments_online"), total).alias("cancellation_rate_online"),
        pct(F.col("cancelled_appointments_presencial"), total).alias("cancellation_rate_presencial"),
        exact_mean("waited_sum", "waited_count").alias("avg_waiting_time"),
        date_of_id("last_created").alias("created_at"),
    )


def mart_professional_appointments(dim_professional: DataFrame, fact: DataFrame) -> DataFrame:
    """Per professional and month; the facts are aggregated before the dimension is joined."""
    counted = (
        fact.filter(F.col("professional_id").isNotNull() & F.col("date_id").isNotNull())
        .groupBy("professional_id", month_of_date_id("date_id").alias("period_month"))
        .agg(*_appointment_sums())
    )
    return professional_appointments_from_states(dim_professional, counted)


def undated_rows(dim_patient: DataFrame) -> DataFrame:
    """How many patients the marts leave out for want of a creation date."""
    return dim_patient.agg(F.count_if(F.col("created_at").isNull()).alias("undated"))
