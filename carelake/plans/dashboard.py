"""Dashboard queries over marts and model tables.

The first five are the coded charts; the rest are the documented tiles, whose formulas
are defined here.  Results are small; ordered ones are ordered as the charts need.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelake.functions import calendar_month, exact_mean, label, month_of_date_id, pct
from carelake.functions.measures import SPECIALTY_NOT_INFORMED
from carelake.operators.marts import CANCELLED, COMPLETED, month_growth, ratings_by, status_is

TOP = 10
SAMPLE_ROWS = 20


def mean_of(c: str) -> Column:
    """Unweighted mean of a decimal column, two decimals."""
    return exact_mean(F.sum(c), F.count(c))


def latest_month(mart: DataFrame) -> DataFrame:
    """One row: the newest month of a mart."""
    return mart.agg(F.max("period_month").alias("period_month"))


def in_latest_month(mart: DataFrame, months: DataFrame | None = None) -> DataFrame:
    """Mart rows of the newest month of ``months`` (the mart itself when not given)."""
    return mart.join(latest_month(mart if months is None else months), "period_month", "left_semi")


# --- coded charts -----------------------------------------------------------


def q_patients_per_month(patients: DataFrame) -> DataFrame:
    return (
        patients.groupBy(F.col("period_month").alias("month"))
        .agg(
            F.sum("total_patients").alias("total_patients"),
            mean_of("active_percentage").alias("avg_active_pct"),
        )
        .orderBy("month")
    )


def q_age_distribution(patients: DataFrame) -> DataFrame:
    return (
        in_latest_month(patients)
        .groupBy("age_group")
        .agg(
            F.sum("total_patients").alias("total_patients"),
            mean_of("active_percentage").alias("avg_active_pct"),
        )
        .orderBy(F.col("total_patients").desc(), "age_group")
    )


def q_top_disabilities(disability: DataFrame, patients: DataFrame) -> DataFrame:
    """Top ten types in the newest month of the patients mart."""
    return (
        in_latest_month(disability, patients)
        .select("disability_type", "total_patients")
        .orderBy(F.col("total_patients").desc_nulls_last(), "disability_type")
        .limit(TOP)
    )


def q_disability_share(disability: DataFrame) -> DataFrame:
    """Patients per type over all months, with the share of the total in percent.

    One row per type name meets the one row of the total.
    """
    per_type = disability.groupBy("disability_type").agg(F.sum("total_patients").alias("total_patients"))
    one = F.lit(1).alias("_one")
    total = per_type.agg(F.sum("total_patients").alias("_total")).select("_total", one)
    return (
        per_type.select("*", one)
        .join(total, "_one")
        .select("disability_type", "total_patients", pct("total_patients", "_total").alias("share"))
        .orderBy(F.col("total_patients").desc(), "disability_type")
    )


def q_top_specialties(professionals: DataFrame) -> DataFrame:
    return (
        professionals.groupBy(label("specialty", SPECIALTY_NOT_INFORMED).alias("specialty"))
        .agg(
            F.sum("total_appointments").alias("total_appointments"),
            mean_of("avg_feedback_rating").alias("avg_rating"),
        )
        .orderBy(F.col("total_appointments").desc_nulls_last(), "specialty")
        .limit(TOP)
    )


def q_appointments_per_month(professional_appointments: DataFrame) -> DataFrame:
    return (
        professional_appointments.groupBy(F.col("appointment_period").alias("month"))
        .agg(
            F.sum("total_appointments").alias("total_appointments"),
            mean_of("completion_rate").alias("avg_completion_rate"),
        )
        .orderBy("month")
    )


def charts(marts: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The five coded charts over published marts, by name."""
    return {
        "patients_month": q_patients_per_month(marts["patients"]),
        "patients_age": q_age_distribution(marts["patients"]),
        "disability": q_top_disabilities(marts["patient_disability"], marts["patients"]),
        "prof_spec": q_top_specialties(marts["professionals"]),
        "prof_series": q_appointments_per_month(marts["professional_appointments"]),
    }


# --- documented tiles: appointments ------------------------------------------


def q_completed_total(fact: DataFrame) -> DataFrame:
    return fact.agg(F.count_if(status_is(COMPLETED)).alias("completed_appointments"))


def q_cancellation_rate(fact: DataFrame) -> DataFrame:
    counts = fact.agg(F.count_if(status_is(CANCELLED)).alias("cancelled"), F.count(F.lit(1)).alias("total"))
    return counts.select("cancelled", "total", pct("cancelled", "total").alias("cancellation_rate"))


def q_mean_waiting(fact: DataFrame) -> DataFrame:
    """Mean waiting time in minutes; zero is left out, as in the mart."""
    waited = F.nullif(F.col("waiting_time"), F.lit(0).cast("bigint"))
    return fact.agg(exact_mean(F.sum(waited), F.count(waited)).alias("avg_waiting_minutes"))


def q_completed_vs_cancelled(fact: DataFrame) -> DataFrame:
    return (
        fact.groupBy(month_of_date_id("date_id").alias("month"))
        .agg(
            F.count_if(status_is(COMPLETED)).alias("completed_appointments"),
            F.count_if(status_is(CANCELLED)).alias("cancelled_appointments"),
        )
        .orderBy("month")
    )


def q_rating_by_state(fact: DataFrame, dim_professional: DataFrame, dim_report: DataFrame) -> DataFrame:
    """Mean rating per professional's state; ratings are summed per professional before the join."""
    with_professional = fact.filter(F.col("professional_id").isNotNull())
    rated = ratings_by(with_professional, dim_report, "professional_id")
    return (
        rated.join(dim_professional.select("professional_id", "state"), "professional_id")
        .groupBy("state")
        .agg(
            F.sum("rating_count").alias("ratings"),
            exact_mean(F.sum("rating_sum"), F.sum("rating_count")).alias("avg_rating"),
        )
        .orderBy(F.col("avg_rating").desc(), "state")
    )


def q_professional_ratings(professionals: DataFrame) -> DataFrame:
    return professionals.select("professional_sk", "total_appointments", "avg_feedback_rating")


def q_price_over_time(fact: DataFrame, dim_clinic: DataFrame) -> DataFrame:
    """Mean consult price of the clinics behind each month's appointments."""
    per_clinic = (
        fact.filter(F.col("clinic_id").isNotNull())
        .groupBy(month_of_date_id("date_id").alias("month"), "clinic_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    prices = dim_clinic.filter(F.col("consult_price").isNotNull()).select("clinic_id", "consult_price")
    return (
        per_clinic.join(prices, "clinic_id")
        .groupBy("month")
        .agg(
            exact_mean(
                F.sum((F.col("consult_price") * F.col("n")).cast("decimal(24,2)")), F.sum("n")
            ).alias("avg_consult_price")
        )
        .orderBy("month")
    )


def q_appointments_by_specialty(professional_appointments: DataFrame) -> DataFrame:
    return (
        professional_appointments.groupBy("specialty")
        .agg(F.sum("total_appointments").alias("total_appointments"))
        .orderBy(F.col("total_appointments").desc(), "specialty")
    )


# --- documented tiles: professionals ------------------------------------------


def rating_band(c: str) -> Column:
    """No rating, or the whole-number band a mean rating falls in (5 belongs to 4-5)."""
    low = F.least(F.floor(c), F.lit(4)).cast("string")
    high = F.least(F.floor(c) + 1, F.lit(5)).cast("string")
    return F.when(F.col(c) == 0, F.lit("none")).otherwise(F.concat(low, F.lit("-"), high))


def q_professional_cuts(professionals: DataFrame) -> DataFrame:
    """Professionals by specialty, state, activity and rating band: (cut, value, professionals).

    Grouping sets give the four cuts in one pass over the mart.
    """
    base = professionals.select(
        label("specialty", SPECIALTY_NOT_INFORMED).alias("specialty"),
        label("state").alias("state"),
        F.coalesce("active", F.lit(False)).cast("string").alias("active"),
        rating_band("avg_feedback_rating").alias("rating_band"),
    )
    cuts = ["specialty", "state", "active", "rating_band"]
    grouped = base.groupingSets([[F.col(c)] for c in cuts], *[F.col(c) for c in cuts]).agg(
        F.count(F.lit(1)).alias("professionals"),
        *[F.grouping(c).alias(f"_{c}") for c in cuts],
    )
    cut = F.coalesce(*[F.when(F.col(f"_{c}") == 0, F.lit(c)) for c in cuts])
    return grouped.select(cut.alias("cut"), F.coalesce(*cuts).alias("value"), "professionals")


# --- documented tiles: patients -----------------------------------------------


def q_age_share(patients: DataFrame) -> DataFrame:
    """Patients per age group with the share of all; one row per group, so the window is small."""
    groups = patients.groupBy("age_group").agg(F.sum("total_patients").alias("total_patients"))
    everyone = F.sum("total_patients").over(Window.partitionBy())
    return groups.select("age_group", "total_patients", pct(F.col("total_patients"), everyone).alias("share"))


def q_active_patients(patients: DataFrame) -> DataFrame:
    return patients.agg(F.sum("active_patients").alias("active_patients"))


def q_registrations(dim_patient: DataFrame) -> DataFrame:
    return (
        dim_patient.filter(F.col("created_at").isNotNull())
        .groupBy(calendar_month("created_at").alias("month"))
        .agg(F.count(F.lit(1)).alias("registrations"))
        .orderBy("month")
    )


def q_status_counts(fact: DataFrame) -> DataFrame:
    status = F.lower(F.coalesce("status", F.lit("")))
    return fact.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("appointments"))


def q_growth_series(patients: DataFrame) -> DataFrame:
    monthly = patients.groupBy(F.col("period_month").alias("month")).agg(
        F.sum("total_patients").alias("month_total")
    )
    return month_growth(monthly, "month", "month_total").orderBy("month")


# --- filters and time grain -----------------------------------------------------


def _filtered(df: DataFrame, **equal: str | None) -> DataFrame:
    for column, value in equal.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def _quarter(df: DataFrame, column: str, quarter: int | None) -> DataFrame:
    return df if quarter is None else df.filter(F.quarter(column) == quarter)


def q_appointments_filtered(
    professional_appointments: DataFrame,
    grain: str = "month",
    quarter: int | None = None,
    specialty: str | None = None,
) -> DataFrame:
    kept = _quarter(_filtered(professional_appointments, specialty=specialty), "appointment_period", quarter)
    cancelled = F.col("cancelled_appointments_online") + F.col("cancelled_appointments_presencial")
    return (
        kept.groupBy(F.trunc("appointment_period", grain).alias("period"))
        .agg(
            F.sum("total_appointments").alias("total_appointments"),
            F.sum("completed_appointments").alias("completed_appointments"),
            F.sum(cancelled).alias("cancelled_appointments"),
        )
        .orderBy("period")
    )


def q_patients_filtered(
    patients: DataFrame,
    grain: str = "month",
    quarter: int | None = None,
    gender_identity: str | None = None,
    sexual_orientation: str | None = None,
    ethnic_group: str | None = None,
) -> DataFrame:
    kept = _filtered(
        patients,
        gender_identity=gender_identity,
        sexual_orientation=sexual_orientation,
        ethnic_group=ethnic_group,
    )
    return (
        _quarter(kept, "period_month", quarter)
        .groupBy(F.trunc("period_month", grain).alias("period"))
        .agg(
            F.sum("total_patients").alias("total_patients"),
            F.sum("active_patients").alias("active_patients"),
        )
        .orderBy("period")
    )


# --- samples of the typed layer ---------------------------------------------------

# Table -> (shown columns, leading order column or None for the key alone); newest twenty rows.
# Sample columns of the dashboard's tables.
SAMPLES: dict[str, tuple[tuple[str, ...], str | None]] = {
    "privacydocument": (("id", "created_at", "updated_at", "profile_type"), None),
    "appointment": (("id", "appointment_date", "status", "professional_id", "user_id"), "appointment_date"),
    "cancellation": (("cancellation_id", "created_at", "reason", "appointment_id"), "created_at"),
    "profile": (
        (
            "profile_id",
            "created_at",
            "completed",
            "user_id",
            "ethnic_group",
            "gender_identity",
            "pronoun",
            "sexual_orientation",
        ),
        "updated_at",
    ),
    "profile_disability_types": (("id", "profile_id", "disabilitytype_id"), None),
    "report": (("report_id", "created_at", "eval", "appointment_id"), "created_at"),
    "user": (
        ("user_id", "email", "is_active", "is_staff", "is_superuser", "last_login", "privacy_document_id"),
        "updated_at",
    ),
    "clinic": (
        ("clinic_id", "name", "city", "state_id", "consult_price", "is_presential_clinic", "is_online_clinic"),
        "updated_at",
    ),
    "professional": (
        (
            "professional_id",
            "full_name",
            "profile_status",
            "active",
            "published",
            "profession_id",
            "state_id",
        ),
        "updated_at",
    ),
    "professional_disability_types": (("id", "professional_id", "disabilitytype_id"), None),
}


def q_sample(typed: DataFrame, table: str) -> DataFrame:
    columns, newest_by = SAMPLES[table]
    order = [F.col(columns[0]).desc()]
    if newest_by:
        order.insert(0, F.col(newest_by).desc_nulls_last())
    return typed.orderBy(*order).limit(SAMPLE_ROWS).select(*columns)
