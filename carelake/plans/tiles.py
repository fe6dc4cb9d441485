"""Dashboard tiles with a time grain and filters.

Appointment tiles are sums over one additive cube: a row per month and combination of the professional's attributes, as
many as there are such combinations, however many appointments.  Patient tiles sum up the patients mart, which is such
a cube already.  A tile's rows are the periods (``grain``: month, quarter or year) of what the filters leave.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelake.functions import exact_mean, growth, label, month_of_date_id, pct
from carelake.functions.measures import SPECIALTY_NOT_INFORMED
from carelake.operators.marts import CANCELLED, COMPLETED, status_is
from carelake.plans.dashboard import rating_band

GRAINS = ("month", "quarter", "year")
#: Attributes a cube can be filtered by, besides time.
ATTRIBUTES = ("specialty", "state", "gender_identity", "sexual_orientation", "ethnic_group")


@dataclass(frozen=True)
class Filters:
    """What the dashboard's filter bars hold; None leaves all.  ``quarter`` is that of any year."""

    grain: str = "month"
    quarter: int | None = None
    specialty: str | None = None
    state: str | None = None
    gender_identity: str | None = None
    sexual_orientation: str | None = None
    ethnic_group: str | None = None

    def __post_init__(self) -> None:
        if self.grain not in GRAINS:
            raise ValueError(f"unknown grain: {self.grain!r}")

    def apply(self, df: DataFrame, month: str | None = "month") -> DataFrame:
        """Rows of ``df`` that pass, with their ``period`` when there is a month; a filter it has no column for is refused."""
        for name in ATTRIBUTES:
            if (value := getattr(self, name)) is not None:
                if name not in df.columns:
                    raise ValueError(f"this tile has no {name}")
                df = df.filter(F.col(name) == value)
        if month is None:
            return df
        if self.quarter is not None:
            df = df.filter(F.quarter(month) == self.quarter)
        return df.withColumn("period", F.trunc(month, self.grain))


def appointment_cube(
    fact: DataFrame, dim_professional: DataFrame, dim_report: DataFrame, dim_clinic: DataFrame
) -> DataFrame:
    """Additive measures per month and professional attributes.

    Facts are summed per professional, clinic and report before anything is joined; appointments without a known
    professional count under the labels for what is not informed.
    """
    waited = F.nullif(F.col("waiting_time"), F.lit(0).cast("bigint"))
    summed = fact.groupBy(month_of_date_id("date_id").alias("month"), "professional_id", "clinic_id", "report_id").agg(
        F.count(F.lit(1)).alias("appointments"),
        F.count_if(status_is(COMPLETED)).alias("completed"),
        F.count_if(status_is(CANCELLED)).alias("cancelled"),
        F.sum(waited).alias("waited_sum"),
        F.count(waited).alias("waited_count"),
    )
    rated = dim_report.filter(F.col("evaluation").isNotNull()).select("report_id", "evaluation")
    priced = dim_clinic.filter(F.col("consult_price").isNotNull()).select("clinic_id", "consult_price")
    attributes = dim_professional.select("professional_id", *ATTRIBUTES)
    joined = (
        summed.join(rated, "report_id", "left").join(priced, "clinic_id", "left").join(attributes, "professional_id", "left")
    )
    n = F.col("appointments")
    named = [label(c, SPECIALTY_NOT_INFORMED if c == "specialty" else "N/I").alias(c) for c in ATTRIBUTES]
    return joined.groupBy("month", *named).agg(
        *[F.sum(c).alias(c) for c in ("appointments", "completed", "cancelled", "waited_sum", "waited_count")],
        F.sum(F.col("evaluation") * n).alias("rating_sum"),
        F.sum(F.when(F.col("evaluation").isNotNull(), n)).alias("rating_count"),
        F.sum((F.col("consult_price") * n).cast("decimal(24,2)")).alias("price_sum"),
        F.sum(F.when(F.col("consult_price").isNotNull(), n)).alias("price_count"),
    )


def _summed(df: DataFrame, by: Sequence[str], *sums: str) -> DataFrame:
    return df.groupBy("period", *by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])


def tile_completed(cube: DataFrame, filters: Filters) -> DataFrame:
    return _summed(filters.apply(cube), [], "completed")


def tile_cancellation_rate(cube: DataFrame, filters: Filters) -> DataFrame:
    found = _summed(filters.apply(cube), [], "cancelled", "appointments")
    return found.withColumn("cancellation_rate", pct("cancelled", "appointments"))


def tile_waiting(cube: DataFrame, filters: Filters) -> DataFrame:
    found = _summed(filters.apply(cube), [], "waited_sum", "waited_count")
    return found.select("period", exact_mean("waited_sum", "waited_count").alias("avg_waiting_minutes"))


def tile_completed_vs_cancelled(cube: DataFrame, filters: Filters) -> DataFrame:
    return _summed(filters.apply(cube), [], "completed", "cancelled")


def tile_status(cube: DataFrame, filters: Filters) -> DataFrame:
    found = _summed(filters.apply(cube), [], "appointments", "completed", "cancelled")
    other = F.col("appointments") - F.col("completed") - F.col("cancelled")
    return found.select("period", "completed", "cancelled", other.alias("other"))


def tile_rating_by_state(cube: DataFrame, filters: Filters) -> DataFrame:
    found = _summed(filters.apply(cube), ["state"], "rating_sum", "rating_count").filter("rating_count > 0")
    return found.select(
        "period", "state", F.col("rating_count").alias("ratings"), exact_mean("rating_sum", "rating_count").alias("avg_rating")
    )


def tile_price(cube: DataFrame, filters: Filters) -> DataFrame:
    found = _summed(filters.apply(cube), [], "price_sum", "price_count").filter("price_count > 0")
    return found.select("period", exact_mean("price_sum", "price_count").alias("avg_consult_price"))


def tile_by_specialty(cube: DataFrame, filters: Filters) -> DataFrame:
    return _summed(filters.apply(cube), ["specialty"], "appointments")


def tile_professionals(professionals: DataFrame, filters: Filters) -> DataFrame:
    """Professionals of the filters' attributes by rating band, with what they have completed; marts of professionals have no time."""
    named = professionals.withColumns({c: label(c, SPECIALTY_NOT_INFORMED if c == "specialty" else "N/I") for c in ATTRIBUTES})
    kept = filters.apply(named, None)
    return kept.groupBy(rating_band("avg_feedback_rating").alias("rating_band")).agg(
        F.count(F.lit(1)).alias("professionals"), F.sum("total_appointments").alias("total_appointments")
    )


def tile_age_share(patients: DataFrame, filters: Filters) -> DataFrame:
    """Patients registered in a period by age group, with the share of the period's; one row per period and group."""
    found = _summed(filters.apply(patients, "period_month"), ["age_group"], "total_patients")
    everyone = F.sum("total_patients").over(Window.partitionBy("period"))
    return found.withColumn("share", pct(F.col("total_patients"), everyone))


def tile_patients(patients: DataFrame, filters: Filters) -> DataFrame:
    """Registrations and active patients per period, with the growth against the period before that is present."""
    found = _summed(filters.apply(patients, "period_month"), [], "total_patients", "active_patients")
    before: Column = F.lag("total_patients").over(Window.orderBy("period"))  # one row per period
    return found.withColumn("growth_rate", growth("total_patients", before))
