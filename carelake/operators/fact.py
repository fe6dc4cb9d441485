"""The appointment fact.

Surrogate keys are hashes of natural keys, so the fact needs no join to a dimension to
learn a key, only the source-side lookups.  Reports, cancellations and patients come to where the appointments lie by id, the
patients by way of narrow pairs of ids; whole facts are moved once more at most, for professional and clinic, put together first.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.functions import clean_id, date_id, fingerprint, surrogate, waiting_minutes
from carelake.operators.dedup import latest_cancellation, latest_per_key, newest_touched
from carelake.operators.dimensions import (
    clinics_with_state,
    conform,
    professionals_with_state,
    report_key,
    reports_with_content,
    users_with_key,
)
from carelake.operators.joins import link

FACT_COLUMNS = (
    "id_fact_appointment",
    "appointment_fingerprint",
    "created_date_id",
    "status",
    "type",
    "date_id",
    "waiting_time",
    "professional_id",
    "patient_id",
    "clinic_id",
    "report_id",
    "cancellation_created_at",
    "cancellation_reason",
)
_KEYS = ("id_fact_appointment", "appointment_fingerprint")
_CANCELLATION = ("cancellation_created_at", "cancellation_reason")
# What a fact's columns are read from, besides the id and the date; the key and the fingerprint need no more.
_READ = {
    "created_date_id": ["created_at"],
    "waiting_time": ["created_at"],
    "status": ["status"],
    "type": ["type"],
    "professional_id": ["professional_id"],
    "clinic_id": ["professional_id"],
    "patient_id": ["user_id"],
}


def fact_reads(columns: Collection[str] = FACT_COLUMNS) -> dict[str, list[str]]:
    """Columns of the typed appointments, reports and cancellations that facts with these ``columns`` are made from."""
    wanted = set(columns)
    out = {"appointment": ["id", "appointment_date", *dict.fromkeys(c for f in FACT_COLUMNS if f in wanted for c in _READ.get(f, []))]}
    if "report_id" in wanted:
        out["report"] = ["report_id", "created_at", "feedback", "eval", "appointment_id"]
    if wanted & set(_CANCELLATION):
        out["cancellation"] = ["cancellation_id", "created_at", "reason", "appointment_id"]
    return out


def professional_links(professionals: DataFrame, states: DataFrame) -> DataFrame:
    """Source professional id -> surrogate; professionals without a state have none."""
    known = professionals_with_state(professionals, states).filter(F.col("state").isNotNull())
    return known.select("professional_id", "professional_sk")


def clinic_links(clinics: DataFrame, states: DataFrame) -> DataFrame:
    """Source professional id -> surrogate of one clinic: the latest, then the smallest id."""
    resolved = clinics_with_state(clinics, states).filter(
        F.col("professional_id").isNotNull() & F.col("city").isNotNull() & F.col("state").isNotNull()
    )
    latest = latest_per_key(
        resolved.select("professional_id", "clinic_sk", "clinic_id", "created_at", "updated_at"),
        ["professional_id"],
        [newest_touched()],
        [F.col("clinic_id").asc()],
    )
    return latest.select("professional_id", "clinic_sk")


def patient_links(users: DataFrame, dim_patient: DataFrame, salt: str = "") -> DataFrame:
    """Source user id -> patient surrogate, by patient key."""
    keyed = users_with_key(users, salt).select("user_id", "patient_key")
    return keyed.join(dim_patient.select("patient_key", "patient_id"), "patient_key").select(
        "user_id", "patient_id"
    )


def report_links(reports: DataFrame) -> DataFrame:
    """Appointment id -> surrogate of one report: the latest created, then the smallest id."""
    keyed = reports_with_content(reports).select(
        clean_id("appointment_id").alias("appointment_id"),
        report_key().alias("report_sk"),
        "created_at",
        "report_id",
    )
    latest = latest_per_key(
        keyed.filter(F.col("appointment_id").isNotNull()),
        ["appointment_id"],
        [F.col("created_at").desc_nulls_last()],
        [F.col("report_id").asc()],
    )
    return latest.select("appointment_id", F.col("report_sk").alias("report_id"))


def cancellation_links(cancellations: DataFrame) -> DataFrame:
    return latest_cancellation(cancellations).select(
        "appointment_id",
        F.col("created_at").alias("cancellation_created_at"),
        F.col("reason").alias("cancellation_reason"),
    )


def _combined(parts: list[DataFrame], key: str) -> DataFrame:
    """Tables with one row per key as one: rows with equal keys become one row.  An aggregate needs no full join's sorts."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out if len(parts) == 1 else out.groupBy(key).agg(*[F.max(c).alias(c) for c in out.columns if c != key])


def _patients_of(appointments: DataFrame, patients: DataFrame) -> DataFrame:
    """(appointment_id, patient_id) of the appointments that have one.

    What moves to the users and back are ids alone, and back only those of patients: less than half of what whole facts are.
    """
    pairs = appointments.select("appointment_id", F.col("src_user_id").alias("user_id")).filter(F.col("user_id").isNotNull())
    return pairs.join(patients, "user_id").select("appointment_id", "patient_id")


def fact_rejects(appointments: DataFrame) -> DataFrame:
    """Appointments without a date cannot be facts; they are kept aside and counted."""
    return appointments.filter(F.col("appointment_date").isNull())


def fact_keys(facts: DataFrame) -> DataFrame:
    """``facts`` with the columns ``appointment_id`` and ``date_id``, plus fingerprint and key."""
    df = facts.withColumn("appointment_fingerprint", fingerprint("appointment_id", F.col("date_id")))
    return df.withColumn("id_fact_appointment", surrogate("appointment_fingerprint"))


def fact_appointments(
    typed: Mapping[str, DataFrame],
    dims: Mapping[str, DataFrame] | None = None,
    columns: Collection[str] = FACT_COLUMNS,
    salt: str = "",
    keyed: bool = True,
) -> DataFrame:
    """One row per dated appointment.

    Only the lookups that ``columns`` asks for are joined (Catalyst cannot drop an outer
    join it does not know to be unique).  ``dims`` needs ``dim_patient`` for ``patient_id``.
    Appointment ids are unique in the typed layer and every lookup has one row per key, so
    fingerprints are unique without a distinct.  Facts that go on to joins can be had without their key and fingerprint
    (``keyed`` false), but with ``appointment_id``, from which :func:`fact_keys` makes both.
    """
    wanted = set(columns)
    unknown = wanted - set(FACT_COLUMNS)
    if unknown:
        raise ValueError(f"not fact columns: {sorted(unknown)}")

    day = date_id("appointment_date")
    read = set(fact_reads(wanted)["appointment"])
    made = {
        "created_date_id": lambda: date_id("created_at"),
        "status": lambda: F.col("status"),
        "type": lambda: F.col("type"),
        "waiting_time": lambda: waiting_minutes("created_at", "appointment_date"),
    }
    df = typed["appointment"].filter(F.col("appointment_date").isNotNull()).select(
        F.col("id").alias("appointment_id"),
        day.alias("date_id"),
        *[make().alias(c) for c, make in made.items() if c in wanted],
        *[F.col(c).alias(f"src_{c}") for c in ("professional_id", "user_id") if c in read],
    )

    # One after the other: all sides lie by appointment already, a full join of the lookups would not and be shuffled.
    lookups = []
    if "report_id" in wanted:
        lookups.append(report_links(typed["report"]))
    if wanted & set(_CANCELLATION):
        lookups.append(cancellation_links(typed["cancellation"]))
    if "patient_id" in wanted:
        lookups.append(_patients_of(df, patient_links(typed["user"], dims["dim_patient"], salt)))
        df = df.drop("src_user_id")
    for lookup in lookups:
        df = df.join(lookup, "appointment_id", "left")

    by_professional = []
    if "professional_id" in wanted:
        by_professional.append(professional_links(typed["professional"], typed["address_state"]))
    if "clinic_id" in wanted:
        by_professional.append(clinic_links(typed["clinic"], typed["address_state"]))
    if by_professional:
        df = link(
            df,
            _combined(by_professional, "professional_id"),
            "src_professional_id",
            "professional_id",
            # Not measured first: that would be a run over all clinics and professionals before the query's own. AQE
            # broadcasts them if they turn out small in time, up to the session's threshold.
            spread_by="appointment_id",
        )
        df = df.withColumnsRenamed({"professional_sk": "professional_id", "clinic_sk": "clinic_id"})

    if not keyed:
        return df.select("appointment_id", *[c for c in FACT_COLUMNS if c in wanted and c not in _KEYS])
    # Made last: joins would carry it, and no shuffle can compress it.
    df = fact_keys(df)
    out = df.select(*[c for c in FACT_COLUMNS if c in wanted])
    return conform(out, "fact_appointments") if wanted == set(FACT_COLUMNS) else out
