"""Star-schema dimensions from typed tables.

Lookups are plain left joins on unique keys: Catalyst broadcasts a side when its size is
known to be small and AQE does so when it turns out small, so nothing here is broadcast
by decree.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.functions import date_id, hashed_name, patient_key, surrogate
from carelake.operators.dedup import latest_per_key, newest_touched
from carelake.operators.joins import link
from carelake.operators.upsert import insert_new
from carelake.schemas import MODEL_SCHEMAS

# Attribute -> (lookup table, key column, name column).
ATTRIBUTES = {
    "ethnic_group": ("ethnicgroup", "ethnic_group", "name"),
    "gender_identity": ("genderidentity", "gender_identity", "name"),
    "pronoun": ("pronoun", "pronoun", "pronoun"),
    "sexual_orientation": ("sexualorientation", "sexual_orientation", "name"),
}
PROFESSIONAL_ATTRIBUTES = {
    **ATTRIBUTES,
    "profile_type": ("privacydocument", "privacy_document_id", "profile_type"),
}

# Fixed value: the privacy-document profile type that marks a patient.
PATIENT_PROFILE = "Paciente"


def _as_text(c: str) -> Column:
    return F.col(c).cast("string")


def _lookup(df: DataFrame, lookup: DataFrame, key: str, name: str, out: str) -> DataFrame:
    """Replace the numeric ``key`` by the lookup's ``name``, or by its own digits when unnamed."""
    side = lookup.select(F.col("id").alias("_id"), F.col(name).alias("_name"))
    joined = df.join(side, df[key] == side["_id"], "left")
    kept = [c for c in df.columns if c not in (key, out)]
    return joined.select(*kept, F.coalesce(F.col("_name"), _as_text(key)).alias(out))


def _named_attributes(
    df: DataFrame,
    attributes: Mapping[str, tuple[str, str, str]],
    lookups: Mapping[str, DataFrame],
    wanted: Collection[str],
) -> DataFrame:
    for out, (table, key, name) in attributes.items():
        if out in wanted:
            df = _lookup(df, lookups[table], key, name, out)
    return df


def _columns(table: str) -> list[str]:
    """Column names of a model table."""
    return T.StructType.fromDDL(MODEL_SCHEMAS[table]).fieldNames()


def dim_date(appointments: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Every day from the first to the last appointment or creation date.

    Days already in ``existing`` stay; missing ones are added on both ends.
    """
    bounds = appointments.agg(
        F.min("appointment_date").alias("a0"),
        F.max("appointment_date").alias("a1"),
        F.min("created_at").alias("c0"),
        F.max("created_at").alias("c1"),
    )
    # Years first, then the days of each year: a far-off date makes many tasks, not one long one.
    ends = bounds.select(F.least("a0", "c0").cast("date").alias("first"), F.greatest("a1", "c1").cast("date").alias("last"))
    years = ends.filter(F.col("first").isNotNull()).select(
        "first", "last", F.explode(F.sequence(F.year("first"), F.year("last"))).alias("y")
    )
    new_year, old_year = (F.make_date("y", F.lit(m), F.lit(d)) for m, d in ((1, 1), (12, 31)))
    span = F.sequence(F.greatest("first", new_year), F.least("last", old_year), F.expr("interval 1 day"))
    days = years.repartition("y").select(F.explode(span).alias("d")).filter(date_id("d").isNotNull())
    dates = days.select(
        date_id("d").alias("date_id"),
        F.col("d").alias("calendar_date"),
        F.dayofmonth("d").alias("day"),
        F.month("d").alias("month"),
        F.year("d").alias("year"),
        F.weekofyear("d").alias("week"),
        F.quarter("d").alias("quarter"),
    )
    return dates if existing is None else insert_new(existing, dates, ["date_id"])


def report_key() -> Column:
    return surrogate("created_at", "feedback", "eval")


def reports_with_content(reports: DataFrame) -> DataFrame:
    return reports.filter(
        F.col("created_at").isNotNull() | F.col("feedback").isNotNull() | F.col("eval").isNotNull()
    )


def dim_report(reports: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Distinct (created_at, feedback, evaluation), NULLs comparing equal."""
    distinct = reports_with_content(reports).select("created_at", "feedback", "eval").distinct()
    out = distinct.select(
        report_key().alias("report_id"), "created_at", "feedback", F.col("eval").alias("evaluation")
    )
    return out if existing is None else insert_new(existing, out, ["report_id"])


def clinics_with_state(clinics: DataFrame, states: DataFrame) -> DataFrame:
    """Named clinics with ``state`` and the surrogate ``clinic_sk``."""
    named = clinics.filter(F.col("name").isNotNull())
    resolved = _lookup(named, states, "state_id", "name", "state")
    return resolved.withColumn("clinic_sk", surrogate("name", "city", "state"))


def dim_clinic(clinics: DataFrame, states: DataFrame) -> DataFrame:
    """One row per (name, city, state): the latest created, then the smallest source id."""
    latest = latest_per_key(
        clinics_with_state(clinics, states),
        ["name", "city", "state"],
        [F.col("created_at").desc_nulls_last()],
        [F.col("clinic_id").asc()],
    )
    return latest.select(
        F.col("clinic_sk").alias("clinic_id"),
        "created_at",
        "is_presential_clinic",
        "is_online_clinic",
        "name",
        "zip_code",
        "city",
        "consult_price",
        "duration_minutes",
        "accepts_insurance_providers",
        "provides_accessibility_standards",
        "online_clinic_consult_price",
        "online_clinic_duration_minutes",
        "online_clinic_accepts_insurance_providers",
        "state",
    )


def disability_arrays(bridge: DataFrame, owner: str, types: DataFrame) -> DataFrame:
    """Sorted type names per owner, unnamed types left out: (owner, disability_type).

    Rows are counted per owner and name first, so what is collected per owner is bounded
    by the number of type names, however many bridge rows one owner has.
    """
    named = (
        bridge.select(owner, "disabilitytype_id")
        .filter(F.col(owner).isNotNull())
        .join(types.select(F.col("id").alias("disabilitytype_id"), "name"), "disabilitytype_id")
        .filter(F.col("name").isNotNull())
    )
    counted = named.groupBy(owner, "name").agg(F.count(F.lit(1)).cast("int").alias("n"))
    pairs = counted.groupBy(owner).agg(F.sort_array(F.collect_list(F.struct("name", "n"))).alias("pairs"))
    repeated = F.flatten(F.transform("pairs", lambda p: F.array_repeat(p["name"], p["n"])))
    return pairs.select(owner, repeated.alias("disability_type"))


def _or_empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def professionals_with_state(professionals: DataFrame, states: DataFrame) -> DataFrame:
    """Named professionals with ``state`` and the surrogate ``professional_sk``."""
    named = professionals.filter(F.col("full_name").isNotNull())
    resolved = _lookup(named, states, "state_id", "name", "state")
    return resolved.withColumn("professional_sk", surrogate("full_name", "state"))


def dim_professional(
    professionals: DataFrame,
    lookups: Mapping[str, DataFrame],
    salt: str = "",
    columns: Collection[str] | None = None,
) -> DataFrame:
    """One row per (full_name, state): the latest created, then the smallest source id.

    The name itself is not stored, only its hash.  Only lookups that ``columns`` (all when
    not given) asks for are joined.
    """
    wanted = _columns("dim_professional") if columns is None else columns
    df = latest_per_key(
        professionals_with_state(professionals, lookups["address_state"]),
        ["full_name", "state"],
        [F.col("created_at").desc_nulls_last()],
        [F.col("professional_id").asc()],
    )
    if "disability_type" in wanted:
        arrays = disability_arrays(
            lookups["professional_disability_types"], "professional_id", lookups["disabilitytype"]
        )
        df = df.join(arrays, "professional_id", "left")
    df = _named_attributes(df, PROFESSIONAL_ATTRIBUTES, lookups, wanted)
    made = {
        "professional_id": F.col("professional_sk"),
        "full_name": hashed_name("full_name", salt),
        "disability_type": _or_empty("disability_type"),
    }
    return df.select([made.get(c, F.col(c)).alias(c) for c in wanted])


def users_with_key(users: DataFrame, salt: str = "") -> DataFrame:
    """Users that have at least one natural field, with ``patient_key``."""
    some = users.filter(
        F.col("first_name").isNotNull() | F.col("last_name").isNotNull() | F.col("birth_date").isNotNull()
    )
    return some.withColumn("patient_key", patient_key("first_name", "last_name", "birth_date", salt))


def patient_profiles(profiles: DataFrame) -> DataFrame:
    """One profile per user: the latest, then the smallest id."""
    return latest_per_key(
        profiles.filter(F.col("user_id").isNotNull()).select(
            "user_id", "profile_id", "created_at", "updated_at", *ATTRIBUTES
        ),
        ["user_id"],
        [newest_touched()],
        [F.col("profile_id").asc()],
    ).drop("created_at", "updated_at")


def dim_patient(
    users: DataFrame,
    profiles: DataFrame,
    lookups: Mapping[str, DataFrame],
    salt: str = "",
    columns: Collection[str] | None = None,
) -> DataFrame:
    """One row per patient key: the latest created user, then the smallest user id.

    Only users whose privacy document marks a patient.  A user with several profiles
    counts with the latest.  Names are never stored.  Only lookups that ``columns`` (all
    when not given) asks for are joined.
    """
    wanted = _columns("dim_patient") if columns is None else columns
    documents = (
        lookups["privacydocument"]
        .select(F.col("id").alias("privacy_document_id"), "profile_type")
        .filter(F.col("profile_type") == PATIENT_PROFILE)
    )
    patients = users_with_key(users, salt).select(
        "user_id", "created_at", "birth_date", "is_active", "patient_key", "privacy_document_id"
    )
    df = latest_per_key(
        patients.join(documents, "privacy_document_id"),
        ["patient_key"],
        [F.col("created_at").desc_nulls_last()],
        [F.col("user_id").asc()],
    )
    if "disability_type" in wanted or set(ATTRIBUTES) & set(wanted):
        df = df.join(patient_profiles(profiles), "user_id", "left")
    if "disability_type" in wanted:
        arrays = disability_arrays(
            lookups["profile_disability_types"], "profile_id", lookups["disabilitytype"]
        )
        # Users without a profile have no profile id: many NULL keys.
        df = link(df, arrays, "profile_id", "profile_id", spread_by="patient_key")
    df = _named_attributes(df, ATTRIBUTES, lookups, wanted)
    nothing = F.lit(None).cast("string")
    made = {
        "patient_id": surrogate("patient_key"),
        "first_name": nothing,
        "last_name": nothing,
        "disability_type": _or_empty("disability_type"),
    }
    return df.select([made.get(c, F.col(c)).alias(c) for c in wanted])


def null_after_use(df: DataFrame, *columns: str) -> DataFrame:
    """Personal columns to NULL once joins no longer need them."""
    types = dict(df.dtypes)
    return df.withColumns({c: F.lit(None).cast(types[c]) for c in columns})


def conform(df: DataFrame, table: str, schemas: Mapping[str, str] = MODEL_SCHEMAS) -> DataFrame:
    """Column order and types of a model table or, by its ``schemas``, of a mart."""
    fields = T.StructType.fromDDL(schemas[table]).fields
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
