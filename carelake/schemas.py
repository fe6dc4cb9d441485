"""Raw and typed table layouts.

One :class:`TableSpec` per entity says which raw column feeds which typed column under
which cleaning rule, what makes a row eligible and how duplicates are resolved.  The raw
layout (all text) follows from it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Cleaning rule -> typed column type.
RULE_TYPES: dict[str, T.DataType] = {
    "id": T.StringType(),  # trimmed, empty -> NULL
    "trim": T.StringType(),  # trimmed, empty kept
    "text": T.StringType(),  # empty -> NULL
    "asis": T.StringType(),
    "int": T.IntegerType(),
    "bool": T.BooleanType(),
    "time": T.TimestampNTZType(),
    "price": T.DecimalType(10, 2),
}
# Rules that can turn a filled raw value into NULL; the run summary counts those.
LOSSY_RULES = ("int", "bool", "time", "price")


@dataclass(frozen=True)
class Column:
    target: str
    rule: str
    source: str

    @property
    def lossy(self) -> bool:
        return self.rule in LOSSY_RULES


@dataclass(frozen=True)
class TableSpec:
    """``key_rule``: numeric | nonblank | nonnull.  ``dedup``: updated | updated_or_created | any."""

    name: str
    key_rule: str
    dedup: str
    columns: tuple[Column, ...]

    @property
    def key(self) -> str:
        return self.columns[0].target

    @property
    def raw_key(self) -> str:
        return self.columns[0].source

    @property
    def raw_columns(self) -> list[str]:
        return [c.source for c in self.columns]

    @property
    def raw_schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.source, T.StringType()) for c in self.columns])

    @property
    def typed_schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.target, RULE_TYPES[c.rule]) for c in self.columns])


def _columns(text: str) -> tuple[Column, ...]:
    """``rule: a b c=raw_name`` lines; ``a`` alone keeps its raw name."""
    out = []
    for line in text.strip().splitlines():
        rule, names = line.strip().split(":")
        for name in names.split():
            target, _, source = name.partition("=")
            out.append(Column(target, rule.strip(), source or target))
    return tuple(out)


def _spec(name: str, key_rule: str, dedup: str, text: str) -> TableSpec:
    return TableSpec(name, key_rule, dedup, _columns(text))


_LOOKUP = """
    int: id
    time: created_at updated_at
    text: bagde
    int: position_order
    text: name
"""

# Column names of the sixteen source tables and their typed names.
_SPECS = (
    _spec("privacydocument", "numeric", "updated", """
        int: id
        time: created_at updated_at
        text: privacy_policy terms_of_use profile_type
    """),
    _spec("appointment", "nonnull", "updated", """
        trim: id
        time: created_at updated_at appointment_date=date
        asis: status type professional_id user_id agreement_id
    """),
    _spec("cancellation", "nonblank", "updated", """
        id: cancellation_id=id
        time: created_at updated_at
        text: reason
        id: appointment_id
        int: created_by_content_type_id
        id: created_by_object_id=created_by_object_d
    """),
    _spec("profile", "nonblank", "updated", """
        id: profile_id=id
        time: created_at updated_at
        text: other_ethnic_group other_gender_identity other_sexual_orientation
        text: other_pronoun other_disability_types other_article
        bool: completed
        text: photo photo_description
        int: ethnic_group=ethnic_group_id gender_identity=gender_identity_id
        int: pronoun=pronoun_id sexual_orientation=sexual_orientation_id
        id: user_id
    """),
    _spec("profile_disability_types", "numeric", "any", """
        int: id
        id: profile_id
        int: disabilitytype_id
    """),
    _spec("report", "nonblank", "updated", """
        id: report_id=id
        time: created_at updated_at
        text: feedback
        int: eval
        asis: appointment_id
        int: created_by_content_type_id
        id: created_by_object_id
    """),
    _spec("user", "nonblank", "updated_or_created", """
        id: user_id=id
        text: password
        bool: is_superuser is_staff is_active
        time: created_at updated_at
        text: email first_name last_name
        time: birth_date
        bool: is_18_years_old_or_more
        time: last_login
        bool: email_verified accepted_privacy_document newsletter_subscribed
        text: phone
        bool: phone_verified
        text: phone_verification_token
        time: phone_verification_token_expires_at
        int: privacy_document_id
        text: logged_as
    """),
    _spec("address_state", "numeric", "updated", """
        int: id
        time: created_at updated_at
        text: name code ibge_code
        bool: active
        int: country_id
    """),
    _spec("disabilitytype", "numeric", "updated", """
        int: id
        time: created_at updated_at
        text: badge
        int: position_order
        text: name
    """),
    _spec("sexualorientation", "numeric", "updated", _LOOKUP),
    _spec("pronoun", "numeric", "updated", """
        int: id
        time: created_at updated_at
        text: bagde
        int: position_order
        text: article pronoun
    """),
    _spec("ethnicgroup", "numeric", "updated", _LOOKUP),
    _spec("genderidentity", "numeric", "updated", _LOOKUP),
    _spec("clinic", "nonblank", "updated_or_created", """
        id: clinic_id=id
        time: created_at updated_at
        bool: is_presential_clinic is_online_clinic
        text: name zip_code neighborhood city address address_line2=addresss_line2
        text: phone phone_whatsapp
        price: consult_price
        int: duration_minutes
        bool: accepts_insurance_providers provides_accessibility_standards
        text: online_clinic_phone online_clinic_phone_whatsapp
        price: online_clinic_consult_price
        int: online_clinic_duration_minutes
        bool: online_clinic_accepts_insurance_providers
        id: professional_id
        int: registered_neighborhood_id state_id
    """),
    _spec("professional", "nonblank", "updated_or_created", """
        id: professional_id=id
        time: created_at updated_at
        text: other_ethnic_group other_gender_identity other_sexual_orientation
        text: other_pronoun other_disability_types other_article
        text: full_name about_me profile_status
        bool: active published
        text: document_number board_registration_number
        bool: accepted_privacy_document
        text: safety_measures specialty specialty_number_rqe
        text: board_certification_selfie photo photo_description
        int: ethnic_group=ethnic_group_id gender_identity=gender_identity_id
        int: privacy_document_id profession_id pronoun=pronoun_id
        int: sexual_orientation=sexual_orientation_id state_id
        id: user_id
        text: search_synonym
    """),
    _spec("professional_disability_types", "numeric", "any", """
        int: id
        id: professional_id
        int: disabilitytype_id
    """),
)

SPECS: dict[str, TableSpec] = {s.name: s for s in _SPECS}

# Personal columns that are always NULL from the raw layer on.
PII_COLUMNS = (
    "password",
    "phone_verification_token",
    "phone_verification_token_expires_at",
    "email",
    "phone",
    "phone_whatsapp",
    "online_clinic_phone",
    "online_clinic_phone_whatsapp",
)

# Sample rows for empty raw tables; other tables get one all-NULL row.
SEED_ROWS: dict[str, dict[str, str]] = {
    "privacydocument": {
        "id": "1",
        "created_at": "2020-01-01T00:00:00Z",
        "updated_at": "2020-01-01T00:00:00Z",
        "privacy_policy": "policy",
        "terms_of_use": "terms",
        "profile_type": "patient",
    },
    "appointment": {
        "id": "1",
        "date": "2020-01-01T09:00:00Z",
        "status": "scheduled",
        "professional_id": "10",
        "user_id": "100",
    },
    "user": {"id": "u1", "email": "user@example.com", "is_active": "true"},
}


# Model and mart layouts, as DDL.
# Column names of the star schema.
MODEL_SCHEMAS: dict[str, str] = {
    "dim_date": (
        "date_id int, calendar_date date, day int, month int, year int, week int, quarter int"
    ),
    "dim_report": ("report_id bigint, created_at timestamp_ntz, feedback string, evaluation int"),
    "dim_clinic": (
        "clinic_id bigint, created_at timestamp_ntz, is_presential_clinic boolean,"
        " is_online_clinic boolean, name string, zip_code string, city string,"
        " consult_price decimal(10,2), duration_minutes int, accepts_insurance_providers boolean,"
        " provides_accessibility_standards boolean, online_clinic_consult_price decimal(10,2),"
        " online_clinic_duration_minutes int, online_clinic_accepts_insurance_providers boolean,"
        " state string"
    ),
    "dim_professional": (
        "professional_id bigint, created_at timestamp_ntz, full_name string, profile_status string,"
        " active boolean, published boolean, specialty string, ethnic_group string,"
        " gender_identity string, pronoun string, sexual_orientation string, profile_type string,"
        " disability_type array<string>, state string"
    ),
    "dim_patient": (
        "patient_id bigint, patient_key string, created_at timestamp_ntz, first_name string,"
        " last_name string, birth_date timestamp_ntz, is_active boolean, profile_type string,"
        " ethnic_group string, gender_identity string, pronoun string, sexual_orientation string,"
        " disability_type array<string>"
    ),
    "fact_appointments": (
        "id_fact_appointment bigint, appointment_fingerprint string, created_date_id int,"
        " status string, type string, date_id int, waiting_time bigint, professional_id bigint,"
        " patient_id bigint, clinic_id bigint, report_id bigint,"
        " cancellation_created_at timestamp_ntz, cancellation_reason string"
    ),
}

MODEL_KEYS = {
    "dim_date": "date_id",
    "dim_report": "report_id",
    "dim_clinic": "clinic_id",
    "dim_professional": "professional_id",
    "dim_patient": "patient_id",
    "fact_appointments": "appointment_fingerprint",
}

# Tables in parts, and the column whose month (or range of ids) is the part; raw tables are parted as their typed ones.
PARTED_BY: dict[tuple[str, str], str] = {
    ("typed", "appointment"): "appointment_date",
    ("typed", "cancellation"): "created_at",
    ("typed", "report"): "created_at",
    ("typed", "user"): "created_at",
    ("typed", "profile"): "created_at",
    ("typed", "profile_disability_types"): "id",
    ("typed", "professional_disability_types"): "id",
    ("model", "dim_report"): "created_at",
    ("model", "dim_patient"): "created_at",
    ("model", "fact_appointments"): "date_id",
}

# What makes a row of a dimension itself; the key above is a hash of it.
NATURAL_KEYS = {
    "dim_report": ("created_at", "feedback", "evaluation"),
    "dim_clinic": ("name", "city", "state"),
    "dim_professional": ("full_name", "state"),
    "dim_patient": ("patient_key",),
}

# Column names of the marts.
MART_SCHEMAS: dict[str, str] = {
    "patients": (
        "period_month date, age_group string, gender_identity string, sexual_orientation string,"
        " ethnic_group string, total_patients bigint, active_patients bigint,"
        " inactive_patients bigint, active_percentage decimal(24,2), growth_rate decimal(24,2)"
    ),
    "patient_disability": (
        "period_month date, disability_type string, total_patients bigint, active_patients bigint,"
        " inactive_patients bigint"
    ),
    "professionals": (
        "professional_sk bigint, sexual_orientation string, ethnic_group string,"
        " gender_identity string, specialty string, state string, profile_status string,"
        " active boolean, total_appointments bigint, avg_feedback_rating decimal(18,2)"
    ),
    "professional_appointments": (
        "professional_sk bigint, appointment_period date, specialty string,"
        " total_appointments bigint, completed_appointments bigint,"
        " completed_appointments_online bigint, completed_appointments_presencial bigint,"
        " cancelled_appointments_online bigint, cancelled_appointments_presencial bigint,"
        " completion_rate decimal(24,2), cancellation_rate_online decimal(24,2),"
        " cancellation_rate_presencial decimal(24,2), avg_waiting_time decimal(18,2),"
        " created_at date"
    ),
}
