"""Registered queries and their SQL twins, named by operator id.

Results are made comparable across engines: decimals as doubles, arrays as text,
surrogate keys replaced by the natural keys they stand for.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake import functions as fn
from carelake.config import FieldMap, RefreshConfig, ValueMap
from carelake.functions.clean import MODALITY
from carelake.functions.measures import date_of_id
from carelake.operators import checks, dimensions, marts
from carelake.operators.dedup import any_per_key, latest_cancellation, latest_per_key, newest, newest_touched
from carelake.operators.fact import FACT_COLUMNS, fact_appointments, fact_keys, fact_reads, fact_rejects
from carelake.operators.typed import build_typed, clean_rows, rejected_values
from carelake.operators.upsert import apply_changes, changes, insert_new, upsert, upsert_metrics
from carelake.plans import dashboard, tiles
from carelake.plans.refresh import Refresh, RefreshFailed, rejected_report, summary_totals
from carelake.schemas import MODEL_KEYS, MODEL_SCHEMAS, NATURAL_KEYS, PII_COLUMNS, SPECS
from carelake.session import tune
from carelake.sources import readers
from carelake.sources.store import PART, ROW, LayerStore, materialize, month_of, scratch_root
from verification import oracle
from verification.oracle import AS_OF, half_up, hundredths, mean_h, pct_h
from verification.standin import DriverTables, source_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


class Tables(dict):
    """Typed tables by entity, planned when asked for."""

    def __init__(self, layers: Layers) -> None:
        super().__init__()
        self.layers = layers

    def __missing__(self, entity: str) -> DataFrame:
        self[entity] = build_typed(self.layers.raw(entity), SPECS[entity])
        return self[entity]

    def lean(self, entity: str, columns: Sequence[str]) -> DataFrame:
        """The typed table with no more columns than it takes to have ``columns`` right."""
        return build_typed(self.layers.raw(entity), SPECS[entity], columns=columns)

    def for_fact(self, columns: Sequence[str] = FACT_COLUMNS) -> dict[str, DataFrame]:
        lean = {entity: self.lean(entity, read) for entity, read in fact_reads(columns).items()}
        return {e: self[e] for e in ("professional", "clinic", "user", "address_state")} | lean


class Layers:
    """Plans of all layers over one set of driver tables; nothing runs until a query does."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = tune(spark)
        self.sf_dir = sf_dir
        self.tables = DriverTables(spark, sf_dir)
        self.typed = Tables(self)

    def driver(self, name: str) -> DataFrame:
        return self.tables[name]

    def source(self, entity: str) -> DataFrame:
        return source_table(self.tables, entity)

    def raw(self, entity: str) -> DataFrame:
        return readers.raw_table(self.source(entity), SPECS[entity], FieldMap())

    @cached_property
    def dim_date(self) -> DataFrame:
        return dimensions.dim_date(self.typed.lean("appointment", ["created_at", "appointment_date"]))

    @cached_property
    def dim_report(self) -> DataFrame:
        # The same columns as the fact reads: a query that needs both has them from one shuffle.
        return dimensions.dim_report(self.typed.lean("report", fact_reads(["report_id"])["report"]))

    @cached_property
    def dim_clinic(self) -> DataFrame:
        return dimensions.dim_clinic(self.typed["clinic"], self.typed["address_state"])

    @cached_property
    def dim_professional(self) -> DataFrame:
        return self.professionals()

    @cached_property
    def dim_patient(self) -> DataFrame:
        return self.patients()

    def professionals(self, *columns: str) -> DataFrame:
        return dimensions.dim_professional(self.typed["professional"], self.typed, columns=columns or None)

    def patients(self, *columns: str) -> DataFrame:
        return dimensions.dim_patient(
            self.typed["user"], self.typed["profile"], self.typed, columns=columns or None
        )

    @cached_property
    def professional_names(self) -> DataFrame:
        return self.professionals("professional_id", "full_name", "state")

    @property
    def dims(self) -> dict[str, DataFrame]:
        names = ("dim_date", "dim_report", "dim_clinic", "dim_professional", "dim_patient")
        return {n: getattr(self, n) for n in names}

    def fact(self, *columns: str, keyed: bool = True) -> DataFrame:
        wanted = columns or FACT_COLUMNS
        dims = {"dim_patient": self.patients("patient_key", "patient_id")}
        return fact_appointments(self.typed.for_fact(wanted), dims if "patient_id" in wanted else None, wanted, keyed=keyed)

    @cached_property
    def mart_patients(self) -> DataFrame:
        return marts.mart_patients(self.patients(*_PATIENT_MART_COLUMNS), AS_OF)

    @cached_property
    def mart_disability(self) -> DataFrame:
        return marts.mart_patient_disability(self.patients("created_at", "is_active", "disability_type"))

    @cached_property
    def mart_professionals(self) -> DataFrame:
        fact = self.fact("professional_id", "status", "report_id")
        dim = self.professionals(
            "professional_id", "sexual_orientation", "ethnic_group", "gender_identity",
            "specialty", "state", "profile_status", "active",
        )
        return marts.mart_professionals(dim, fact, self.dim_report)

    @cached_property
    def mart_appointments(self) -> DataFrame:
        fact = self.fact("professional_id", "date_id", "created_date_id", "status", "type", "waiting_time")
        return marts.mart_professional_appointments(self.professionals("professional_id", "specialty"), fact)


_PATIENT_MART_COLUMNS = (
    "created_at", "birth_date", "is_active", "gender_identity", "sexual_orientation", "ethnic_group",
)


def comparable(df: DataFrame) -> DataFrame:
    def column(f: T.StructField):
        if isinstance(f.dataType, T.DecimalType):
            return F.col(f.name).cast("double").alias(f.name)
        if isinstance(f.dataType, T.ArrayType):
            return F.array_join(f.name, "|").alias(f.name)
        return F.col(f.name)

    return df.select([column(f) for f in df.schema.fields])


def register(name: str, sql: str | None = None):
    def add(build: Callable[[Layers], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: comparable(build(Layers(spark, sf_dir)))
        if sql is not None:
            ORACLE[name] = oracle.with_ctes(sql)
        return build

    return add


def with_professional(df: DataFrame, dim: DataFrame, *extra: str) -> DataFrame:
    """Replace ``professional_sk`` by the natural key it stands for."""
    natural = dim.select(F.col("professional_id").alias("professional_sk"), "full_name", *extra)
    return df.join(natural, "professional_sk", "left").drop("professional_sk")


# --- sources and loading -----------------------------------------------------------

register("s1_read_source", "select count(*) as n, count(distinct o_custkey) as customers from orders")(
    lambda q: readers.read_source(
        q.spark, readers.SourceConfig(format="parquet", path=q.sf_dir), "orders"
    ).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"))
)
register(
    "s2_align",
    "select c_custkey as id, c_name as name, cast(null as varchar) as email from customer",
)(
    lambda q: readers.align(
        readers.rename(q.driver("customer"), {"c_custkey": "id", "c_name": "name"}), ["id", "name", "email"]
    )
)
register(
    "s3_to_text",
    """select cast(event_id as varchar) as event_id,
        case when date_trunc('second', ts) = ts then strftime(ts, '%Y-%m-%dT%H:%M:%S')
            else strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') end as ts, event_type,
        case when user_id % 2 = 0 then 'True' else 'False' end as even_user
    from events""",
)(
    lambda q: readers.to_text(
        q.driver("events").select(
            "event_id", "ts", "event_type", (F.col("user_id") % 2 == 0).alias("even_user")
        )
    )
)
register(
    "s4_null_pii",
    "select id, password, email, phone, first_name from raw_user",
)(lambda q: readers.null_pii(q.source("user")).select("id", "password", "email", "phone", "first_name"))
register(
    "s5_seed_if_empty",
    """select 'full' as source_table, id, status from source_appointment where status = 'cancelled'
    union all select 'empty', '1', 'scheduled'""",
)(
    lambda q: _union(
        readers.seed_if_empty(
            q.source("appointment").filter(kept).select("id", "status"), {"id": "1", "status": "scheduled"}
        ).select(F.lit(name).alias("source_table"), "id", "status")
        for name, kept in (("full", "status = 'cancelled'"), ("empty", "status = 'never used'"))
    )
)
register(
    "s6_raw_row_counts",
    " union all ".join(f"select '{n}' as table_name, count(*) as raw_rows from raw_{n}" for n in SPECS),
)(
    lambda q: _union(
        q.raw(n).agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("raw_rows")) for n in SPECS
    )
)


def _union(parts) -> DataFrame:
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def _missing_source(q: Layers) -> DataFrame:
    """A table that exists is read; one that does not is reported as missing."""
    source = readers.SourceConfig(format="parquet", path=q.sf_dir)
    try:
        readers.read_source(q.spark, source, "appointment")
        missing = False
    except readers.SourceTableMissing:
        missing = True
    orders = readers.read_source(q.spark, source, "orders")
    return orders.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"), F.lit(missing).alias("appointment_missing")
    )


register(
    "s7_missing_source",
    "select o_orderstatus, count(*) as orders, true as appointment_missing from orders group by 1",
)(_missing_source)
register(
    "s8_empty_target",
    "select created_at, feedback, evaluation from dim_report",
)(
    # Insert into a freshly created target.
    lambda q: insert_new(
        readers.empty_df(q.spark, MODEL_SCHEMAS["dim_report"]), q.dim_report, ["report_id"]
    ).drop("report_id")
)


def _order_versions(q: Layers) -> tuple[DataFrame, DataFrame]:
    """Target: one row per customer from urgent orders; source: one from all other orders."""
    orders = q.driver("orders")

    def per_customer(df: DataFrame) -> DataFrame:
        return df.groupBy(F.col("o_custkey").alias("k")).agg(
            F.max("o_orderdate").alias("last_order"),
            F.count(F.lit(1)).alias("n"),
            F.min("o_orderstatus").alias("status"),
        )

    urgent = F.col("o_orderpriority") == "1-URGENT"
    return per_customer(orders.filter(urgent)), per_customer(orders.filter(~urgent))


_VERSIONS = """with t as (select o_custkey as k, max(o_orderdate) as last_order, count(*) as n,
        min(o_orderstatus) as status from orders where o_orderpriority = '1-URGENT' group by 1),
    s as (select o_custkey as k, max(o_orderdate) as last_order, count(*) as n,
        min(o_orderstatus) as status from orders where o_orderpriority <> '1-URGENT' group by 1) """
register(
    "s9_upsert",
    _VERSIONS + "select * from s union all select * from t where k not in (select k from s)",
)(lambda q: upsert(*_order_versions(q), ["k"]))
register(
    "s9_upsert_columns",
    _VERSIONS
    + """select coalesce(s.k, t.k) as k, case when t.k is null then s.last_order else t.last_order end as last_order,
        case when s.k is null then t.n else s.n end as n,
        case when t.k is null then s.status else t.status end as status
    from t full join s on s.k = t.k""",
)(lambda q: upsert(*_order_versions(q), ["k"], update_cols=["n"]))
register(
    "s10_insert_new",
    _VERSIONS + "select * from t union all select * from s where k not in (select k from t)",
)(lambda q: insert_new(*_order_versions(q), ["k"]))
register(
    "s11_upsert_metrics",
    _VERSIONS
    + """select count(*) as eligible, count(*) filter (where t.k is null) as inserted,
        count(*) filter (where t.k is not null) as updated from s left join t on s.k = t.k""",
)(lambda q: upsert_metrics(*_order_versions(q), ["k"]))


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn(ROW, fn.surrogate(*df.columns)).withColumn(PART, month_of(F.col("last_order")))


def _feed(q: Layers) -> tuple[DataFrame, DataFrame, DataFrame]:
    target, src = (materialize(_hashed(df), "versions") for df in _order_versions(q))
    found = changes(target.select("k", ROW, PART), src, ["k"])
    return target, src, materialize(found, "feed")


def _upsert_by_parts(q: Layers) -> DataFrame:
    """Only months that a changed row is in, or was in, are made anew."""
    target, _, found = _feed(q)
    feed = found.filter("_op is not null")
    touched = feed.select(F.explode(F.array(PART, "_old_part")).alias(PART)).distinct()
    rest, kept = (target.join(touched, PART, how) for how in ("left_semi", "left_anti"))
    merged = apply_changes(rest.drop(PART), feed, ["k"])
    return merged.unionByName(kept.drop(PART)).drop(ROW)


register(
    "s9_upsert_by_parts",
    _VERSIONS + "select * from s union all select * from t where k not in (select k from s)",
)(_upsert_by_parts)
register(
    "s11_change_feed",
    _VERSIONS
    + """select case when t.k is null then 'insert' when (s.last_order, s.n, s.status) is distinct from
            (t.last_order, t.n, t.status) then 'update' end as op, count(*) as n,
        count(*) filter (where date_trunc('month', s.last_order) <> date_trunc('month', t.last_order)) as moved
    from s left join t on s.k = t.k group by 1""",
)(
    lambda q: _feed(q)[2].groupBy(F.col("_op").alias("op")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(PART) != F.col("_old_part")).alias("moved")
    )
)
register(
    "s12_null_after_use",
    """select user_id, cast(null as varchar) as first_name, cast(null as varchar) as last_name, patient_key
    from user_key""",
)(
    lambda q: dimensions.null_after_use(
        dimensions.users_with_key(q.typed["user"]), "first_name", "last_name"
    ).select("user_id", "first_name", "last_name", "patient_key")
)
_PARTNER = FieldMap(
    tables={"appointment": "lineitem"},
    columns={"appointment": {"l_orderkey": "id", "l_shipdate": "date", "l_returnflag": "status", "l_linestatus": "type"}},
    values={
        "appointment": {
            "status": ValueMap({"completed": ("a",), "cancelled": ("r",)}, "scheduled"),
            "type": ValueMap({"Online": ("o",), "Presencial": ("f",)}, "Outro"),
        }
    },
)
register(
    "s13_field_map",
    """select cast(l_orderkey as varchar) as id, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') as date,
        case l_returnflag when 'A' then 'completed' when 'R' then 'cancelled' else 'scheduled' end as status,
        case l_linestatus when 'O' then 'Online' when 'F' then 'Presencial' else 'Outro' end as type
    from lineitem""",
)(
    lambda q: readers.raw_table(
        q.driver(_PARTNER.table_name("appointment")), SPECS["appointment"], _PARTNER
    ).select("id", "date", "status", "type")
)

# --- cleaning rules ------------------------------------------------------------------

register("c1_clean_id", f"select id, {oracle.sql_id('id')} as cleaned from source_appointment")(
    lambda q: q.source("appointment").select("id", fn.clean_id("id").alias("cleaned"))
)
register("c2_blank_to_null", f"select id, {oracle.sql_text('feedback')} as cleaned from source_report")(
    lambda q: q.source("report").select("id", fn.blank_to_null("feedback").alias("cleaned"))
)
register("c3_guarded_int", f"select id, eval, {oracle.sql_int('eval')} as cleaned from source_report")(
    lambda q: q.source("report").select("id", "eval", fn.guarded_int("eval").alias("cleaned"))
)
register("c4_parse_bool", f"select id, is_active, {oracle.sql_bool('is_active')} as cleaned from source_user")(
    lambda q: q.source("user").select("id", "is_active", fn.parse_bool("is_active").alias("cleaned"))
)
register("c5_to_utc", f"select id, date, {oracle.sql_time('date')} as cleaned from source_appointment")(
    lambda q: q.source("appointment").select("id", "date", fn.to_utc("date").alias("cleaned"))
)
register(
    "c6_parse_price",
    f"""select id, consult_price, cast({oracle.sql_price('consult_price')} as double) as cleaned,
        cast({oracle.sql_price('online_clinic_consult_price')} as double) as online_cleaned
    from source_clinic""",
)(
    lambda q: q.source("clinic").select(
        "id",
        "consult_price",
        fn.parse_price("consult_price").alias("cleaned"),
        fn.parse_price("online_clinic_consult_price").alias("online_cleaned"),
    )
)
register(
    "c6_parse_price_pt",
    """select id, cast(try_cast(replace(case when contains(kept, ',') then replace(kept, '.', '') else kept end,
        ',', '.') as decimal(10, 2)) as double) as cleaned
    from (select id, regexp_replace(trim(consult_price), '[^0-9,.-]', '', 'g') as kept from source_clinic)""",
)(lambda q: q.source("clinic").select("id", fn.parse_price("consult_price", "pt").alias("cleaned")))
register(
    "c7_keep_numeric_key",
    "select id, name from source_disabilitytype where regexp_full_match(trim(id), '[0-9]+')",
)(lambda q: fn.keep_numeric_key(q.source("disabilitytype"), "id").select("id", "name"))
register("c8_keep_nonblank_key", "select id, appointment_id from source_report where nullif(trim(feedback), '') is not null")(
    lambda q: fn.keep_nonblank_key(q.source("report"), "feedback").select("id", "appointment_id")
)
register("c9_keep_nonnull_key", "select id, type from source_appointment where type is not null")(
    lambda q: fn.keep_nonnull_key(q.source("appointment"), "type").select("id", "type")
)
register(
    "c10_rename",
    """select clinic_id, address_line2, zip_code from clean_clinic""",
)(lambda q: clean_rows(q.raw("clinic"), SPECS["clinic"]).select("clinic_id", "address_line2", "zip_code"))
_CHANNEL = """case l_linenumber when 1 then 'telemed' when 2 then 'Video' when 3 then 'clinic' when 4 then 'ONLINE'
    when 5 then 'Face-to-Face' when 6 then 'x' end"""
register(
    "c11_map_values",
    f"select channel, {oracle.sql_modality('channel')} as modality, count(*) as n from"
    f" (select {_CHANNEL} as channel from lineitem) group by 1, 2",
)(
    lambda q: q.driver("lineitem")
    .select(F.expr(_CHANNEL).alias("channel"))
    .groupBy("channel", fn.map_values("channel", MODALITY).alias("modality"))
    .agg(F.count(F.lit(1)).alias("n"))
)

# --- deduplication ----------------------------------------------------------------------

register("d_a_latest_per_key", "select * from typed_report")(
    lambda q: latest_per_key(clean_rows(q.raw("report"), SPECS["report"]), ["report_id"], [newest()])
)
register(
    "d_a_latest_event_per_user",
    """select user_id, event_id, event_type, value from events qualify row_number() over
        (partition by user_id order by ts desc, event_id, event_type, value, props) = 1""",
)(
    lambda q: latest_per_key(
        q.driver("events").select(
            "event_id", "ts", "user_id", "event_type", "value", "props"
        ),
        ["user_id"],
        [F.col("ts").desc()],
        [F.col(c).asc() for c in ("event_id", "event_type", "value", "props")],
    ).select("user_id", "event_id", "event_type", "value")
)
register(
    "d_b_latest_touched",
    "select user_id, created_at, updated_at, is_active from typed_user",
)(
    lambda q: latest_per_key(clean_rows(q.raw("user"), SPECS["user"]), ["user_id"], [newest_touched()]).select(
        "user_id", "created_at", "updated_at", "is_active"
    )
)
register("d_c_any_per_key", "select * from typed_profile_disability_types")(
    lambda q: any_per_key(
        clean_rows(q.raw("profile_disability_types"), SPECS["profile_disability_types"]), ["id"]
    )
)
register("d_d_latest_cancellation", "select * from latest_cancellation")(
    lambda q: latest_cancellation(q.typed["cancellation"])
)
register(
    "d_e_distinct",
    "select distinct status, type, professional_id from clean_appointment",
)(
    lambda q: clean_rows(q.raw("appointment"), SPECS["appointment"])
    .select("status", "type", "professional_id")
    .distinct()
)

# --- typed tables --------------------------------------------------------------------------

_TYPED_ORDER = (
    "privacydocument", "appointment", "cancellation", "profile", "profile_disability_types", "report", "user",
    "clinic", "professional", "professional_disability_types", "address_state", "disabilitytype",
    "sexualorientation", "pronoun", "ethnicgroup", "genderidentity",
)


def _typed_sql(entity: str) -> str:
    columns = ", ".join(
        f'cast("{c.target}" as double) as "{c.target}"' if c.rule == "price" else f'"{c.target}"'
        for c in SPECS[entity].columns
    )
    return f"select {columns} from typed_{entity}"


for _i, _entity in enumerate(_TYPED_ORDER, 1):
    register(f"t{_i}_{_entity}", _typed_sql(_entity))(lambda q, e=_entity: q.typed[e])

# --- star schema ------------------------------------------------------------------------------

register("m1_dim_date", "select * from dim_date")(lambda q: q.dim_date)


def _extended_dates(q: Layers) -> DataFrame:
    """A dimension that knows only the days of on-line appointments, completed on both ends."""
    online = q.typed["appointment"].filter("type = 'Online' and status = 'cancelled'")
    return dimensions.dim_date(q.typed["appointment"], dimensions.dim_date(online))


register("m1_dim_date_incremental", "select * from dim_date")(_extended_dates)
register("m2_dim_report", "select * from dim_report")(lambda q: q.dim_report.drop("report_id"))
register(
    "m3_dim_clinic",
    """select * replace (cast(consult_price as double) as consult_price,
        cast(online_clinic_consult_price as double) as online_clinic_consult_price) from dim_clinic""",
)(lambda q: q.dim_clinic.drop("clinic_id"))
register(
    "m4_disability_arrays",
    "select profile_id, array_to_string(disability_type, '|') as disability_type from profile_arrays",
)(
    lambda q: dimensions.disability_arrays(
        q.typed["profile_disability_types"], "profile_id", q.typed["disabilitytype"]
    )
)
register("m5_dim_professional", "select * from dim_professional")(
    lambda q: q.dim_professional.drop("professional_id")
)
register("m6_dim_patient", "select * from dim_patient")(lambda q: q.dim_patient.drop("patient_id"))


def _surrogates(q: Layers) -> DataFrame:
    """Distinct surrogates against distinct natural keys, per table."""
    reports = q.typed["report"].select(
        F.lit("report").alias("table_name"),
        dimensions.report_key().alias("sk"),
        F.to_json(F.struct("created_at", "feedback", "eval"), {"ignoreNullFields": "false"}).alias("natural"),
    )
    clinics = dimensions.clinics_with_state(q.typed["clinic"], q.typed["address_state"]).select(
        F.lit("clinic").alias("table_name"),
        F.col("clinic_sk").alias("sk"),
        F.to_json(F.struct("name", "city", "state"), {"ignoreNullFields": "false"}).alias("natural"),
    )
    distinct = reports.unionByName(clinics).distinct()
    per_key = distinct.groupBy("table_name", "sk").agg(F.count(F.lit(1)).alias("naturals"))
    return per_key.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("surrogates"), F.sum("naturals").alias("naturals")
    )


register(
    "m7_surrogate_keys",
    """select 'report' as table_name, count(*) as surrogates, count(*) as naturals
        from (select distinct created_at, feedback, eval from typed_report)
    union all select 'clinic', count(*), count(*) from (select distinct name, city, state from clinic_state)""",
)(_surrogates)
register("m8_waiting_minutes", "select appointment_fingerprint, waiting_time from fact")(
    lambda q: q.fact("appointment_fingerprint", "waiting_time")
)
register(
    "m9_fingerprint",
    f"""select id, md5(coalesce(id, '') || '|' || coalesce(cast({oracle.date_key('appointment_date')} as varchar), ''))
        as fingerprint from typed_appointment""",
)(
    lambda q: q.typed["appointment"].select(
        "id", fn.fingerprint("id", fn.date_id("appointment_date")).alias("fingerprint")
    )
)


def _fact_with_natural_keys(q: Layers) -> DataFrame:
    """The fact with every surrogate resolved in its dimension."""
    professional = q.professional_names.select(
        "professional_id",
        F.col("full_name").alias("professional_name"),
        F.col("state").alias("professional_state"),
    )
    clinic = q.dim_clinic.select(
        "clinic_id",
        F.col("name").alias("clinic_name"),
        F.col("city").alias("clinic_city"),
        F.col("state").alias("clinic_state"),
    )
    report = q.dim_report.select(
        "report_id",
        F.col("created_at").alias("report_created_at"),
        F.col("feedback").alias("report_feedback"),
        F.col("evaluation").alias("report_evaluation"),
        F.lit(True).alias("has_report"),
    )
    # The patients first, as they are the most: when facts are moved to them, they do not yet carry the others' texts, nor,
    # at any time, their fingerprint.
    facts = (
        q.fact(keyed=False)
        .join(q.patients("patient_id", "patient_key"), "patient_id", "left")
        .join(professional, "professional_id", "left")
        .join(clinic, "clinic_id", "left")
        .join(report, "report_id", "left")
    )
    return fact_keys(facts).drop(
        "appointment_id", "id_fact_appointment", "professional_id", "clinic_id", "report_id", "patient_id"
    )


register("m10_fact_natural_keys", "select * from fact")(_fact_with_natural_keys)
register(
    "m10_fact",
    """select appointment_fingerprint, created_date_id, status, type, date_id, waiting_time,
        professional_name is not null as has_professional, patient_key is not null as has_patient,
        clinic_name is not null as has_clinic, coalesce(has_report, false) as has_report,
        cancellation_created_at, cancellation_reason
    from fact""",
)(
    lambda q: q.fact().select(
        "appointment_fingerprint", "created_date_id", "status", "type", "date_id", "waiting_time",
        F.col("professional_id").isNotNull().alias("has_professional"),
        F.col("patient_id").isNotNull().alias("has_patient"),
        F.col("clinic_id").isNotNull().alias("has_clinic"),
        F.col("report_id").isNotNull().alias("has_report"),
        "cancellation_created_at", "cancellation_reason",
    )
)
register(
    "m10_fact_rejects",
    "select id, status, created_at from typed_appointment where appointment_date is null",
)(lambda q: fact_rejects(q.typed["appointment"]).select("id", "status", "created_at"))
register(
    "m11_fact_cancellation",
    "select appointment_fingerprint, cancellation_created_at, cancellation_reason from fact",
)(lambda q: q.fact("appointment_fingerprint", "cancellation_created_at", "cancellation_reason"))



def _superseded(q: Layers) -> DataFrame:
    """Facts before and after cancelled appointments have moved a year on: the old ones go, the new ones come."""
    def hashed(df: DataFrame) -> DataFrame:
        return df.withColumn(ROW, fn.surrogate(*df.columns)).withColumn(PART, month_of(date_of_id(F.col("date_id"))))

    columns = ("appointment_fingerprint", "date_id", "status")
    before = materialize(hashed(q.fact(*columns)), "facts")
    moves = F.lower("status") == "cancelled"
    later = F.when(moves, F.col("appointment_date") + F.expr("interval 366 days")).otherwise(F.col("appointment_date"))
    moved = {"appointment": q.typed.for_fact(columns)["appointment"].withColumn("appointment_date", later)}
    after = materialize(hashed(fact_appointments(moved, None, columns)), "facts-after")
    found = changes(before.select("appointment_fingerprint", ROW, PART), after, ["appointment_fingerprint"], removing=True)
    return found.groupBy(F.col("_op").alias("op"), F.coalesce(PART, "_old_part").alias("month")).agg(F.count(F.lit(1)).alias("facts"))


_FACT_MONTH = "strftime(make_date(date_id // 10000, date_id // 100 % 100, 1), '%Y-%m')"
register(
    "m10_superseded_facts",
    f"""select cast(null as varchar) as op, {_FACT_MONTH} as month, count(*) as facts from fact
        where lower(coalesce(status, '')) <> 'cancelled' group by 2
    union all select 'remove', {_FACT_MONTH}, count(*) from fact where lower(status) = 'cancelled' group by 2
    union all select 'insert', strftime(appointment_date + interval 366 days, '%Y-%m'), count(*) from typed_appointment
        where appointment_date is not null and lower(status) = 'cancelled' group by 2""",
)(_superseded)

# --- marts -----------------------------------------------------------------------------------------

register(
    "k1_age_bucket",
    f"""select user_id, case when birth_date is null then 'N/I' when age between 18 and 25 then '18-25'
        when age between 26 and 35 then '26-35' when age between 36 and 45 then '36-45'
        when age between 46 and 60 then '46-60' else '60+' end as age_group,
        case when birth_date is null then 'N/I' when age < 18 then '<18' when age between 18 and 25 then '18-25'
        when age between 26 and 35 then '26-35' when age between 36 and 45 then '36-45'
        when age between 46 and 60 then '46-60' else '60+' end as strict_age_group
    from (select user_id, birth_date, extract(year from age(timestamp '{AS_OF}', birth_date)) as age
        from typed_user)""",
)(
    lambda q: q.typed["user"].select(
        "user_id",
        fn.age_bucket("birth_date", AS_OF).alias("age_group"),
        fn.age_bucket("birth_date", AS_OF, strict_minor_bucket=True).alias("strict_age_group"),
    )
)
_MART_PATIENTS_SQL = f"""select period_month, age_group, gender_identity, sexual_orientation, ethnic_group,
    total_patients, active_patients, inactive_patients, {hundredths('active_h')} as active_percentage,
    {hundredths('growth_h')} as growth_rate from mart_patients"""
register("k2_mart_patients", _MART_PATIENTS_SQL)(lambda q: q.mart_patients)
register("k3_month_growth", f"select period_month as month, {hundredths('growth_h')} as growth_rate from mart_growth")(
    lambda q: marts.month_growth(
        q.patients("created_at").filter("created_at is not null")
        .groupBy(fn.calendar_month("created_at").alias("month"))
        .agg(F.count(F.lit(1)).alias("total")),
        "month",
        "total",
    )
)
register("k4_mart_patient_disability", "select * from mart_patient_disability")(lambda q: q.mart_disability)
register(
    "k5_mart_professionals",
    f"""select full_name, sexual_orientation, ethnic_group, gender_identity, specialty, state, profile_status,
        active, total_appointments, {hundredths('rating_h')} as avg_feedback_rating from mart_professionals""",
)(lambda q: with_professional(q.mart_professionals, q.professional_names))
register(
    "k6_mart_professional_appointments",
    f"""select full_name, state, appointment_period, specialty, total_appointments, completed_appointments,
        completed_appointments_online, completed_appointments_presencial, cancelled_appointments_online,
        cancelled_appointments_presencial, {hundredths('completion_h')} as completion_rate,
        {hundredths('cancel_online_h')} as cancellation_rate_online,
        {hundredths('cancel_presencial_h')} as cancellation_rate_presencial,
        {hundredths('waiting_h')} as avg_waiting_time,
        make_date(last_created // 10000, last_created // 100 % 100, last_created % 100) as created_at
    from mart_professional_appointments""",
)(lambda q: with_professional(q.mart_appointments, q.professional_names, "state"))
register(
    "k7_pct",
    f"""select l_suppkey, {hundredths(pct_h('returned', 'total'))} as returned_pct,
        {hundredths(pct_h('total', 'nullif(returned, returned)'))} as no_base
    from (select l_suppkey, count(*) as total, count(*) filter (where l_returnflag = 'R') as returned
        from lineitem group by 1)""",
)(
    lambda q: q.driver("lineitem")
    .groupBy("l_suppkey")
    .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    .select(
        "l_suppkey",
        fn.pct("returned", "total").alias("returned_pct"),
        fn.pct(F.col("total"), F.lit(0)).alias("no_base"),
    )
)
register(
    "k8_labels",
    """select specialty, coalesce(specialty, 'N/I') as labelled, coalesce(specialty, 'Não informada') as named,
        count(*) as n from typed_professional group by 1""",
)(
    lambda q: q.typed["professional"]
    .groupBy("specialty")
    .agg(F.count(F.lit(1)).alias("n"))
    .select("specialty", fn.label("specialty").alias("labelled"), fn.label("specialty", "Não informada").alias("named"), "n")
)

# --- dashboard -------------------------------------------------------------------------------------

register(
    "q1_patients_per_month",
    f"""select period_month as month, cast(sum(total_patients) as bigint) as total_patients,
        {hundredths(half_up('sum(active_h)', 'count(active_h)'))} as avg_active_pct
    from mart_patients group by 1""",
)(lambda q: dashboard.q_patients_per_month(q.mart_patients))
register(
    "q2_age_distribution",
    f"""select age_group, cast(sum(total_patients) as bigint) as total_patients,
        {hundredths(half_up('sum(active_h)', 'count(active_h)'))} as avg_active_pct
    from mart_patients where period_month = (select max(period_month) from mart_patients) group by 1""",
)(lambda q: dashboard.q_age_distribution(materialize(q.mart_patients, "mart_patients")))


def _top_disabilities(q: Layers) -> DataFrame:
    # Both marts read the patient dimension.
    patients = materialize(q.patients(*_PATIENT_MART_COLUMNS, "disability_type"), "dim_patient")
    return dashboard.q_top_disabilities(
        marts.mart_patient_disability(patients), marts.mart_patients(patients, AS_OF)
    )


register(
    "q3_top_disabilities",
    """select disability_type, total_patients from mart_patient_disability
    where period_month = (select max(period_month) from mart_groups)
    order by total_patients desc nulls last, disability_type limit 10""",
)(_top_disabilities)
register(
    "q15_disability_share",
    f"""select disability_type, total_patients, {hundredths(oracle.pct_h('total_patients', 'total'))} as share
    from (select disability_type, cast(sum(total_patients) as bigint) as total_patients,
            cast(sum(sum(total_patients)) over () as bigint) as total
        from mart_patient_disability group by 1)""",
)(lambda q: dashboard.q_disability_share(q.mart_disability))
register(
    "q4_top_specialties",
    f"""select coalesce(specialty, 'Não informada') as specialty,
        cast(sum(total_appointments) as bigint) as total_appointments,
        {hundredths(half_up('sum(rating_h)', 'count(rating_h)'))} as avg_rating
    from mart_professionals group by 1 order by 2 desc nulls last, 1 limit 10""",
)(lambda q: dashboard.q_top_specialties(q.mart_professionals))
register(
    "q5_appointments_per_month",
    f"""select appointment_period as month, cast(sum(total_appointments) as bigint) as total_appointments,
        {hundredths(half_up('sum(completion_h)', 'count(completion_h)'))} as avg_completion_rate
    from mart_professional_appointments group by 1""",
)(lambda q: dashboard.q_appointments_per_month(q.mart_appointments))
register(
    "q6_completed_total",
    "select count(*) filter (where lower(status) = 'completed') as completed_appointments from fact",
)(lambda q: dashboard.q_completed_total(q.fact("status")))
register(
    "q7_cancellation_rate",
    f"""select cancelled, total, {hundredths(pct_h('cancelled', 'total'))} as cancellation_rate
    from (select count(*) filter (where lower(status) = 'cancelled') as cancelled, count(*) as total from fact)""",
)(lambda q: dashboard.q_cancellation_rate(q.fact("status")))
register(
    "q8_mean_waiting",
    f"""select {hundredths(mean_h('s', 'n'))} as avg_waiting_minutes
    from (select cast(sum(nullif(waiting_time, 0)) as bigint) as s, count(nullif(waiting_time, 0)) as n from fact)""",
)(lambda q: dashboard.q_mean_waiting(q.fact("waiting_time")))
register(
    "q9_completed_vs_cancelled",
    """select make_date(date_id // 10000, date_id // 100 % 100, 1) as month,
        count(*) filter (where lower(status) = 'completed') as completed_appointments,
        count(*) filter (where lower(status) = 'cancelled') as cancelled_appointments
    from fact group by 1""",
)(lambda q: dashboard.q_completed_vs_cancelled(q.fact("date_id", "status")))
register(
    "q10_rating_by_state",
    f"""select professional_state as state, cast(sum(ratings) as bigint) as ratings,
        {hundredths(mean_h('cast(sum(rating_sum) as bigint)', 'cast(sum(ratings) as bigint)'))} as avg_rating
    from professional_counts where ratings > 0 group by 1""",
)(
    lambda q: dashboard.q_rating_by_state(
        q.fact("professional_id", "report_id"), q.professional_names, q.dim_report
    )
)
register(
    "q11_professional_ratings",
    f"""select full_name, state, total_appointments, {hundredths('rating_h')} as avg_feedback_rating
    from mart_professionals""",
)(
    lambda q: with_professional(
        dashboard.q_professional_ratings(q.mart_professionals), q.professional_names, "state"
    )
)
register(
    "q12_price_over_time",
    f"""select month, {hundredths(half_up('cast(sum(price_h) as bigint)', 'count(*)'))} as avg_consult_price
    from (select make_date(f.date_id // 10000, f.date_id // 100 % 100, 1) as month,
            cast(c.consult_price * 100 as bigint) as price_h
        from fact f join dim_clinic c on c.name = f.clinic_name and c.city = f.clinic_city
            and c.state = f.clinic_state where c.consult_price is not null)
    group by 1""",
)(lambda q: dashboard.q_price_over_time(q.fact("date_id", "clinic_id"), q.dim_clinic))
register(
    "q13_appointments_by_specialty",
    """select specialty, cast(sum(total_appointments) as bigint) as total_appointments
    from mart_professional_appointments group by 1""",
)(lambda q: dashboard.q_appointments_by_specialty(q.mart_appointments))
_BAND = """case when rating_h = 0 then 'none' else cast(cast(least(rating_h // 100, 4) as bigint) as varchar) || '-'
    || cast(cast(least(rating_h // 100 + 1, 5) as bigint) as varchar) end"""
register(
    "q14_professional_cuts",
    f"""select 'specialty' as cut, coalesce(specialty, 'Não informada') as value, count(*) as professionals
        from mart_professionals group by 2
    union all select 'state', coalesce(state, 'N/I'), count(*) from mart_professionals group by 2
    union all select 'active', cast(coalesce(active, false) as varchar), count(*) from mart_professionals group by 2
    union all select 'rating_band', {_BAND}, count(*) from mart_professionals group by 2""",
)(lambda q: dashboard.q_professional_cuts(q.mart_professionals))
register(
    "q15_age_share",
    f"""select age_group, total_patients,
        {hundredths(pct_h('total_patients', 'cast(sum(total_patients) over () as bigint)'))} as share
    from (select age_group, cast(sum(total_patients) as bigint) as total_patients from mart_groups group by 1)""",
)(lambda q: dashboard.q_age_share(q.mart_patients))
register(
    "q16_active_patients", "select cast(sum(active_patients) as bigint) as active_patients from mart_groups"
)(lambda q: dashboard.q_active_patients(q.mart_patients))
register(
    "q16_registrations",
    """select cast(date_trunc('month', created_at) as date) as month, count(*) as registrations
    from dim_patient where created_at is not null group by 1""",
)(lambda q: dashboard.q_registrations(q.patients("created_at")))
register(
    "q16_status_counts",
    "select lower(coalesce(status, '')) as status, count(*) as appointments from fact group by 1",
)(lambda q: dashboard.q_status_counts(q.fact("status")))
register("q16_growth_series", f"select period_month as month, {hundredths('growth_h')} as growth_rate from mart_growth")(
    lambda q: dashboard.q_growth_series(q.mart_patients)
)
register(
    "q17_appointments_filtered",
    """select cast(date_trunc('quarter', appointment_period) as date) as period,
        cast(sum(total_appointments) as bigint) as total_appointments,
        cast(sum(completed_appointments) as bigint) as completed_appointments,
        cast(sum(cancelled_appointments_online + cancelled_appointments_presencial) as bigint)
            as cancelled_appointments
    from mart_professional_appointments where specialty = 'EUROPE' and quarter(appointment_period) = 2 group by 1""",
)(lambda q: dashboard.q_appointments_filtered(q.mart_appointments, "quarter", quarter=2, specialty="EUROPE"))
register(
    "q17_patients_filtered",
    """select cast(date_trunc('year', period_month) as date) as period,
        cast(sum(total_patients) as bigint) as total_patients,
        cast(sum(active_patients) as bigint) as active_patients
    from mart_groups where gender_identity = 'BUILDING' and sexual_orientation = 'ASIA' group by 1""",
)(
    lambda q: dashboard.q_patients_filtered(
        q.mart_patients, "year", gender_identity="BUILDING", sexual_orientation="ASIA"
    )
)


def _cube(q: Layers) -> DataFrame:
    fact = q.fact("date_id", "professional_id", "clinic_id", "report_id", "status", "waiting_time")
    return tiles.appointment_cube(fact, q.professionals("professional_id", *tiles.ATTRIBUTES), q.dim_report, q.dim_clinic)


_EUROPE = tiles.Filters("quarter", specialty="EUROPE", quarter=2)
_BY_YEAR = tiles.Filters("year", gender_identity="N/I")
_IN_ASIA = tiles.Filters("month", ethnic_group="CHINA", quarter=1)
_WHERE = {
    _EUROPE: ("quarter", "specialty = 'EUROPE' and quarter(month) = 2"),
    _BY_YEAR: ("year", "gender_identity = 'N/I'"),
    _IN_ASIA: ("month", "ethnic_group = 'CHINA' and quarter(month) = 1"),
}
_SUM = "cast(coalesce(sum({0}), 0) as bigint) as {0}"


def _tile_sql(filters: tiles.Filters, measures: str, by: str = "", having: str = "") -> str:
    grain, where = _WHERE[filters]
    return f"""select cast(date_trunc('{grain}', month) as date) as period, {by}{measures}
        from tile_facts where {where} group by 1{', 2' if by else ''} {having}"""


_COMPLETED = "count(*) filter (where lower(status) = 'completed') as completed"
_CANCELLED = "count(*) filter (where lower(status) = 'cancelled') as cancelled"
_TILES = {
    "q17_tile_completed": (tiles.tile_completed, _EUROPE, _tile_sql(_EUROPE, _COMPLETED)),
    "q17_tile_cancellation_rate": (
        tiles.tile_cancellation_rate, _BY_YEAR,
        f"select *, {hundredths(pct_h('cancelled', 'appointments'))} as cancellation_rate from ("
        + _tile_sql(_BY_YEAR, f"{_CANCELLED}, count(*) as appointments") + ")",
    ),
    "q17_tile_waiting": (
        tiles.tile_waiting, _IN_ASIA,
        f"select period, {hundredths(mean_h('s', 'n'))} as avg_waiting_minutes from ("
        + _tile_sql(_IN_ASIA, "cast(coalesce(sum(nullif(waiting_time, 0)), 0) as bigint) as s, count(nullif(waiting_time, 0)) as n") + ")",
    ),
    "q17_tile_completed_vs_cancelled": (tiles.tile_completed_vs_cancelled, _BY_YEAR, _tile_sql(_BY_YEAR, f"{_COMPLETED}, {_CANCELLED}")),
    "q17_tile_status": (
        tiles.tile_status, _EUROPE,
        "select period, completed, cancelled, n - completed - cancelled as other from ("
        + _tile_sql(_EUROPE, f"{_COMPLETED}, {_CANCELLED}, count(*) as n") + ")",
    ),
    "q17_tile_rating_by_state": (
        tiles.tile_rating_by_state, _EUROPE,
        f"select period, state, ratings, {hundredths(mean_h('s', 'ratings'))} as avg_rating from ("
        + _tile_sql(_EUROPE, "count(report_evaluation) as ratings, cast(sum(report_evaluation) as bigint) as s", "state, ", "having count(report_evaluation) > 0") + ")",
    ),
    "q17_tile_price": (
        tiles.tile_price, _BY_YEAR,
        f"select period, {hundredths(half_up('s', 'n'))} as avg_consult_price from ("
        + _tile_sql(_BY_YEAR, "cast(sum(price_h) as bigint) as s, count(price_h) as n", having="having count(price_h) > 0") + ")",
    ),
    "q17_tile_by_specialty": (tiles.tile_by_specialty, _IN_ASIA, _tile_sql(_IN_ASIA, "count(*) as appointments", "specialty, ")),
}
for _name, (_tile, _filters, _sql) in _TILES.items():
    register(_name, _sql)(lambda q, t=_tile, f=_filters: t(_cube(q), f))
register(
    "q17_tile_professionals",
    f"""select {_BAND} as rating_band, count(*) as professionals, cast(sum(total_appointments) as bigint) as total_appointments
    from mart_professionals where coalesce(specialty, 'Não informada') = 'EUROPE' group by 1""",
)(lambda q: tiles.tile_professionals(q.mart_professionals, tiles.Filters(specialty="EUROPE")))
register(
    "q17_tile_age_share",
    f"""select period, age_group, total_patients,
        {hundredths(pct_h('total_patients', 'cast(sum(total_patients) over (partition by period) as bigint)'))} as share
    from (select cast(date_trunc('year', period_month) as date) as period, age_group,
            cast(sum(total_patients) as bigint) as total_patients
        from mart_groups where sexual_orientation = 'ASIA' group by 1, 2)""",
)(lambda q: tiles.tile_age_share(q.mart_patients, tiles.Filters("year", sexual_orientation="ASIA")))
register(
    "q17_tile_patients",
    f"""select period, total_patients, active_patients,
        case when prev > 0 then {hundredths(pct_h('total_patients - prev', 'prev'))} end as growth_rate
    from (select *, lag(total_patients) over (order by period) as prev
        from (select cast(date_trunc('quarter', period_month) as date) as period,
                cast(sum(total_patients) as bigint) as total_patients, cast(sum(active_patients) as bigint) as active_patients
            from mart_groups where gender_identity = 'BUILDING' group by 1))""",
)(lambda q: tiles.tile_patients(q.mart_patients, tiles.Filters("quarter", gender_identity="BUILDING")))


def _sample_sql(entity: str) -> str:
    columns, newest_by = dashboard.SAMPLES[entity]
    shown = ", ".join(f"cast({c} as double) as {c}" if c == "consult_price" else c for c in columns)
    order = f"{newest_by} desc nulls last, " if newest_by else ""
    return f"select {shown} from typed_{entity} order by {order}{columns[0]} desc limit 20"


for _entity in dashboard.SAMPLES:
    register(f"q18_sample_{_entity}", _sample_sql(_entity))(
        lambda q, e=_entity: dashboard.q_sample(q.typed[e], e)
    )

# --- validation ------------------------------------------------------------------------------------



def _planted_duplicates(q: Layers) -> DataFrame:
    """Facts with the cancelled ones twice, as an append-only load would leave them."""
    fact = q.fact("appointment_fingerprint", "status")
    twice = F.when(F.lower("status") == "cancelled", F.lit(2)).otherwise(F.lit(1))
    return checks.check_duplicate_fingerprints(fact.withColumn("_copy", F.explode(F.sequence(F.lit(1), twice))))


register(
    "v1_duplicate_fingerprints",
    "select appointment_fingerprint, cast(2 as bigint) as n from fact where lower(status) = 'cancelled'",
)(_planted_duplicates)
register(
    "v1_duplicate_source_ids",
    "select id, count(*) as n from clean_appointment group by 1 having count(*) > 1",
)(lambda q: checks.check_duplicate_keys(clean_rows(q.raw("appointment"), SPECS["appointment"]), ["id"]))


def _planted_collisions(q: Layers) -> DataFrame:
    """Dimension rows whose key is the first digit of a hash of their first natural column: natural keys collide."""
    parts = []
    for dim, natural in NATURAL_KEYS.items():
        cut = F.substring(F.md5(F.coalesce(F.col(natural[0]).cast("string"), F.lit(""))), 1, 1)
        found = checks.check_surrogate_collisions(q.dims[dim].withColumn("_key", cut), "_key", natural)
        parts.append(found.select(F.lit(dim).alias("dimension"), F.col("_key").alias("cut_key"), "n"))
    return _union(parts)


def _planted_sql(dim: str, natural: tuple[str, ...]) -> str:
    first = f"strftime({natural[0]}, '%Y-%m-%d %H:%M:%S')" if natural[0] == "created_at" else natural[0]
    return f"""select '{dim}' as dimension, substr(md5(coalesce({first}, '')), 1, 1) as cut_key, count(*) as n
        from (select distinct {', '.join(natural)} from {dim}) group by 2 having count(*) > 1"""


register(
    "v1_planted_collisions", " union all ".join(_planted_sql(dim, natural) for dim, natural in NATURAL_KEYS.items())
)(_planted_collisions)


def _collisions(q: Layers) -> DataFrame:
    """Rows of each dimension, and keys that different natural keys share."""
    parts = []
    for dim, natural in NATURAL_KEYS.items():
        df, none = materialize(q.dims[dim], dim), F.lit(0).cast("bigint")
        n = F.count(F.lit(1))
        found = checks.check_surrogate_collisions(df, MODEL_KEYS[dim], natural)
        parts += [df.agg(n.alias("rows_checked"), none.alias("collisions")), found.agg(none.alias("rows_checked"), n.alias("collisions"))]
        parts[-2:] = [p.select(F.lit(dim).alias("dimension"), "rows_checked", "collisions") for p in parts[-2:]]
    return _union(parts).groupBy("dimension").agg(F.sum("rows_checked").alias("rows_checked"), F.sum("collisions").alias("collisions"))


register(
    "v1_surrogate_collisions",
    " union all ".join(f"select '{dim}' as dimension, count(*) as rows_checked, cast(0 as bigint) as collisions from {dim}" for dim in NATURAL_KEYS),
)(_collisions)


def _completed_totals(q: Layers) -> DataFrame:
    columns = ("professional_id", "date_id", "created_date_id", "status", "type", "waiting_time")
    fact = materialize(q.fact(*columns), "fact")
    return checks.completed_totals(marts.mart_professional_appointments(q.professionals("professional_id", "specialty"), fact), fact)


register(
    "v2_completed_totals",
    """select (select cast(sum(completed_appointments) as bigint) from mart_professional_appointments)
            as mart_completed,
        count(*) filter (where lower(status) = 'completed') as fact_completed
    from fact where professional_name is not null""",
)(_completed_totals)


def _completed_by_month(q: Layers) -> DataFrame:
    columns = ("professional_id", "date_id", "created_date_id", "status", "type", "waiting_time")
    fact = materialize(q.fact(*columns), "fact")
    return checks.completed_by_month(marts.mart_professional_appointments(q.professionals("professional_id", "specialty"), fact), fact)


register(
    "v2_completed_by_month",
    """select coalesce(m.month, f.month) as month, coalesce(m.n, 0) as mart_completed, coalesce(f.n, 0) as fact_completed
    from (select appointment_period as month, cast(sum(completed_appointments) as bigint) as n
            from mart_professional_appointments group by 1) m
        full join (select make_date(date_id // 10000, date_id // 100 % 100, 1) as month,
                count(*) filter (where lower(status) = 'completed') as n
            from fact where professional_name is not null group by 1) f on f.month = m.month""",
)(_completed_by_month)
register(
    "v6_model_pii",
    """select 'dim_patient' as table_name, 'first_name' as column_name, count(first_name) as filled from dim_patient
    union all select 'dim_patient', 'last_name', count(last_name) from dim_patient
    union all select 'dim_professional', 'full_name', count(*) filter (where not regexp_full_match(full_name, '[0-9a-f]{32}'))
    from dim_professional""",
)(lambda q: checks.model_pii({"dim_patient": q.patients("first_name", "last_name"), "dim_professional": q.professionals("full_name")}))


def _reference_counts(q: Layers) -> DataFrame:
    """Facts and dimensions with the columns that refer and are referred to; only patients are needed twice."""
    columns = tuple(checks.FACT_REFERENCES)
    typed = q.typed.for_fact(columns)
    dims = {
        "dim_date": dimensions.dim_date(typed["appointment"]),  # from one shuffle with the facts
        "dim_report": q.dim_report,
        "dim_clinic": q.dim_clinic,
        "dim_professional": q.professionals("professional_id"),
        "dim_patient": materialize(q.patients("patient_key", "patient_id"), "dim_patient"),
    }
    return checks.reference_counts(fact_appointments(typed, dims, columns), dims)


register(
    "v3_references",
    " union all ".join(
        f"select '{c}' as column_name, cast(0 as bigint) as orphans, count(*) filter (where {test}) as nulls from fact"
        for c, test in {
            "created_date_id": "created_date_id is null",
            "date_id": "date_id is null",
            "professional_id": "professional_name is null",
            "patient_id": "patient_key is null",
            "clinic_id": "clinic_name is null",
            "report_id": "has_report is null",
        }.items()
    ),
)(_reference_counts)


def _rerun(q: Layers) -> DataFrame:
    """Load once, load again: the second load updates everything and inserts nothing."""
    first = materialize(q.typed["appointment"], "appointment")
    return upsert_metrics(first, q.typed["appointment"], ["id"])


register(
    "v4_rerun_inserts_nothing",
    "select count(*) as eligible, cast(0 as bigint) as inserted, count(*) as updated from typed_appointment",
)(_rerun)
register(
    "v5_deduplicate_facts",
    "select distinct appointment_fingerprint from fact",
)(
    lambda q: checks.deduplicate_facts(
        # Facts loaded twice, as an append-only load would leave them.
        (once := q.fact("id_fact_appointment", "appointment_fingerprint")).unionByName(once)
    ).select("appointment_fingerprint")
)
register(
    "v6_pii_absent",
    " union all ".join(
        f"select '{c}' as column_name, cast(0 as bigint) as filled"
        for c in SPECS["user"].raw_columns
        if c in PII_COLUMNS
    ),
)(
    lambda q: checks.filled_counts(
        q.typed["user"], [c for c in SPECS["user"].raw_columns if c in PII_COLUMNS]
    )
)

# --- runs --------------------------------------------------------------------------------------------


def _refresh(q: Layers, run: str, kind: type[Refresh] = Refresh) -> Refresh:
    root = f"{scratch_root(q.spark)}/carelake/{run}-{uuid.uuid4().hex}"
    return kind(q.spark, RefreshConfig(root=root, as_of=AS_OF), load=q.source)


_MODEL_TABLES = {
    "dim_date": "dim_date",
    "dim_report": "dim_report",
    "dim_clinic": "dim_clinic",
    "dim_professional": "dim_professional",
    "dim_patient": "dim_patient",
    "fact_appointments": "fact",
}
_MART_TABLES = {
    "patients": "mart_groups",
    "patient_disability": "mart_patient_disability",
    "professionals": "mart_professionals",
    "professional_appointments": "mart_professional_appointments",
}
_COUNTS = [("raw", n, f"raw_{n}") for n in SPECS] + [("typed", n, f"typed_{n}") for n in SPECS]
_COUNTS += [("model", n, c) for n, c in _MODEL_TABLES.items()] + [("mart", n, c) for n, c in _MART_TABLES.items()]
_SUMMARY_SQL = " union all ".join(
    f"select '{layer}' as layer, '{name}' as table_name, count(*) as table_rows from {cte}"
    for layer, name, cte in _COUNTS
) + """ union all select 'model', 'fact_rejects', count(*) from typed_appointment where appointment_date is null"""

register("l1_refresh", _SUMMARY_SQL)(
    lambda q: _refresh(q, "refresh").run().select("layer", "table_name", "table_rows")
)
register(
    "l2_run_totals",
    f"""select layer, count(*) as tables, cast(sum(table_rows) as bigint) as eligible,
        cast(sum(table_rows) as bigint) as inserted, cast(0 as bigint) as updated,
        cast(sum(table_rows) as bigint) as table_rows from ({_SUMMARY_SQL}) group by 1""",
)(lambda q: summary_totals(_refresh(q, "totals").run()))


def _rejected_sql() -> str:
    parts = []
    for name, spec in SPECS.items():
        for c in spec.columns:
            if c.lossy:
                src = f'"{c.source}"'
                parts.append(
                    f"select '{name}' as table_name, '{c.target}' as column_name, count(*) filter (where"
                    f" {oracle.sql_id(src)} is not null and {oracle._RULES[c.rule](src)} is null) as rejected"
                    f" from raw_{name}"
                )
    return " union all ".join(parts)


register("l2_rejected_values", _rejected_sql())(
    lambda q: rejected_report({n: q.raw(n) for n in SPECS})
)


class _FailingReports(Refresh):
    def load_typed(self, spec, raw):
        if spec.name == "report":
            raise ValueError("typed report failed")
        return super().load_typed(spec, raw)


def _stops_on_failure(q: Layers) -> DataFrame:
    """A typed table that fails stops the run before the model; nothing is published."""
    refresh = _refresh(q, "failing", _FailingReports)
    try:
        refresh.run()
        stopped = False
    except RefreshFailed:
        stopped = True
    published = LayerStore(q.spark, refresh.cfg.root).read_published("typed", "appointment") is not None
    # The raw layer was loaded before the failure.
    return refresh.raw["appointment"].groupBy("status").agg(
        F.count(F.lit(1)).alias("loaded"),
        F.lit(stopped).alias("stopped"),
        F.lit("model" in refresh.seconds).alias("model_built"),
        F.lit(published).alias("published"),
    )


register(
    "l3_stop_on_failure",
    """select status, count(*) as loaded, true as stopped, false as model_built, false as published
    from raw_appointment group by 1""",
)(_stops_on_failure)
