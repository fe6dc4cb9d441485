"""The same results in DuckDB SQL, written as named common table expressions."""

from __future__ import annotations

import re

from carelake.schemas import PII_COLUMNS, SPECS, Column, TableSpec
from verification.standin import DuckDialect, source_selects

AS_OF = "2025-02-28"

# Fixed values, written out here so that a wrong entry in the code under test shows.
TRUE_WORDS = ("true", "t", "1", "yes", "y", "sim", "s")
FALSE_WORDS = ("false", "f", "0", "no", "n", "nao", "não")
MODALITY = {
    "Online": ("online", "telemed", "teleconsulta", "remote", "remoto", "video"),
    "Presencial": ("presencial", "clinic", "local", "face-to-face"),
}


def _words(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def sql_id(x: str) -> str:
    return f"nullif(trim({x}), '')"


def sql_text(x: str) -> str:
    return f"nullif({x}, '')"


def sql_int(x: str) -> str:
    return f"case when regexp_full_match(trim({x}), '[0-9]+') then try_cast(trim({x}) as integer) end"


def sql_bool(x: str) -> str:
    return (
        f"case when lower(trim({x})) in ({_words(TRUE_WORDS)}) then true"
        f" when lower(trim({x})) in ({_words(FALSE_WORDS)}) then false end"
    )


def sql_time(x: str) -> str:
    return f"(try_cast(nullif(trim({x}), '') as timestamptz) at time zone 'UTC')"


def sql_price(x: str) -> str:
    kept = f"regexp_replace(trim({x}), '[^0-9,.-]', '', 'g')"
    return f"try_cast(replace({kept}, ',', '.') as decimal(10, 2))"


def sql_modality(x: str) -> str:
    cases = " ".join(f"when lower({x}) in ({_words(words)}) then '{name}'" for name, words in MODALITY.items())
    return f"case {cases} else 'Outro' end"


_RULES = {
    "id": sql_id,
    "trim": lambda x: f"trim({x})",
    "text": sql_text,
    "asis": lambda x: x,
    "int": sql_int,
    "bool": sql_bool,
    "time": sql_time,
    "price": sql_price,
}


def half_up(n: str, d: str) -> str:
    """n / d as an integer, halves away from zero; NULL when d is 0."""
    return f"(sign({n}) * ((2 * abs({n}) + ({d})) // nullif(2 * ({d}), 0)))"


def hundredths(x: str) -> str:
    return f"(cast({x} as double) / 100)"


def pct_h(a: str, b: str) -> str:
    return half_up(f"(10000 * ({a}))", b)


def mean_h(total: str, n: str) -> str:
    """Mean of whole numbers, in hundredths."""
    return half_up(f"(100 * ({total}))", n)


def date_key(x: str) -> str:
    return f"cast(year({x}) * 10000 + month({x}) * 100 + day({x}) as integer)"


def _raw_column(c: Column) -> str:
    name = f'"{c.source}"'
    return f"cast(null as varchar) as {name}" if c.source in PII_COLUMNS else name


def _typed(spec: TableSpec) -> str:
    raw = f"raw_{spec.name}"
    key = f'"{spec.raw_key}"'
    keep = {
        "numeric": f"regexp_full_match(trim({key}), '[0-9]+') and {sql_int(key)} is not null",
        "nonblank": f"{sql_id(key)} is not null",
        "nonnull": f"{key} is not null",
    }[spec.key_rule]
    columns = ", ".join(f'{_RULES[c.rule](chr(34) + c.source + chr(34))} as "{c.target}"' for c in spec.columns)
    return f"select {columns} from {raw} where {keep}"


def _latest(spec: TableSpec) -> str:
    order = {
        "updated": ["coalesce(updated_at, timestamp '1970-01-01') desc"],
        "updated_or_created": ["coalesce(updated_at, created_at) desc nulls last"],
        "any": [],
    }[spec.dedup]
    order += [f'"{c.target}" asc nulls last' for c in spec.columns[1:]]
    return (
        f"select * from clean_{spec.name} qualify row_number() over"
        f' (partition by "{spec.key}" order by {", ".join(order)}) = 1'
    )


def _arrays(bridge: str, owner: str) -> str:
    return f"""select {owner}, list_sort(list(dt.name)) as disability_type
        from typed_{bridge} b join typed_disabilitytype dt on b.disabilitytype_id = dt.id
        where dt.name is not null and {owner} is not null group by {owner}"""


CTES: dict[str, str] = {}

_selects = source_selects(DuckDialect)
for _name, _spec in SPECS.items():
    CTES[f"source_{_name}"] = _selects[_name]
    CTES[f"raw_{_name}"] = f"select {', '.join(_raw_column(c) for c in _spec.columns)} from source_{_name}"
    CTES[f"clean_{_name}"] = _typed(_spec)
    CTES[f"typed_{_name}"] = _latest(_spec)

CTES["bounds"] = """
    select cast(least(min(appointment_date), min(created_at)) as date) as d0,
        cast(greatest(max(appointment_date), max(created_at)) as date) as d1
    from typed_appointment"""
CTES["dim_date"] = f"""
    select {date_key("d")} as date_id, cast(d as date) as calendar_date, cast(day(d) as integer) as day,
        cast(month(d) as integer) as month, cast(year(d) as integer) as year,
        cast(weekofyear(d) as integer) as week, cast(quarter(d) as integer) as quarter
    from (select unnest(generate_series(cast(d0 as timestamp), cast(d1 as timestamp), interval 1 day)) as d
        from bounds)"""
CTES["dim_report"] = """
    select distinct created_at, feedback, eval as evaluation from typed_report
    where created_at is not null or feedback is not null or eval is not null"""
CTES["clinic_state"] = """
    select c.*, coalesce(s.name, cast(c.state_id as varchar)) as state
    from typed_clinic c left join typed_address_state s on s.id = c.state_id
    where c.name is not null"""
CTES["dim_clinic"] = """
    select created_at, is_presential_clinic, is_online_clinic, name, zip_code, city, consult_price,
        duration_minutes, accepts_insurance_providers, provides_accessibility_standards,
        online_clinic_consult_price, online_clinic_duration_minutes,
        online_clinic_accepts_insurance_providers, state
    from clinic_state
    qualify row_number() over (partition by name, city, state
        order by created_at desc nulls last, clinic_id) = 1"""
CTES["professional_arrays"] = _arrays("professional_disability_types", "professional_id")
CTES["profile_arrays"] = _arrays("profile_disability_types", "profile_id")
CTES["professional_state"] = """
    select p.*, coalesce(s.name, cast(p.state_id as varchar)) as state
    from typed_professional p left join typed_address_state s on s.id = p.state_id
    where p.full_name is not null"""
CTES["dim_professional"] = """
    select p.created_at, md5(p.full_name) as full_name, p.profile_status, p.active, p.published, p.specialty,
        coalesce(eg.name, cast(p.ethnic_group as varchar)) as ethnic_group,
        coalesce(gi.name, cast(p.gender_identity as varchar)) as gender_identity,
        coalesce(pr.pronoun, cast(p.pronoun as varchar)) as pronoun,
        coalesce(so.name, cast(p.sexual_orientation as varchar)) as sexual_orientation,
        coalesce(pd.profile_type, cast(p.privacy_document_id as varchar)) as profile_type,
        coalesce(array_to_string(a.disability_type, '|'), '') as disability_type, p.state
    from (select * from professional_state qualify row_number() over
            (partition by full_name, state order by created_at desc nulls last, professional_id) = 1) p
        left join professional_arrays a on a.professional_id = p.professional_id
        left join typed_ethnicgroup eg on eg.id = p.ethnic_group
        left join typed_genderidentity gi on gi.id = p.gender_identity
        left join typed_pronoun pr on pr.id = p.pronoun
        left join typed_sexualorientation so on so.id = p.sexual_orientation
        left join typed_privacydocument pd on pd.id = p.privacy_document_id"""
CTES["user_key"] = """
    select *, md5(lower(coalesce(first_name, '') || '|' || coalesce(last_name, '') || '|'
        || coalesce(cast(birth_date as varchar), ''))) as patient_key
    from typed_user where first_name is not null or last_name is not null or birth_date is not null"""
CTES["patient_user"] = """
    select u.*, pd.profile_type from user_key u join typed_privacydocument pd on pd.id = u.privacy_document_id
    where pd.profile_type = 'Paciente'
    qualify row_number() over (partition by patient_key order by u.created_at desc nulls last, user_id) = 1"""
CTES["user_profile"] = """
    select * from typed_profile where user_id is not null
    qualify row_number() over (partition by user_id
        order by coalesce(updated_at, created_at) desc nulls last, profile_id) = 1"""
CTES["patient_arrays"] = """
    select u.patient_key, a.disability_type from patient_user u
        join user_profile p on p.user_id = u.user_id join profile_arrays a on a.profile_id = p.profile_id"""
CTES["dim_patient"] = """
    select u.patient_key, u.created_at, cast(null as varchar) as first_name, cast(null as varchar) as last_name,
        u.birth_date, u.is_active, u.profile_type,
        coalesce(eg.name, cast(p.ethnic_group as varchar)) as ethnic_group,
        coalesce(gi.name, cast(p.gender_identity as varchar)) as gender_identity,
        coalesce(pr.pronoun, cast(p.pronoun as varchar)) as pronoun,
        coalesce(so.name, cast(p.sexual_orientation as varchar)) as sexual_orientation,
        coalesce(array_to_string(a.disability_type, '|'), '') as disability_type
    from patient_user u left join user_profile p on p.user_id = u.user_id
        left join profile_arrays a on a.profile_id = p.profile_id
        left join typed_ethnicgroup eg on eg.id = p.ethnic_group
        left join typed_genderidentity gi on gi.id = p.gender_identity
        left join typed_pronoun pr on pr.id = p.pronoun
        left join typed_sexualorientation so on so.id = p.sexual_orientation"""
CTES["professional_link"] = """
    select professional_id, md5(full_name) as professional_name, state as professional_state
    from professional_state where state is not null"""
CTES["clinic_link"] = """
    select professional_id, name as clinic_name, city as clinic_city, state as clinic_state
    from clinic_state where professional_id is not null and city is not null and state is not null
    qualify row_number() over (partition by professional_id
        order by coalesce(updated_at, created_at) desc nulls last, clinic_id) = 1"""
CTES["patient_link"] = """
    select u.user_id, u.patient_key from user_key u join dim_patient d on d.patient_key = u.patient_key"""
CTES["report_link"] = """
    select nullif(trim(appointment_id), '') as appointment_id, created_at as report_created_at,
        feedback as report_feedback, eval as report_evaluation, true as has_report
    from typed_report
    where (created_at is not null or feedback is not null or eval is not null)
        and nullif(trim(appointment_id), '') is not null
    qualify row_number() over (partition by nullif(trim(appointment_id), '')
        order by created_at desc nulls last, report_id) = 1"""
CTES["latest_cancellation"] = """
    select nullif(trim(appointment_id), '') as appointment_id,
        date_trunc('second', created_at) as created_at, nullif(trim(reason), '') as reason
    from typed_cancellation where nullif(trim(appointment_id), '') is not null
    qualify row_number() over (partition by nullif(trim(appointment_id), '')
        order by coalesce(created_at, timestamp '1970-01-01') desc, cancellation_id) = 1"""
CTES["fact"] = f"""
    select md5(coalesce(a.id, '') || '|' || cast({date_key("a.appointment_date")} as varchar))
            as appointment_fingerprint,
        {date_key("a.created_at")} as created_date_id, a.status, a.type,
        {date_key("a.appointment_date")} as date_id,
        (date_diff('microsecond', a.created_at, a.appointment_date)
            - ((date_diff('microsecond', a.created_at, a.appointment_date) % 60000000) + 60000000) % 60000000)
            // 60000000 as waiting_time,
        p.professional_name, p.professional_state, u.patient_key, k.clinic_name, k.clinic_city, k.clinic_state,
        r.report_created_at, r.report_feedback, r.report_evaluation, r.has_report,
        c.created_at as cancellation_created_at, c.reason as cancellation_reason
    from typed_appointment a
        left join professional_link p on p.professional_id = a.professional_id
        left join clinic_link k on k.professional_id = a.professional_id
        left join patient_link u on u.user_id = a.user_id
        left join report_link r on r.appointment_id = a.id
        left join latest_cancellation c on c.appointment_id = a.id
    where a.appointment_date is not null"""
CTES["patient_base"] = f"""
    select cast(date_trunc('month', created_at) as date) as period_month,
        case when birth_date is null then 'N/I'
            else case when age between 18 and 25 then '18-25' when age between 26 and 35 then '26-35'
                when age between 36 and 45 then '36-45' when age between 46 and 60 then '46-60'
                else '60+' end end as age_group,
        coalesce(gender_identity, 'N/I') as gender_identity,
        coalesce(sexual_orientation, 'N/I') as sexual_orientation,
        coalesce(ethnic_group, 'N/I') as ethnic_group, coalesce(is_active, false) as is_active
    from (select *, extract(year from age(timestamp '{AS_OF}', birth_date)) as age from dim_patient)
    where created_at is not null"""
CTES["mart_groups"] = """
    select period_month, age_group, gender_identity, sexual_orientation, ethnic_group,
        count(*) as total_patients, count(*) filter (where is_active) as active_patients,
        count(*) filter (where not is_active) as inactive_patients
    from patient_base group by all"""
CTES["mart_growth"] = f"""
    select period_month, case when prev > 0 then {pct_h("total - prev", "prev")} end as growth_h
    from (select period_month, total, lag(total) over (order by period_month) as prev
        from (select period_month, cast(sum(total_patients) as bigint) as total
            from mart_groups group by period_month))"""
CTES["mart_patients"] = f"""
    select g.*, {pct_h("active_patients", "total_patients")} as active_h, w.growth_h
    from mart_groups g join mart_growth w using (period_month)"""
CTES["mart_patient_disability"] = """
    select period_month, trim(name) as disability_type, count(*) as total_patients,
        count(*) filter (where is_active) as active_patients,
        count(*) filter (where not is_active) as inactive_patients
    from (select cast(date_trunc('month', d.created_at) as date) as period_month,
            unnest(a.disability_type) as name, coalesce(d.is_active, false) as is_active
        from dim_patient d join patient_arrays a on a.patient_key = d.patient_key
        where d.created_at is not null)
    group by 1, 2"""
CTES["professional_counts"] = """
    select professional_name, professional_state,
        count(*) filter (where lower(coalesce(status, '')) = 'completed') as completed,
        count(report_evaluation) as ratings, cast(sum(report_evaluation) as bigint) as rating_sum
    from fact where professional_name is not null group by all"""
CTES["mart_professionals"] = f"""
    select p.full_name, p.sexual_orientation, p.ethnic_group, p.gender_identity, p.specialty, p.state,
        p.profile_status, p.active, coalesce(c.completed, 0) as total_appointments,
        coalesce({mean_h("c.rating_sum", "c.ratings")}, 0) as rating_h
    from dim_professional p left join professional_counts c
        on c.professional_name = p.full_name and c.professional_state = p.state"""
CTES["mart_professional_appointments"] = f"""
    select p.full_name, p.state, f.appointment_period, coalesce(p.specialty, 'Não informada') as specialty,
        f.* exclude (professional_name, professional_state, appointment_period),
        {pct_h("completed_appointments", "total_appointments")} as completion_h,
        {pct_h("cancelled_appointments_online", "total_appointments")} as cancel_online_h,
        {pct_h("cancelled_appointments_presencial", "total_appointments")} as cancel_presencial_h,
        {mean_h("waited_sum", "waited_count")} as waiting_h
    from (select professional_name, professional_state,
            make_date(date_id // 10000, date_id // 100 % 100, 1) as appointment_period,
            count(*) as total_appointments,
            count(*) filter (where lower(status) = 'completed') as completed_appointments,
            count(*) filter (where lower(status) = 'completed' and type = 'Online')
                as completed_appointments_online,
            count(*) filter (where lower(status) = 'completed' and type = 'Presencial')
                as completed_appointments_presencial,
            count(*) filter (where lower(status) = 'cancelled' and type = 'Online')
                as cancelled_appointments_online,
            count(*) filter (where lower(status) = 'cancelled' and type = 'Presencial')
                as cancelled_appointments_presencial,
            cast(sum(nullif(waiting_time, 0)) as bigint) as waited_sum,
            count(nullif(waiting_time, 0)) as waited_count, max(created_date_id) as last_created
        from fact where professional_name is not null group by 1, 2, 3) f
        join dim_professional p on p.full_name = f.professional_name and p.state = f.professional_state"""

CTES["tile_facts"] = """
    select make_date(f.date_id // 10000, f.date_id // 100 % 100, 1) as month, f.status, f.waiting_time,
        f.report_evaluation, cast(c.consult_price * 100 as bigint) as price_h,
        coalesce(p.specialty, 'Não informada') as specialty, coalesce(p.state, 'N/I') as state,
        coalesce(p.gender_identity, 'N/I') as gender_identity,
        coalesce(p.sexual_orientation, 'N/I') as sexual_orientation, coalesce(p.ethnic_group, 'N/I') as ethnic_group
    from fact f left join dim_professional p on p.full_name = f.professional_name and p.state = f.professional_state
        left join dim_clinic c on c.name = f.clinic_name and c.city = f.clinic_city and c.state = f.clinic_state"""


def with_ctes(final: str) -> str:
    """``final`` preceded by the expressions it needs, in dependency order."""
    ordered: list[str] = []

    def visit(sql: str) -> None:
        for name in re.findall(r"\b[a-z_]+\b", sql):
            if name in CTES and name not in ordered and CTES[name] is not sql:
                visit(CTES[name])
                if name not in ordered:
                    ordered.append(name)

    visit(final)
    if not ordered:
        return final
    body = ",\n".join(f"{name} as materialized ({CTES[name]})" for name in ordered)
    return f"with {body}\n{final}"
