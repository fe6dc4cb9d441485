"""Deduplication, upsert, links, typed tables, dimensions, fact and marts on small fixtures."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from carelake.operators import checks, dimensions, marts
from carelake.operators.dedup import any_per_key, latest_cancellation, latest_per_key, newest, newest_touched
from carelake.operators.fact import fact_appointments, fact_rejects
from carelake.operators.joins import link, measured_bytes
from carelake.operators.typed import build_typed, rejected_values
from carelake.operators.upsert import insert_new, upsert, upsert_metrics
from carelake.schemas import SPECS
from carelake.sources import readers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def timed(spark, data):
    df = spark.createDataFrame(data, "k int, updated_at string, created_at string, v string")
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("updated_at", "created_at")})


def test_latest_per_key_null_time_is_epoch(spark):
    df = timed(spark, [(1, None, "2022-01-01", "a"), (1, "2020-01-01", None, "b"), (1, "2021-01-01", None, "c")])
    assert latest_per_key(df, ["k"], [newest()]).first().v == "c"
    before_epoch = timed(spark, [(1, None, None, "null"), (1, "1960-01-01", None, "old")])
    assert latest_per_key(before_epoch, ["k"], [newest()]).first().v == "null"


def test_latest_per_key_all_null_uses_tiebreak_or_creation(spark):
    df = timed(spark, [(1, None, "2021-01-01", "b"), (1, None, "2020-01-01", "a"), (1, None, None, "c")])
    assert latest_per_key(df, ["k"], [newest()]).first().v == "a"
    assert latest_per_key(df, ["k"], [newest_touched()]).first().v == "b"


def test_any_per_key_is_deterministic(spark):
    data = [(i % 3, None, None, str(i)) for i in range(30)]
    want = rows(any_per_key(timed(spark, data), ["k"]).select("k", "v"))
    assert want == rows(any_per_key(timed(spark, data[::-1]).repartition(7), ["k"]).select("k", "v"))


def test_latest_cancellation(spark):
    df = spark.createDataFrame(
        [("c1", " 7", "2020-01-01 10:00:00.9", "old"), ("c2", "7 ", "2020-01-02 10:00:00.9", " new "),
         ("c3", " ", "2020-01-01", "x"), ("c4", None, "2020-01-01", "x"), ("c5", "8", None, " ")],
        "cancellation_id string, appointment_id string, created_at string, reason string",
    ).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    got = {r.appointment_id: (r.created_at, r.reason) for r in latest_cancellation(df).collect()}
    assert got == {"7": (dt.datetime(2020, 1, 2, 10), "new"), "8": (None, None)}


def test_partial_limit_before_the_shuffle(spark):
    plan = latest_per_key(timed(spark, [(1, None, None, "a")]), ["k"], [newest()])._jdf.queryExecution().toString()
    physical = plan[plan.index("Physical Plan"):]
    assert physical.count("WindowGroupLimit") == 2


# --- upsert ------------------------------------------------------------------


@pytest.fixture(scope="module")
def versions(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k int, v string, w string")
    src = spark.createDataFrame([(2, None, "y"), (3, "c", "z")], "k int, v string, w string")
    return target, src


def test_upsert_replaces_rows(versions):
    got = {r.k: (r.v, r.w) for r in upsert(*versions, ["k"]).collect()}
    assert got == {1: ("a", "x"), 2: (None, "y"), 3: ("c", "z")}


def test_upsert_of_some_columns(versions):
    got = {r.k: (r.v, r.w) for r in upsert(*versions, ["k"], update_cols=["w"]).collect()}
    assert got == {1: ("a", "x"), 2: ("b", "y"), 3: ("c", "z")}


def test_insert_new_keeps_existing(versions):
    got = {r.k: r.v for r in insert_new(*versions, ["k"]).collect()}
    assert got == {1: "a", 2: "b", 3: "c"}


def test_upsert_metrics(versions):
    assert tuple(upsert_metrics(*versions, ["k"]).first()) == (2, 1, 1)
    assert tuple(upsert_metrics(None, versions[1], ["k"]).first()) == (2, 2, 0)


# --- links -----------------------------------------------------------------------


@pytest.mark.parametrize("measure, limit", [(False, 0), (True, 0), (True, 1 << 20)])
def test_link_equals_left_join(spark, measure, limit):
    left = spark.createDataFrame(
        [(i, None if i % 3 else ("hot" if i % 2 else f"k{i}")) for i in range(300)], "id int, fk string"
    )
    right = spark.createDataFrame([("hot", 1), ("k6", 2), ("\x0012", 3), (None, 4)], "pk string, x int")
    got = {r.id: r.x for r in link(left, right, "fk", "pk", "id", measure, limit).collect()}
    want = {r.id: {"hot": 1, "k6": 2}.get(r.fk) for r in left.collect()}
    assert got == want


def test_measured_bytes_counts_text(spark):
    df = spark.createDataFrame([("a" * 100, 1), (None, 2)], "s string, n int")
    assert measured_bytes(df) == 100 + 4 * 16


def test_hot_key_is_split_at_run_time(spark):
    """A third of all rows on one key: AQE splits that partition in the shuffled link."""
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        left = spark.range(0, 60000, 1, 8).select(
            F.col("id"),
            F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(
                F.col("id").cast("string")
            ).alias("fk"),
            F.sha2(F.col("id").cast("string"), 256).alias("payload"),
        )
        right = spark.range(0, 60000, 1, 4).select(F.col("id").cast("string").alias("pk"), F.col("id").alias("x"))
        right = right.unionByName(spark.createDataFrame([("hot", -1)], "pk string, x bigint"))
        joined = link(left, right, "fk", "pk", "id")
        counts = joined.agg(
            F.count(F.lit(1)), F.count_if(F.col("x") == -1), F.count_if(F.col("x").isNull()), F.max("payload")
        )
        assert tuple(counts.collect()[0])[:3] == (60000, 20000, 20000)
        assert "SortMergeJoin(skew=true)" in counts._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_null_keys_are_spread(spark):
    left = spark.range(0, 20000, 1, 4).select("id", F.lit(None).cast("string").alias("fk"))
    right = spark.createDataFrame([("a", 1)], "pk string, x int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        per_task = link(left, right, "fk", "pk", "id").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [r["count"] for r in per_task]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)


# --- typed -------------------------------------------------------------------------


def raw(spark, entity, *records):
    spec = SPECS[entity]
    return spark.createDataFrame([tuple(r.get(c) for c in spec.raw_columns) for r in records], spec.raw_schema)


def test_typed_appointment(spark):
    df = build_typed(
        raw(
            spark,
            "appointment",
            {"id": " 7 ", "date": "2020-01-01T09:00:00-03:00", "updated_at": "2020-01-02", "status": "old"},
            {"id": "7", "date": "2020-01-01 12:00", "updated_at": "2020-01-03", "status": "new", "user_id": " u "},
            {"id": "  ", "status": "blank"},
            {"id": None, "status": "null"},
        ),
        SPECS["appointment"],
    )
    got = {r.id: (r.status, r.user_id, r.appointment_date) for r in df.collect()}
    assert got == {"7": ("new", " u ", dt.datetime(2020, 1, 1, 12)), "": ("blank", None, None)}


@pytest.mark.parametrize("entity", SPECS)
def test_random_dirty_rows(spark, entity):
    """One row per key, no ineligible key, declared types; a second order of rows agrees."""
    rng, spec = random.Random(7), SPECS[entity]
    pool = ["1", " 1", "2 ", "3", "", " ", None, "x", "99999999999", "2020-01-01", "sim", "R$ 1,5", "-1", "2021-05-05T00:00:00Z"]
    data = [tuple(rng.choice(pool) for _ in spec.columns) for _ in range(200)]
    df = build_typed(spark.createDataFrame(data, spec.raw_schema), spec)
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in spec.typed_schema]
    got = df.collect()
    keys = [r[spec.key] for r in got]
    assert len(set(keys)) == len(keys) and None not in keys
    if spec.key_rule == "numeric":
        assert set(keys) <= {1, 2, 3}
    if spec.key_rule == "nonblank":
        assert "" not in keys
    again = build_typed(spark.createDataFrame(data[::-1], spec.raw_schema).repartition(5), spec)
    assert sorted(map(repr, got)) == sorted(map(repr, again.collect()))


def test_rejected_values(spark):
    df = raw(spark, "report", {"id": "1", "eval": "n/a", "created_at": "junk"}, {"id": "2", "eval": "5"})
    got = {r.column_name: r.rejected for r in rejected_values(df, SPECS["report"]).collect()}
    assert got == {"created_at": 1, "updated_at": 0, "eval": 1, "created_by_content_type_id": 0}


# --- sources --------------------------------------------------------------------------


def test_to_text(spark):
    df = spark.sql(
        "select timestamp_ntz'2020-01-01 09:00:00' as a, timestamp_ntz'2020-01-01 09:00:00.5' as b,"
        " timestamp'2020-01-01 09:00:00' as c, date'2020-01-01' as d, true as e, cast(null as int) as f, 1.50 as g"
    )
    assert tuple(readers.to_text(df).first()) == (
        "2020-01-01T09:00:00", "2020-01-01T09:00:00.500000", "2020-01-01T09:00:00+00:00", "2020-01-01", "True",
        None, "1.50",
    )


def test_align_and_pii(spark):
    df = spark.createDataFrame([("a@b.c", "x", "extra")], "email string, id string, other string")
    got = readers.null_pii(readers.align(df, ["id", "name", "email"])).first()
    assert got.asDict() == {"id": "x", "name": None, "email": None}


def test_seed_only_when_empty(spark):
    empty = readers.empty_df(spark, "id string, status string")
    assert readers.seed_if_empty(empty, {"id": "1"}).collect() == [("1", None)]
    full = spark.createDataFrame([("9", "s")], "id string, status string")
    assert readers.seed_if_empty(full, {"id": "1"}).collect() == [("9", "s")]


# --- dimensions, fact, marts -----------------------------------------------------------


def typed(spark, **records):
    """Typed tables from raw records; tables not named are empty."""
    return {e: build_typed(raw(spark, e, *records.get(e, [])), SPECS[e]) for e in SPECS}


@pytest.fixture(scope="module")
def clinic_world(spark):
    return typed(
        spark,
        address_state=[{"id": "1", "name": "SP"}, {"id": "2", "name": ""}],
        privacydocument=[{"id": "1", "profile_type": "Paciente"}, {"id": "2", "profile_type": "Profissional"}],
        disabilitytype=[{"id": "1", "name": "B"}, {"id": "2", "name": ""}, {"id": "3", "name": "A"}],
        professional=[
            {"id": "10", "full_name": "Ana", "state_id": "1", "specialty": "Psi", "created_at": "2019-01-01"},
            {"id": "11", "full_name": "Bia", "state_id": "2"},
            {"id": "12", "full_name": "Caio"},
        ],
        clinic=[
            {"id": "k1", "name": "C1", "city": "X", "state_id": "1", "professional_id": "10", "updated_at": "2020-01-01"},
            {"id": "k2", "name": "C2", "city": "X", "state_id": "1", "professional_id": "10", "updated_at": "2021-01-01",
             "consult_price": "100,00"},
            {"id": "k3", "name": "C3", "city": "Y", "state_id": "2", "professional_id": "11"},
        ],
        user=[
            {"id": "u1", "first_name": "Zoe", "birth_date": "2000-02-29", "privacy_document_id": "1",
             "created_at": "2020-01-15", "is_active": "sim"},
            {"id": "u2", "first_name": "ZOE", "birth_date": "2000-02-29", "privacy_document_id": "1",
             "created_at": "2020-03-15", "is_active": "não"},
            {"id": "u3", "first_name": "Zoe", "birth_date": "2000-02-29", "privacy_document_id": "2"},
            {"id": "u4", "last_name": "Zoe", "privacy_document_id": "1", "created_at": "2020-03-01"},
            {"id": "u5", "privacy_document_id": "1"},
        ],
        profile=[{"id": "p1", "user_id": "u2"}, {"id": "p2", "user_id": "u4"}],
        profile_disability_types=[
            {"id": "1", "profile_id": "p1", "disabilitytype_id": "1"},
            {"id": "2", "profile_id": "p1", "disabilitytype_id": "2"},
            {"id": "3", "profile_id": "p1", "disabilitytype_id": "3"},
            {"id": "4", "profile_id": "p1", "disabilitytype_id": "1"},
        ],
        report=[
            {"id": "r1", "appointment_id": "1", "eval": "5", "created_at": "2020-02-01"},
            {"id": "r2", "appointment_id": " 1 ", "eval": "3", "created_at": "2020-02-02"},
            {"id": "r3", "appointment_id": "2", "eval": "4"},
        ],
        cancellation=[{"id": "c1", "appointment_id": "2", "reason": " sick ", "created_at": "2020-01-09 10:00:00.7"}],
        appointment=[
            {"id": " 1", "date": "2020-01-10 09:00:00", "created_at": "2020-01-01", "status": "Completed",
             "type": "Online", "professional_id": "10", "user_id": "u1"},
            {"id": "2", "date": "2020-01-11", "created_at": "2020-01-11", "status": "cancelled",
             "type": "Presencial", "professional_id": "10", "user_id": "u3"},
            {"id": "3", "date": "2020-01-12", "status": "scheduled", "professional_id": "12", "user_id": "u4"},
            {"id": "4", "date": "junk", "status": "completed"},
            {"id": "5", "date": "2020-02-12", "status": "scheduled", "professional_id": "11"},
        ],
    )


@pytest.fixture(scope="module")
def dims(clinic_world):
    t = clinic_world
    return {
        "dim_date": dimensions.dim_date(t["appointment"]),
        "dim_report": dimensions.dim_report(t["report"]),
        "dim_clinic": dimensions.dim_clinic(t["clinic"], t["address_state"]),
        "dim_professional": dimensions.dim_professional(t["professional"], t),
        "dim_patient": dimensions.dim_patient(t["user"], t["profile"], t),
    }


@pytest.fixture(scope="module")
def fact(clinic_world, dims):
    return fact_appointments(clinic_world, dims).cache()


def test_dim_date(dims):
    dates = {r.date_id: r for r in dims["dim_date"].collect()}
    assert min(dates) == 20200101 and max(dates) == 20200212 and len(dates) == 43
    assert (dates[20200101].week, dates[20200101].quarter) == (1, 1)


def test_dim_date_grows_both_ways(spark, clinic_world):
    middle = dimensions.dim_date(clinic_world["appointment"].filter("id = '2'"))
    assert middle.count() == 1
    assert dimensions.dim_date(clinic_world["appointment"], middle).count() == 43


def test_dim_clinic_state_falls_back_to_id(dims):
    got = {(r.name, r.state) for r in dims["dim_clinic"].collect()}
    assert got == {("C1", "SP"), ("C2", "SP"), ("C3", "2")}


def test_dim_patient(dims):
    got = {tuple(r.disability_type): r for r in dims["dim_patient"].collect()}
    assert set(got) == {("A", "B", "B"), ()}
    zoe = got["A", "B", "B"]
    # u1 and u2 share a key; the later created one counts.  u3 is no patient, u5 has no natural field.
    assert zoe.created_at == dt.datetime(2020, 3, 15) and zoe.is_active is False
    assert zoe.first_name is None and zoe.last_name is None


def test_names_are_not_stored(dims):
    assert "Ana" not in {r.full_name for r in dims["dim_professional"].collect()}
    assert checks.check_pii(dims["dim_patient"], ["first_name", "last_name"]).isEmpty()


def test_fact_links(spark, fact, dims, clinic_world):
    assert fact.count() == 4
    assert [r.id for r in fact_rejects(clinic_world["appointment"]).collect()] == ["4"]
    named = (
        fact.join(dims["dim_professional"].select("professional_id", "specialty", "state"), "professional_id", "left")
        .join(dims["dim_clinic"].select("clinic_id", "name"), "clinic_id", "left")
        .join(dims["dim_report"].select("report_id", "evaluation"), "report_id", "left")
        .join(dims["dim_patient"].select("patient_id", "patient_key"), "patient_id", "left")
    )
    got = {
        (r.date_id, r.status): (r.specialty, r.state, r.name, r.evaluation, r.patient_key is not None, r.waiting_time)
        for r in named.collect()
    }
    assert got == {
        # Latest of two clinics and of two reports; one row.
        (20200110, "Completed"): ("Psi", "SP", "C2", 3, True, 13500),
        # u3 is no patient itself, but shares the patient's key.
        (20200111, "cancelled"): ("Psi", "SP", "C2", 4, True, 0),
        # A professional without state has no key.
        (20200112, "scheduled"): (None, None, None, None, True, None),
        (20200212, "scheduled"): (None, "2", "C3", None, False, None),
    }


def test_fact_cancellation(fact):
    row = fact.filter("status = 'cancelled'").first()
    assert (row.cancellation_reason, row.cancellation_created_at) == ("sick", dt.datetime(2020, 1, 9, 10))


def test_a_fact_is_planned_without_a_run(spark, clinic_world):
    spark.sparkContext.setJobGroup("planned-fact", "")
    try:
        planned = fact_appointments(clinic_world, None, ["professional_id", "clinic_id", "date_id"])
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planned-fact")
        assert planned.where(F.col("professional_id").isNotNull()).count() > 0
        assert spark.sparkContext.statusTracker().getJobIdsForGroup("planned-fact")
    finally:
        for key in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(key, None)


def test_fact_of_some_columns_equals_whole(fact, clinic_world, dims):
    some = fact_appointments(clinic_world, dims, ["appointment_fingerprint", "patient_id"])
    assert rows(some) == rows(fact.select(*some.columns))


def test_mart_professional_appointments(fact, dims):
    got = {(r.specialty, r.appointment_period): r for r in marts.mart_professional_appointments(dims["dim_professional"], fact).collect()}
    row = got["Psi", dt.date(2020, 1, 1)]
    assert (row.total_appointments, row.completed_appointments, row.cancelled_appointments_presencial) == (2, 1, 1)
    assert (row.completion_rate, row.cancellation_rate_online) == (Decimal("50.00"), Decimal("0.00"))
    # Zero waiting is left out of the mean.
    assert row.avg_waiting_time == Decimal("13500.00")
    assert row.created_at == dt.date(2020, 1, 11)
    assert got["Não informada", dt.date(2020, 2, 1)].avg_waiting_time is None


def test_mart_professionals(fact, dims):
    got = {r.state: (r.total_appointments, r.avg_feedback_rating) for r in
           marts.mart_professionals(dims["dim_professional"], fact, dims["dim_report"]).collect()}
    assert got == {"SP": (1, Decimal("3.50")), "2": (0, Decimal("0.00")), None: (0, Decimal("0.00"))}


def test_mart_patient_disability(dims):
    got = {r.disability_type: r.total_patients for r in marts.mart_patient_disability(dims["dim_patient"]).collect()}
    assert got == {"A": 1, "B": 2}


def test_growth_uses_the_previous_present_month(spark):
    monthly = spark.createDataFrame([(dt.date(2020, 1, 1), 10), (dt.date(2020, 3, 1), 15)], "m date, n bigint")
    got = {r.m.month: r.growth_rate for r in marts.month_growth(monthly, "m", "n").collect()}
    assert got == {1: None, 3: Decimal("50.00")}


def test_mart_patients_shares_one_shuffle(dims):
    df = marts.mart_patients(dims["dim_patient"], "2025-02-28")
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_checks_pass_on_a_good_fact(fact, dims):
    assert checks.check_duplicate_fingerprints(fact).isEmpty()
    assert checks.check_references(fact, dims).isEmpty()
    mart = marts.mart_professional_appointments(dims["dim_professional"], fact)
    assert checks.check_completed_totals(mart, fact).isEmpty()


def test_checks_find_violations(spark, fact, dims):
    assert checks.check_duplicate_fingerprints(fact.unionByName(fact)).count() == 4
    orphaned = fact.withColumn("clinic_id", F.lit(1).cast("bigint"))
    assert [r.column_name for r in checks.check_references(orphaned, dims).collect()] == ["clinic_id"]
    assert checks.deduplicate_facts(fact.unionByName(fact)).count() == 4
    leak = spark.createDataFrame([("x", None)], "email string, phone string")
    assert rows(checks.check_pii(leak, ["email", "phone"])) == [("email", 1)]
    collided = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k bigint, n string")
    assert rows(checks.check_surrogate_collisions(collided, "k", ["n"])) == [(1, 2)]


def test_hot_owner_is_counted_before_it_is_collected(spark):
    bridge = spark.range(0, 30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("owner"),
        (F.col("id") % 2 + 1).cast("int").alias("disabilitytype_id"),
    )
    types = spark.createDataFrame([(1, "b"), (2, "a")], "id int, name string")
    got = dimensions.disability_arrays(bridge, "owner", types).filter("owner = 'hot'").first().disability_type
    assert got == ["a"] * 5000 + ["b"] * 5000
