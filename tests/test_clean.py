"""Scalar rules, one case list per rule."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from carelake import functions as fn
from carelake.functions.clean import TimeRule, to_utc
from carelake.functions.measures import date_id, pct
from carelake.operators.dimensions import dim_date


def apply(spark, rule, values):
    """``rule`` over text values, in order."""
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r.y for r in df.select("i", rule("x").alias("y")).orderBy("i").collect()]


def at(hour, minute=0):
    return dt.datetime(2020, 1, 1, hour, minute)


CASES = {
    "clean_id": (
        fn.clean_id,
        [("  7 ", "7"), ("   ", None), ("", None), ("\t7", "\t7"), (None, None)],
    ),
    "blank_to_null": (fn.blank_to_null, [("", None), (" ", " "), ("a", "a"), (None, None)]),
    "guarded_int": (
        fn.guarded_int,
        [(" 12 ", 12), ("-3", None), ("1.0", None), ("12\n", None), ("abc", None), (None, None),
         ("99999999999", None), ("007", 7), ("", None)],
    ),
    "parse_bool": (
        fn.parse_bool,
        [(" SIM ", True), ("t", True), ("1", True), ("Yes", True), ("True", True), ("NÃO", False),
         ("nao", False), ("0", False), ("N", False), ("talvez", None), ("", None), (None, None)],
    ),
    "to_utc": (
        fn.to_utc,
        [("2020-01-01T09:00:00Z", at(9)), ("2020-01-01 09:00:00-03", at(12)), ("2020-01-01", at(0)),
         (" 2020-01-01 09:30:00 ", at(9, 30)), ("2020-01-01T09:00:00+02:00", at(7)), ("junk", None),
         ("2020-01-01 09:00:00+0300", at(6)), ("", None), ("2020", None), ("2020-01", None), ("T10:00:00", None), ("2020-13-01", None), (None, None)],
    ),
    "parse_price": (
        fn.parse_price,
        [("R$ 150,50", Decimal("150.50")), ("200", Decimal("200.00")), ("1.234,56", None), ("-", None),
         ("", None), ("grátis", None), ("10.005", Decimal("10.01")), ("999999999,99", None), (None, None)],
    ),
    "parse_price_pt": (
        lambda c: fn.parse_price(c, "pt"),
        [("R$ 1.234,56", Decimal("1234.56")), ("200.50", Decimal("200.50")), ("150,5", Decimal("150.50"))],
    ),
    "map_values": (
        fn.map_values,
        [("telemed", "Online"), ("Video", "Online"), ("clinic", "Presencial"), ("x", "Outro"), (None, "Outro")],
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_rule(spark, name):
    rule, cases = CASES[name]
    assert apply(spark, rule, [c[0] for c in cases]) == [c[1] for c in cases]


def test_unknown_price_locale():
    with pytest.raises(ValueError):
        fn.parse_price("x", "de")


@pytest.mark.parametrize(
    "birth, expected",
    [("2000-02-29", "18-25"), ("1999-02-28", "26-35"), ("2010-01-01", "60+"), ("1999-03-01", "18-25"),
     ("1964-02-28 00:00:00", "60+"), ("1964-02-28 00:00:01", "46-60"), ("2030-01-01", "60+"), (None, "N/I")],
)
def test_age_bucket(spark, birth, expected):
    df = spark.createDataFrame([(birth,)], "b string").select(F.col("b").cast("timestamp_ntz").alias("b"))
    assert df.select(fn.age_bucket("b", "2025-02-28")).first()[0] == expected


def test_age_bucket_strict_minors(spark):
    df = spark.createDataFrame([("2010-01-01",)], "b string").select(F.col("b").cast("timestamp_ntz").alias("b"))
    assert df.select(fn.age_bucket("b", "2025-02-28", strict_minor_bucket=True)).first()[0] == "<18"


@pytest.mark.parametrize(
    "a, b, expected",
    [(1, 3, "33.33"), (0, 5, "0.00"), (1, 0, None), (1, 800, "0.13"), (-1, 800, "-0.13"), (2, 3, "66.67")],
)
def test_pct(spark, a, b, expected):
    got = spark.createDataFrame([(a, b)], "a bigint, b bigint").select(fn.pct("a", "b")).first()[0]
    assert got == (None if expected is None else Decimal(expected))


@pytest.mark.parametrize(
    "created, appointment, expected",
    [("2020-01-01 00:00:30", "2020-01-01 00:00:00", -1), ("2020-01-01 00:00:00", "2020-01-01 00:01:30", 1),
     ("2020-01-01", None, None), (None, "2020-01-01", None), ("2020-01-01", "2020-01-01", 0),
     ("2020-01-01 00:01:00", "2020-01-01 00:00:00", -1), ("2020-01-01 00:01:00.000001", "2020-01-01 00:00:00", -2),
     ("0001-01-01", "9999-12-31", 5258963520)],
)
def test_waiting_minutes(spark, created, appointment, expected):
    df = spark.createDataFrame([(created, appointment)], "a string, b string")
    times = df.select(F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    assert times.select(fn.waiting_minutes("a", "b")).first()[0] == expected


def test_keys_tell_null_positions_apart(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", ""), ("", "a")], "x string, y string")
    assert df.select(fn.surrogate("x", "y").alias("k")).distinct().count() == 4
    assert df.filter("x is null or y is null").select(
        fn.patient_key("x", "y", F.lit(None)).alias("k")
    ).distinct().count() == 2


def test_patient_key_salt_changes_key(spark):
    df = spark.createDataFrame([("A", "b")], "x string, y string")
    plain, salted = df.select(
        fn.patient_key("x", "y", F.lit(None)), fn.patient_key("x", "y", F.lit(None), "pepper")
    ).first()
    assert plain != salted


def test_date_keys(spark):
    df = spark.createDataFrame([("2021-01-01",)], "d string").select(F.col("d").cast("date").alias("d"))
    row = df.select(fn.date_id("d").alias("i"), fn.month_of_date_id(fn.date_id("d")).alias("m")).first()
    assert (row.i, row.m) == (20210101, dt.date(2021, 1, 1))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2020-01-01T09:00-03:00", "2020-01-01 12:00:00"),
        ("2020-01-01T09:00Z", "2020-01-01 09:00:00"),
        ("2020-01-01 09:00+03", "2020-01-01 06:00:00"),
        ("20200101", "2020-01-01 00:00:00"),
        ("20200101T093000Z", "2020-01-01 09:30:00"),
        ("2020/01/01", "2020-01-01 00:00:00"),
        ("01/02/2020", "2020-01-02 00:00:00"),
        ("31-Jan-2020 10:05 PM", "2020-01-31 22:05:00"),
        ("Jan 5, 2020", "2020-01-05 00:00:00"),
        ("2020-13-01", None),
        ("2020", None),
        ("09:00", None),
        ("2020-01-01 25:00", None),
        ("2020-02-30", None),
    ],
)
def test_times_in_other_forms(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(to_utc("t").cast("string").alias("u")).first().u
    assert got == expected


def test_times_by_a_partner_s_rule(spark):
    rule = TimeRule("dmy", "America/Sao_Paulo", "s")
    df = spark.createDataFrame([("01/02/2020",), ("2020-01-01",), ("2020-01-01T09:00Z",), ("1577836800",)], "t string")
    got = [r.u for r in df.select(to_utc("t", rule).cast("string").alias("u")).collect()]
    assert got == ["2020-02-01 03:00:00", "2020-01-01 03:00:00", "2020-01-01 09:00:00", "2020-01-01 00:00:00"]


def test_far_off_dates_end_no_run(spark):
    df = spark.createDataFrame([("250000-01-01",), ("99999-01-01",), ("2020-01-01",)], "t string").select(to_utc("t").alias("t"))
    assert sorted((r.i for r in df.select(date_id("t").alias("i")).collect()), key=lambda x: x or 0) == [None, 20200101, 999990101]
    days = dim_date(df.filter("t < timestamp '2100-01-01'").select(F.col("t").alias("appointment_date"), F.lit("2400-01-01").cast("timestamp_ntz").alias("created_at")))
    assert days.count() == 138793
    assert spark.range(1).select(pct(F.col("id") + 9223372036854775807, F.col("id") + 1).alias("p")).first().p is not None


def test_texts_without_a_digit_are_no_times_and_cost_no_patterns(spark):
    df = spark.createDataFrame([(t,) for t in ("", "  ", "junk", "Jan", "May, PM", "Z", "-", None)], "t string").select("t", to_utc("t").alias("u"))
    assert [r.u for r in df.collect()] == [None] * 8
    assert "RLIKE(trim(t" in (plan := df._jdf.queryExecution().optimizedPlan().toString()) and ", [0-9])" in plan
