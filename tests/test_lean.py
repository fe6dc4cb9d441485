"""A typed table with fewer columns has the rows of the whole one, ties included."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from carelake.operators.fact import fact_appointments, fact_reads
from carelake.operators.typed import build_typed, deciding
from carelake.schemas import SPECS

TIMES = [None, "", "2020-01-01", "2020-01-02T10:00:00Z"]


def raw(spark, name, varied):
    """Every mix of a few values per varied column under each of three keys, whole rows repeated."""
    spec = SPECS[name]
    rows = []
    for i, mix in enumerate(itertools.product(*varied.values())):
        row = dict.fromkeys(spec.raw_columns) | dict(zip(varied, mix, strict=True))
        rows += [tuple((row | {spec.raw_key: f"{i % 3}"})[c] for c in spec.raw_columns)] * (1 + i % 2)
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in spec.raw_columns)).repartition(4)


VARIED = {
    "appointment": {"created_at": TIMES, "updated_at": TIMES[1:], "date": TIMES[1:], "status": ["a", None], "type": ["x", "y"], "user_id": ["2", None]},
    "report": {"created_at": TIMES, "updated_at": TIMES[1:], "eval": ["1", "n/a"], "feedback": ["b", ""], "appointment_id": ["7", None]},
    "cancellation": {"created_at": TIMES, "updated_at": TIMES[1:], "reason": ["b", ""], "appointment_id": ["7", "8"], "created_by_object_d": ["1", None]},
}


@pytest.mark.parametrize("name", VARIED)
def test_each_choice_of_columns_has_the_values_of_the_whole_table(spark, name):
    spec, df = SPECS[name], raw(spark, name, VARIED[name]).cache()
    whole = build_typed(df, spec).cache()
    for wanted in (fact_reads()[name] if name in fact_reads() else [], [spec.key, "created_at"], [spec.columns[-1].target]):
        lean = build_typed(df, spec, columns=wanted)
        rows = lambda d: sorted(map(str, d.select(spec.key, *wanted).collect()))  # noqa: B023, E731
        assert rows(lean) == rows(whole)


def test_what_decides_nothing_is_not_sorted(spark):
    assert [c.target for c in deciding(SPECS["appointment"], ["status"])] == ["id", "created_at", "updated_at", "appointment_date", "status"]
    plan = build_typed(raw(spark, "appointment", VARIED["appointment"]), SPECS["appointment"], columns=["status"])._jdf.queryExecution().toString()
    assert "user_id" not in plan.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].split("LogicalRDD")[0].split("Window")[1]
    with pytest.raises(ValueError, match="not columns"):
        deciding(SPECS["appointment"], ["nothing"])


def test_a_fact_needs_no_more_than_it_reads(spark):
    df = raw(spark, "appointment", VARIED["appointment"])
    columns = ("appointment_fingerprint", "date_id", "status")
    lean = {"appointment": build_typed(df, SPECS["appointment"], columns=fact_reads(columns)["appointment"])}
    whole = {"appointment": build_typed(df, SPECS["appointment"])}
    assert lean["appointment"].columns == ["id", "created_at", "updated_at", "appointment_date", "status"]
    got, expected = (fact_appointments(t, None, columns) for t in (lean, whole))
    assert got.exceptAll(expected).count() == expected.exceptAll(got).count() == 0 < got.where(F.col("date_id").isNotNull()).count()
