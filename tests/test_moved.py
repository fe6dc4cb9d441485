"""What facts carry through shuffles, what is written besides, and how long shuffles stay."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from carelake.config import RefreshConfig
from carelake.operators.fact import FACT_COLUMNS
from carelake.operators.joins import link
from carelake.plans.refresh import Refresh
from carelake.schemas import SPECS
from carelake.sources.store import materialize
from verification import queries
from verification.queries import QUERIES, Layers

SMALL = "/root/testdata/sf0.001"


@pytest.fixture()
def shuffling(spark):
    """Every join shuffles both sides, and plans are as they are made."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    layers = Layers(spark, SMALL)
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield layers
    for k, v in before.items():
        spark.conf.set(k, v)


def plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def test_whole_facts_are_moved_once_for_all_lookups(shuffling):
    """they were moved to the users and to the professionals, and the lookups by appointment once more."""
    lines = plan(shuffling.fact())
    moved = [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning" in line and "ReusedExchange" not in line]
    assert sum("waiting_time" in line for line in moved) == 1
    assert not any("FullOuter" in line for line in lines)
    assert sum("ReusedExchange" in line and "id#" in line for line in lines) >= 1


def test_no_shuffle_carries_a_fingerprint_to_the_dimensions(shuffling):
    """each of four joins moved the facts with 32 letters that no shuffle can compress."""
    facts = shuffling.fact(keyed=False)
    assert facts.columns == ["appointment_id", *[c for c in FACT_COLUMNS if c not in ("id_fact_appointment", "appointment_fingerprint")]]
    lines = plan(queries._fact_with_natural_keys(shuffling))
    made = [i for i, line in enumerate(lines) if "AS appointment_fingerprint" in line]
    first = next(i for i, line in enumerate(lines) if "Exchange" in line)
    assert made and max(made) < first


def test_references_write_the_patients_alone(spark, monkeypatch):
    """five dimensions and all columns of the facts were written and read again, and made from shuffles of their own."""
    written = []
    monkeypatch.setattr(queries, "materialize", lambda df, name: written.append((name, df.columns)) or materialize(df, name))
    rows = {r.column_name: r.orphans for r in QUERIES["v3_references"](spark, SMALL).collect()}
    assert written == [("dim_patient", ["patient_key", "patient_id"])]
    assert len(rows) == 6 and set(rows.values()) == {0}


def test_marked_keys_match_no_stand_in(spark):
    left = spark.createDataFrame([(str(i), k) for i, k in enumerate([None, "7", "=7", "", "\x007", "x"] * 3)], "id string, k string")
    right = spark.createDataFrame([(str(i), i) for i in range(1024)] + [("=7", -1), ("", -2), ("\x007", -3), (None, -4)], "r string, v int")
    got = {(r.k, r.v) for r in link(left, right, "k", "r", "id").collect()}
    assert got == {(None, None), ("7", 7), ("=7", -1), ("", -2), ("\x007", -3), ("x", None)}
    assert link(left, right, "k", "r", "id").columns == ["id", "k", "v"]


def _shuffle_files(spark) -> int:
    files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_a_refresh_leaves_no_shuffle_on_the_disks(spark, tmp_path):
    """shuffles of all layers stayed until the driver's memory was cleaned."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rows = {
        "appointment": [("a1", "2020-01-01", "2020-01-02", "2020-02-03 10:00:00", "Completed", "Online", "p1", "u1", "1")],
        "report": [("r1", "2020-02-04", "", "good", "5", "a1", "12", "3")],
    }

    def load(entity: str):
        columns = SPECS[entity].raw_columns
        empty = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
        found = rows.get(entity)
        return spark.createDataFrame(found, empty.schema).repartition(2, F.col("id")) if found else empty

    before, was = _shuffle_files(spark), spark.conf.get(key)
    run = Refresh(spark, RefreshConfig(root=str(tmp_path)), load=load)
    run.run()
    until = time.time() + 20
    while _shuffle_files(spark) > before and time.time() < until:
        time.sleep(0.5)
    assert _shuffle_files(spark) <= before
    assert spark.conf.get(key) == was
    assert run.model["fact_appointments"].count() == 1
