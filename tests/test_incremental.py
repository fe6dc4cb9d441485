"""Reruns that touch only what has changed, against full loads."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from carelake.config import RefreshConfig, SourceConfig
from carelake.operators import checks, marts
from carelake.operators.upsert import INSERTED, REMOVED, UPDATED, apply_changes, changes, merge
from carelake.functions import surrogate
from carelake.plans import refresh
from carelake.plans.refresh import Refresh, RefreshFailed
from carelake.schemas import SPECS
from carelake.sources.readers import read_source
from carelake.sources.store import PART, ROW, LayerStore, TableVersion, month_of
from verification.oracle import AS_OF
from verification.standin import DriverTables, source_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("source")
    tables = DriverTables(spark, SF)
    for entity in SPECS:
        source_table(tables, entity).write.parquet(f"{root}/{entity}")
    return SourceConfig(format="parquet", path=str(root))


def changed_load(spark, source):
    """Some appointments end otherwise, one moves, one loses its date, one is new; a patient and a report change."""

    def load(entity):
        df = read_source(spark, source, entity)
        if entity == "appointment":
            key = F.trim("id")
            first = read_source(spark, source, "appointment").filter("date like '1997-0%'").select(F.min(F.trim("id"))).first()[0]
            last = read_source(spark, source, "appointment").filter("date like '1997-0%'").select(F.max(F.trim("id"))).first()[0]
            status = F.when(F.col("date").contains("1996-03"), F.lit("completed")).otherwise(F.col("status"))
            date = F.when(key == first, F.lit("2011-11-11")).when(key == last, F.lit("")).otherwise(F.col("date"))
            extra = df.limit(1).withColumns({"id": F.lit("brand-new"), "date": F.lit("2001-01-01")})
            return df.withColumns({"status": status, "date": date}).unionByName(extra)
        if entity == "user":
            return df.withColumn("is_active", F.when(F.trim("id") == "7", F.lit("nao")).otherwise(F.col("is_active")))
        if entity == "report":
            return df.withColumn("eval", F.when(F.col("appointment_id").like("1-%"), F.lit("5")).otherwise(F.col("eval")))
        return df

    return load


@pytest.fixture(scope="module")
def stores(spark, source, tmp_path_factory):
    """A load and a rerun with changes in one place; the changed source loaded afresh in another."""
    changed = changed_load(spark, source)
    one, other = (str(tmp_path_factory.mktemp(n)) for n in ("rerun", "fresh"))
    first = Refresh(spark, RefreshConfig(root=one, source=source, as_of=AS_OF))
    first.run()
    second = Refresh(spark, RefreshConfig(root=one, source=source, as_of=AS_OF), load=changed)
    second.run()
    fresh = Refresh(spark, RefreshConfig(root=other, source=source, as_of=AS_OF), load=changed)
    fresh.run()
    return first, second, fresh


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    b = b.select(a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_a_rerun_equals_a_full_load(stores):
    _, second, fresh = stores
    for layer, name in fresh.versions:
        if (layer, name) in {("model", "dim_report"), ("model", "dim_clinic"), ("model", "dim_professional"), ("model", "dim_date")}:
            continue  # dimensions keep what they have known
        assert same(second.store.read_published(layer, name), fresh.store.read_published(layer, name)), (layer, name)


def test_only_touched_parts_are_written(stores):
    first, second, _ = stores
    for name in ("clinic", "profile", "professional", "cancellation"):
        assert second.versions["typed", name].parts == first.versions["typed", name].parts
    before, after = first.versions["typed", "appointment"].parts, second.versions["typed", "appointment"].parts
    written = {p for p, path in after.items() if before.get(p) != path}
    assert {"1996-03", "2001-01", "2011-11", "none"} <= written and len(written) <= 8 and len(after) > 60
    assert second.versions["model", "fact_appointments"].parts["1995-05"] == first.versions["model", "fact_appointments"].parts["1995-05"]


def test_counts_and_feed_hold_changed_rows_alone(spark, stores):
    first, second, _ = stores
    old, new = (r.store.read(r.versions["typed", "appointment"]) for r in (first, second))
    differ = new.exceptAll(old).join(old.select("id"), "id", "left_semi").count()
    got = {(r.layer, r.table_name): r for r in second.results}["typed", "appointment"]
    assert (got.inserted, got.updated, got.removed) == (1, differ, 0) and 0 < differ < got.eligible / 10
    assert got.inserted + got.updated + got.unchanged == got.eligible
    feed = second.store.read_feed("typed", "appointment").groupBy("_op").count().collect()
    assert {r["_op"]: r["count"] for r in feed} == {INSERTED: 1, UPDATED: differ}
    assert second.store.read_feed("typed", "clinic") is None


def test_a_moved_appointment_counts_once(spark, source, stores, tmp_path):
    first, second, fresh = stores
    fact = {(r.layer, r.table_name): r for r in second.results}["model", "fact_appointments"]
    assert fact.removed == 2 and fact.table_rows == fresh.versions["model", "fact_appointments"].stats["rows"]
    gone = second.store.read_feed("model", "fact_appointments").filter(F.col("_op") == REMOVED)
    now = second.store.read_published("model", "fact_appointments")
    assert gone.count() == 2 and gone.join(now, "appointment_fingerprint", "left_semi").isEmpty()
    # The source system keeps both.
    cfg = RefreshConfig(root=str(tmp_path), source=source, as_of=AS_OF, keep_superseded=True)
    Refresh(spark, cfg).run()
    kept = Refresh(spark, cfg, load=changed_load(spark, source))
    kept.run()
    assert kept.versions["model", "fact_appointments"].stats["rows"] == fact.table_rows + 2


@pytest.mark.parametrize("seed", range(3))
def test_parts_and_feed_give_what_a_full_merge_gives(spark, seed):
    rng = random.Random(seed)
    keys = [(rng.choice(["a", "b", None]), i) for i in range(60)]

    def rows(n):
        return [(*k, dt.datetime(2020, rng.randint(1, 6), 1) if rng.random() < 0.9 else None, rng.choice([None, "x", "y"])) for k in rng.sample(keys, n)]

    ddl = "k string, i int, t timestamp_ntz, v string"
    old, src = spark.createDataFrame(rows(40), ddl), spark.createDataFrame(rows(30), ddl)

    def hashed(df):
        return df.withColumn(ROW, surrogate(*df.columns)).withColumn(PART, month_of(F.col("t")))

    for only_new in (False, True):
        feed = changes(hashed(old).select("k", "i", ROW, PART), hashed(src), ["k", "i"], only_new).filter("_op is not null").persist()
        touched = {p for r in feed.select(PART, "_old_part").collect() for p in r if p}
        part = month_of(F.col("t"))
        new = apply_changes(hashed(old).drop(PART).filter(part.isin(*touched)), feed, ["k", "i"]).drop(ROW)
        merged = new.unionByName(old.filter(~part.isin(*touched)))
        assert same(merged, merge(old, src, ["k", "i"], only_new).drop("_in_src", "_in_target"))
        feed.unpersist()
    whole = changes(hashed(old).select("k", "i", ROW, PART), hashed(src), ["k", "i"], removing=True).filter("_op is not null")
    assert same(apply_changes(hashed(old).drop(PART), whole, ["k", "i"]).drop(ROW), src)


class _FailsInMarts(Refresh):
    def load_marts(self, model):
        self.load_states(model)
        raise ValueError("marts failed")


class _CountsBuilds(Refresh):
    built: list

    def _merge(self, build, layer, name, *args, **kwargs):
        def noted():
            self.built.append((layer, name))
            return build()

        return super()._merge(noted, layer, name, *args, **kwargs)


def test_a_failed_run_is_resumed(spark, source, tmp_path):
    cfg = RefreshConfig(root=str(tmp_path), source=source, as_of=AS_OF)
    failed = _FailsInMarts(spark, cfg)
    with pytest.raises(ValueError, match="marts failed"):
        failed.run()
    assert LayerStore(spark, str(tmp_path)).published("typed", "appointment") is None
    # Half a table: files, but no note of it.
    stray = tmp_path / "typed" / "appointment" / "run=half"
    source_table(DriverTables(spark, SF), "appointment").write.parquet(str(stray))
    resumed = _CountsBuilds(spark, cfg)
    resumed.built = []
    resumed.run()
    assert resumed.built == []
    for key in failed.versions:
        assert resumed.versions[key].parts == failed.versions[key].parts, key
    results = {(r.layer, r.table_name): r for r in resumed.results}
    assert results["typed", "user"].inserted == results["typed", "user"].table_rows > 0
    assert not (tmp_path / "journal").exists() or not list((tmp_path / "journal").rglob("*.json"))
    # A change of the source after a failure is seen.
    again = _FailsInMarts(spark, cfg, load=changed_load(spark, source))
    with pytest.raises(ValueError):
        again.run()
    last = _CountsBuilds(spark, cfg)
    last.built = []
    last.run()
    assert same(last.store.read_published("typed", "appointment"), failed.store.read(failed.versions["typed", "appointment"]))


def test_other_rules_are_not_taken_over(spark, source, tmp_path):
    Refresh(spark, RefreshConfig(root=str(tmp_path), source=source, as_of=AS_OF)).run()
    other = Refresh(spark, RefreshConfig(root=str(tmp_path), source=source, as_of="2030-01-01"))
    other.run()
    direct = marts.mart_patients(other.model["dim_patient"], "2030-01-01")
    assert same(other.store.read_published("mart", "patients"), direct.select(other.marts["patients"].columns))


def test_checksums_are_free_of_order_and_see_every_change(spark):
    df = spark.createDataFrame([("a", None, "p"), (None, "a", "p"), ("a", "b", "q"), ("a", "b", "q")], f"x string, y string, {PART} string")
    base = refresh._checksums(df)
    assert refresh._checksums(df.orderBy(F.desc("x")).repartition(3)) == base and set(base) == {"p", "q"}
    for other in (df.limit(3), df.withColumn("x", F.coalesce("x", F.lit("a"))), df.withColumn("y", F.when(F.col("y") == "b", "c").otherwise(F.col("y")))):
        assert refresh._checksums(other) != base
    swapped = spark.createDataFrame([("a", None, "p"), ("a", None, "p"), ("a", "b", "q"), ("a", "b", "q")], df.schema)
    assert refresh._checksums(swapped)["p"] != base["p"]


def test_planted_faults_are_named(spark, stores):
    _, second, _ = stores
    model = {n: second.store.read_published("model", n) for n in ("dim_patient", "dim_professional")}
    assert checks.check_model_pii(model).isEmpty()
    named = model["dim_patient"].withColumn("first_name", F.when(F.col("patient_id") == model["dim_patient"].first()["patient_id"], "Ana"))
    plain = model["dim_professional"].withColumn("full_name", F.lit("Dr 5"))
    got = {(r.table_name, r.column_name): r.filled for r in checks.check_model_pii({"dim_patient": named, "dim_professional": plain}).collect()}
    assert got == {("dim_patient", "first_name"): 1, ("dim_professional", "full_name"): plain.count()}
    mart, fact = second.store.read_published("mart", "professional_appointments"), second.store.read_published("model", "fact_appointments")
    assert checks.check_completed_by_month(mart, fact).isEmpty()
    month = dt.date(1996, 3, 1)
    wrong = mart.withColumn("completed_appointments", F.col("completed_appointments") + (F.col("appointment_period") == F.lit(month)).cast("int"))
    assert [r.month for r in checks.check_completed_by_month(wrong, fact).collect()] == [month]


def test_deleted_months_leave_their_part(spark, source, tmp_path):
    """A part whose last row moves away is gone; a table can become empty and fill again."""
    store = LayerStore(spark, str(tmp_path))
    df = spark.createDataFrame([(1, "2020-01"), (2, "2020-02")], f"id int, {PART} string")
    parts, schema = store.write_parts(df, "raw", "t")
    assert set(parts) == {"2020-01", "2020-02"}
    version = store.add("raw", "t", TableVersion({"2020-02": parts["2020-02"]}, schema, "v"))
    store.publish()
    assert [r.id for r in LayerStore(spark, str(tmp_path)).read_published("raw", "t").collect()] == [2]
    assert store.read(TableVersion({}, version.schema, "v")).count() == 0


@pytest.mark.parametrize("least", [1, 1 << 40])
def test_a_large_first_load_is_written_where_its_rows_are(spark, tmp_path, monkeypatch, least):
    rows = [(f"r{n % 40}", f"20{10 + n % 3}-0{1 + n % 9}-11", "", "x", str(n % 5), f"a{n}", "12", "7") for n in range(60)]
    source = spark.createDataFrame(rows, list(SPECS["report"].raw_columns)).repartition(3)
    source.write.parquet(str(tmp_path / "report"))
    plans, plain = {}, LayerStore.write_parts

    def noted(self, df, layer, table, sort_by=None, gather=True, **options):
        plans[layer, table] = gather or "Rebalance" in df._jdf.queryExecution().optimizedPlan().toString()
        return plain(self, df, layer, table, sort_by, gather, **options)

    monkeypatch.setattr(LayerStore, "write_parts", noted)
    monkeypatch.setattr(refresh, "SPREAD_BYTES", least)
    run = Refresh(spark, RefreshConfig(root=str(tmp_path / "out"), source=SourceConfig(format="parquet", path=str(tmp_path))))
    raw = run.load_raw(SPECS["report"])
    typed = run.load_typed(SPECS["report"], raw)
    assert plans == {("raw", "report"): least > 1, ("typed", "report"): least > 1}
    assert same(raw, source) and typed.count() == typed.select("report_id").distinct().count() == 40
    for layer, column in (("raw", F.substring("created_at", 1, 7)), ("typed", month_of(F.col("created_at")))):
        parts = run.versions[layer, "report"].parts
        assert len(parts) == 9
        for part in parts:
            found = run.store.read(run.versions[layer, "report"], [part])
            assert [r[0] for r in found.select(column).distinct().collect()] == [part]
    assert run._gathers("typed", "profile_disability_types", "report")


def test_bytes_of_files_are_counted_no_further_than_needed(spark, tmp_path):
    spark.range(1000).repartition(2).write.parquet(str(tmp_path / "t"))
    files, store = spark.read.parquet(str(tmp_path / "t")).inputFiles(), LayerStore(spark, str(tmp_path / "s"))
    sizes = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert store.holds(files, sizes) and not store.holds(files, sizes + 1) and not store.holds([], 1)
    assert store.holds([files[0], "file:/none"], 1)
