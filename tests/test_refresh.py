"""Whole runs: first load, rerun, change, failure, partner names."""

import pytest
from pyspark.sql import functions as F

from carelake.config import FieldMap, RefreshConfig, SourceConfig
from carelake.operators import checks
from carelake.operators.fact import fact_appointments
from carelake.operators.upsert import merge
from carelake.plans.refresh import Refresh, RefreshFailed, run_refresh, summary_totals
from carelake.schemas import SPECS
from carelake.sources.readers import SourceTableMissing, jdbc_options, quoted_name, read_source
from carelake.sources.store import LayerStore, PublishConflict
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


@pytest.fixture(scope="module")
def runs(spark, source, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("layers"))
    cfg = RefreshConfig(root=root, source=source, as_of=AS_OF)
    first = Refresh(spark, cfg)
    first.run()
    before = {t: LayerStore(spark, root).read_published(*t) for t in first.store._published}
    second = Refresh(spark, cfg)
    second.run()
    return root, first, second, before


def test_first_run_inserts_everything(runs):
    _, first, _, _ = runs
    results = {(r.layer, r.table_name): r for r in first.results}
    assert len(results) == 16 + 16 + 7 + 4
    assert all(r.inserted == r.eligible == r.table_rows and r.updated == 0 for r in results.values())


def test_second_run_inserts_nothing(runs):
    _, first, second, _ = runs
    rows = {(r.layer, r.table_name): r.table_rows for r in first.results}
    for r in second.results:
        assert r.table_rows == rows[r.layer, r.table_name]
        if r.layer in ("typed", "model") and r.table_name != "fact_rejects":
            assert r.inserted == 0, r


def test_second_run_changes_nothing(spark, runs):
    root, _, _, before = runs
    store = LayerStore(spark, root)
    for layer, table in before:
        if layer.endswith("_source"):
            continue
        old, new = before[layer, table], store.read_published(layer, table)
        assert old.columns == new.columns
        assert old.exceptAll(new).isEmpty() and new.exceptAll(old).isEmpty(), (layer, table)


def test_no_patient_is_lost_on_rerun(spark, runs):
    root, _, _, before = runs
    fact = LayerStore(spark, root).read_published("model", "fact_appointments")
    linked = fact.filter("patient_id is not null").count()
    assert linked == before["model", "fact_appointments"].filter("patient_id is not null").count() > 0


def test_layers_reconcile(spark, runs):
    root, _, _, _ = runs
    store = LayerStore(spark, root)
    names = ("dim_date", "dim_report", "dim_clinic", "dim_professional", "dim_patient")
    model = {n: store.read_published("model", n) for n in names}
    fact = store.read_published("model", "fact_appointments")
    assert checks.check_duplicate_fingerprints(fact).isEmpty()
    assert checks.check_references(fact, model).isEmpty()
    assert checks.check_completed_totals(store.read_published("mart", "professional_appointments"), fact).isEmpty()
    assert checks.check_pii(store.read_published("typed", "user"), ["email", "password", "phone"]).isEmpty()


def test_summary_totals(runs):
    _, first, _, _ = runs
    totals = {r.layer: r for r in summary_totals(first.summary()).collect()}
    assert totals["typed"].tables == 16
    assert totals["typed"].inserted == sum(r.inserted for r in first.results if r.layer == "typed")


def test_changed_rows_update_and_new_rows_insert(spark, source, runs):
    root, _, _, _ = runs

    def load(entity):
        df = read_source(spark, source, entity)
        if entity != "appointment":
            return df
        extra = df.limit(1).withColumns({"id": F.lit("brand-new"), "date": F.lit("2001-01-01")})
        return df.unionByName(extra).withColumn("status", F.lit("completed"))

    third = Refresh(spark, RefreshConfig(root=root, source=source, as_of=AS_OF), load=load)
    third.run()
    results = {(r.layer, r.table_name): r for r in third.results}
    assert results["typed", "appointment"].inserted == 1
    assert results["model", "fact_appointments"].inserted == 1
    fact = LayerStore(spark, root).read_published("model", "fact_appointments")
    # A fact whose appointment moved to another date keeps its old fingerprint and stays as it was.
    current = fact_appointments(third.typed, columns=["appointment_fingerprint"])
    statuses = fact.join(current, "appointment_fingerprint", "left_semi").groupBy("status").count().collect()
    assert [tuple(r) for r in statuses] == [("completed", results["model", "fact_appointments"].eligible)]


def test_failure_publishes_nothing(spark, source, tmp_path):
    def load(entity):
        if entity == "clinic":
            raise SourceTableMissing("source table 'clinic' not found")
        return read_source(spark, source, entity)

    cfg = RefreshConfig(root=str(tmp_path), source=source)
    with pytest.raises(RefreshFailed, match="clinic"):
        Refresh(spark, cfg, load=load).run()
    assert LayerStore(spark, str(tmp_path)).read_published("typed", "appointment") is None


def test_missing_source_table(spark, source):
    with pytest.raises(SourceTableMissing):
        read_source(spark, source, "nothing_here")
    with pytest.raises(SourceTableMissing):
        read_source(spark, SourceConfig(format="table", database="default"), "nothing_here")
    with pytest.raises(ValueError):
        read_source(spark, SourceConfig(format="carrier-pigeon"), "x")


@pytest.mark.parametrize("fmt", ["csv", "json", "orc", "parquet"])
def test_file_formats(spark, tmp_path, fmt):
    df = spark.createDataFrame([("1", 'a "quoted"\nline'), ("2", None)], "id string, name string")
    writer = df.coalesce(1).write.format(fmt)
    (writer.option("header", "true").option("escape", '"') if fmt == "csv" else writer).save(f"{tmp_path}/people")
    options = {"multiLine": "true"} if fmt == "csv" else {}
    got = read_source(spark, SourceConfig(format=fmt, path=str(tmp_path), options=options), "people")
    assert sorted(got.select("id", "name").collect()) == sorted(df.collect(), key=lambda r: r.id)


def test_partner_names_and_empty_tables(spark, source, tmp_path):
    """Partner table and column names, value maps from JSON, and sample rows for empty tables."""
    partner = tmp_path / "partner"
    for entity in SPECS:
        if entity != "appointment":
            spark.createDataFrame([], SPECS[entity].raw_schema).write.parquet(f"{partner}/{entity}")
    spark.createDataFrame(
        [("1", "2020-01-01", "DONE", "video")], "booking string, day string, state string, channel string"
    ).write.parquet(f"{partner}/bookings")
    fields = FieldMap.from_json(
        """{"tables": {"appointment": "bookings"},
            "columns": {"appointment": {"booking": "id", "day": "date", "state": "status", "channel": "type"}},
            "values": {"appointment": {"status": {"labels": {"completed": ["done"]}, "default": "scheduled"},
                                       "type": {"labels": {"Online": ["video"]}, "default": "Outro"}}}}"""
    )
    cfg = RefreshConfig(
        root=str(tmp_path / "layers"),
        source=SourceConfig(path=str(partner)),
        fields=fields,
        seed_empty_tables=True,
    )
    summary = {(r.layer, r.table_name): r.table_rows for r in run_refresh(spark, cfg).collect()}
    assert summary["raw", "clinic"] == 1 and summary["typed", "clinic"] == 0
    assert summary["typed", "user"] == 1
    fact = LayerStore(spark, cfg.root).read_published("model", "fact_appointments").first()
    assert (fact.status, fact.type, fact.date_id) == ("completed", "Online", 20200101)


def test_sources_that_one_task_would_read_must_say_so(spark):
    with pytest.raises(ValueError, match="multiLine"):
        read_source(spark, SourceConfig(format="csv", path="/nowhere"), "people")
    with pytest.raises(ValueError, match="singlePartition"):
        jdbc_options("my-db", "user", {"url": "x"})
    got = jdbc_options('my-db.a"b', "user", {"url": "x", "singlePartition": "true"})
    assert got == {"url": "x", "dbtable": '"my-db"."a""b"."user"'}
    assert quoted_name("my-db", "user", "`") == "`my-db`.`user`"


def test_catalog_names_are_quoted(spark):
    # Spark's own catalog holds no such database, but the name now reaches it.
    with pytest.raises(SourceTableMissing):
        read_source(spark, SourceConfig(format="table", database="my-db"), "people")
    spark.range(3).createOrReplaceTempView("people_view")
    assert read_source(spark, SourceConfig(format="table"), "people_view").count() == 3


def test_merge_goes_by_natural_keys_and_checks_find_collisions(spark):
    old = spark.createDataFrame([(1, "a", None, 1), (2, "b", "x", 1)], "id bigint, name string, city string, v int")
    new = spark.createDataFrame([(1, "c", None, 2), (1, "a", None, 3)], "id bigint, name string, city string, v int")
    merged = merge(old, new, ["name", "city"])
    rows = {(r.name, r.v, r._in_src, r._in_target) for r in merged.collect()}
    assert rows == {("a", 3, True, True), ("b", 1, False, True), ("c", 2, True, False)}
    assert [r.id for r in checks.check_surrogate_collisions(merged, "id", ["name", "city"]).collect()] == [1]
    kept = {(r.name, r.v) for r in merge(old, new, ["name", "city"], only_new=True).collect()}
    assert kept == {("a", 1), ("b", 1), ("c", 2)}


class _Broken(Refresh):
    def load_typed(self, spec, raw):
        if spec.name in ("report", "clinic"):
            raise ValueError(f"{spec.name} is broken")
        return super().load_typed(spec, raw)


def test_summary_names_every_failed_table(spark, source, tmp_path):
    run = _Broken(spark, RefreshConfig(root=str(tmp_path), source=source, as_of=AS_OF))
    with pytest.raises(RefreshFailed, match="clinic is broken.*report is broken|report is broken.*clinic is broken"):
        run.run()
    rows = {(r.layer, r.table_name): r for r in run.summary().collect()}
    assert len(rows) == 2 * len(SPECS)
    assert {n for (la, n), r in rows.items() if not r.ok} == {"report", "clinic"}
    assert "report is broken" in rows["typed", "report"].message and rows["typed", "report"].table_rows == 0


def test_a_check_stops_a_run_before_it_is_published(spark, source, tmp_path, monkeypatch):
    violation = spark.range(1).select(F.lit("k").alias("appointment_fingerprint"), F.lit(2).alias("n"))
    monkeypatch.setattr(checks, "check_duplicate_fingerprints", lambda fact: violation)
    run = Refresh(spark, RefreshConfig(root=str(tmp_path), source=source, as_of=AS_OF))
    with pytest.raises(RefreshFailed, match="duplicate_fingerprints"):
        run.run()
    assert LayerStore(spark, str(tmp_path)).read_published("raw", "appointment") is None


def test_overlapping_runs_do_not_overwrite_each_other(spark, tmp_path):
    root = str(tmp_path / "store")
    first, second = LayerStore(spark, root), LayerStore(spark, root)
    for store, value in ((second, 2), (first, 1)):
        store.write(spark.createDataFrame([(value,)], "v int"), "raw", "t")
    second.publish()
    with pytest.raises(PublishConflict):
        first.publish()
    assert LayerStore(spark, root).read_published("raw", "t").first().v == 2


def test_old_runs_are_deleted(spark, tmp_path):
    root = str(tmp_path / "store")
    for value in range(4):
        store = LayerStore(spark, root)
        store.write(spark.createDataFrame([(value,)], "v int"), "raw", "t")
        store.publish()
    assert store.retain(2) == 2 and store.retain(2) == 0
    assert LayerStore(spark, root).read_published("raw", "t").first().v == 3
    assert len(list((tmp_path / "store" / "raw" / "t").iterdir())) == 2
