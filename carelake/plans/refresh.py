"""Refresh: source -> raw -> typed -> model -> states -> marts, published as a whole.

Every table is a set of parts, mostly months.  A run compares the source's parts with those it has by order-free
checksums and writes the ones that differ.  A table whose inputs are unchanged is taken over as it is.  One that is made
anew is compared with its last version by key and row hash; only parts with a changed row are written.  States of the
marts are kept by part and made anew for changed parts alone.  Work on a rerun thus goes with what has changed, but
for one narrow look at keys and hashes of each changed table.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from carelake.config import RefreshConfig
from carelake.functions import surrogate
from carelake.functions.clean import TimeRule
from carelake.functions.measures import date_of_id
from carelake.operators import checks, dimensions, marts
from carelake.operators.fact import fact_appointments, fact_rejects
from carelake.operators.typed import ISO, build_typed, rejected_values
from carelake.operators.upsert import INSERTED, REMOVED, UPDATED, apply_changes, changes
from carelake.schemas import MART_SCHEMAS, MODEL_KEYS, NATURAL_KEYS, PARTED_BY, SPECS, TableSpec
from carelake.session import tune
from carelake.sources.readers import raw_table, read_source
from carelake.sources.store import PART, ROW, WHOLE, LayerStore, TableVersion, digest_of, materialize, month_of

# Independent tables are submitted together; Spark shares the executors among them.
PARALLEL_TABLES = 8

SUMMARY_DDL = (
    "layer string, table_name string, ok boolean, eligible bigint, inserted bigint,"
    " updated bigint, table_rows bigint, message string, sample_inserted boolean, unchanged bigint, removed bigint"
)
# Part of the name of everything a run makes: to be raised when a rule changes what it gives.
RULES = 1
# Ids of a part, for tables that have no time.
_IDS_PER_PART = 1 << 20
# From so many bytes of source files on, a first load writes rows where they are: shuffling them by month costs more than
# files do.  Below, and for sources without files, parts of one file each are worth the shuffle.
SPREAD_BYTES = 256 << 20
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class RefreshFailed(RuntimeError):
    """A table failed; nothing of this run is published."""


@dataclass(frozen=True)
class TableResult:
    layer: str
    table_name: str
    ok: bool
    eligible: int
    inserted: int
    updated: int
    table_rows: int
    message: str = ""
    sample_inserted: bool = False
    unchanged: int = 0
    removed: int = 0


@contextmanager
def _freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Each table's shuffles go from the disks once it is written, instead of when the driver's memory is next cleaned.

    For code that runs no DataFrame twice: a second run would make the shuffles anew.
    """
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


class _Counted:
    """A table whose rows are counted by the tasks that write it."""

    def __init__(self, df: DataFrame, *counts: Column) -> None:
        self._plain, self._counts, self._seen = df, counts, Observation()
        self.df = df.observe(self._seen, *counts)

    def counts(self) -> dict[str, int]:
        try:
            return self._seen.get
        except Py4JJavaError:  # Spark leaves an observation out of a plan that it finds to be empty
            return self._plain.agg(*self._counts).first().asDict()


class Refresh:
    """One run.  ``summary`` after :meth:`run` has one row per table."""

    def __init__(
        self,
        spark: SparkSession,
        cfg: RefreshConfig,
        load: Callable[[str], DataFrame] | None = None,
    ) -> None:
        self.spark = tune(spark)
        self.cfg = cfg
        self.store = LayerStore(spark, cfg.root)
        self.results: list[TableResult] = []
        self.seconds: dict[str, float] = {}
        self.versions: dict[tuple[str, str], TableVersion] = {}
        self._spread: dict[str, bool] = {}
        self._load = load or (lambda entity: read_source(spark, cfg.source, cfg.fields.table_name(entity)))

    # -- layers ------------------------------------------------------------------

    def load_raw(self, spec: TableSpec) -> DataFrame:
        """A snapshot: it replaces the one of the previous run, part by part where its rows differ."""
        source = self._load(spec.name)
        sampled = self.cfg.seed_empty_tables and source.isEmpty()
        self._spread[spec.name] = self.store.holds(source.inputFiles(), SPREAD_BYTES)
        raw = raw_table(source, spec, self.cfg.fields, sampled).withColumn(PART, _raw_part(spec))
        base = self.store.in_journal("raw", spec.name) or self.store.published("raw", spec.name)

        def written_sums(parts: dict[str, str], schema: str) -> dict[str, str]:
            files = self.store.read(TableVersion(parts, schema, ""))
            return _checksums(files.withColumn(PART, _raw_part(spec))) if parts else {}

        if base is None:
            gather = self._gathers("typed", spec.name, spec.name)
            kept, (parts, schema) = {}, self.store.write_parts(raw, "raw", spec.name, gather=gather, spread=not gather)
            sums = written_sums(parts, schema)
        else:
            now, schema = _checksums(raw), raw.drop(PART).schema.json()
            stale = [p for p, c in now.items() if base.checksums.get(p) != c or base.schema != schema]
            kept = {p: base.parts[p] for p in now if p not in stale}
            parts = self.store.write_parts(raw.filter(F.col(PART).isin(stale)), "raw", spec.name)[0] if stale else {}
            # What is noted is what was written, should the source have moved on meanwhile.
            sums = {p: now[p] for p in kept} | written_sums(parts, schema)
        rows = sum(int(c.split(":")[0]) for c in sums.values())
        name = digest_of(RULES, schema, sums)
        version = TableVersion(kept | parts, schema, name, name, checksums=sums, stats={"rows": rows})
        self._record("raw", spec.name, rows, rows, 0, rows, sampled)
        return self._added("raw", spec.name, version)

    def load_typed(self, spec: TableSpec, raw: DataFrame) -> DataFrame:
        rules = [self._version("raw", spec.name), repr(spec), self.cfg.price_locale, repr(self.cfg.fields.times)]
        return self._merge(
            lambda: build_typed(raw, spec, self.cfg.price_locale, self.cfg.fields.times), "typed", spec.name, [spec.key], rules, spec.name
        )

    def load_model(self, typed: dict[str, DataFrame]) -> dict[str, DataFrame]:
        salt = self.cfg.key_salt
        lookups = ("ethnicgroup", "genderidentity", "pronoun", "sexualorientation", "privacydocument", "disabilitytype", "address_state")
        sources = {
            "dim_date": (lambda: dimensions.dim_date(typed["appointment"]), ["appointment"]),
            "dim_report": (lambda: dimensions.dim_report(typed["report"]), ["report"]),
            "dim_clinic": (lambda: dimensions.dim_clinic(typed["clinic"], typed["address_state"]), ["clinic", "address_state"]),
            "dim_professional": (
                lambda: dimensions.dim_professional(typed["professional"], typed, salt),
                ["professional", "professional_disability_types", *lookups],
            ),
            "dim_patient": (
                lambda: dimensions.dim_patient(typed["user"], typed["profile"], typed, salt),
                ["user", "profile", "profile_disability_types", *lookups],
            ),
        }

        def build(name: str) -> DataFrame:
            source, uses = sources[name]
            only_new = name in ("dim_date", "dim_report")
            return self._merge(
                lambda: dimensions.conform(source(), name),
                "model", name, NATURAL_KEYS.get(name, [MODEL_KEYS[name]]),
                [salt, *[self._version("typed", u) for u in uses]], uses[0], only_new,
            )

        model = self._each("model", sources, build)
        uses = ("appointment", "report", "cancellation", "professional", "clinic", "user", "address_state")
        # Sorted files: row-group statistics prune reads by date.  The typed layer holds every appointment, so a fact
        # that cannot be made from it any more is superseded: its appointment has moved to another date or lost it.
        model["fact_appointments"] = self._merge(
            lambda: fact_appointments(typed, model, salt=salt),
            "model", "fact_appointments", [MODEL_KEYS["fact_appointments"]],
            [salt, self.cfg.keep_superseded, self._version("model", "dim_patient"), *[self._version("typed", u) for u in uses]],
            "appointment", sort_by="date_id", removing=not self.cfg.keep_superseded,
        )
        self._whole("model", "fact_rejects", [self._version("typed", "appointment")], lambda: fact_rejects(typed["appointment"]))
        return model

    def load_states(self, model: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """What the marts are summed from, by month of the facts or of the patients' registration."""
        as_of = str(self.cfg.as_of or dt.date.today())
        sources = {
            "appointments": ("fact_appointments", [], lambda df: marts.appointment_states(df, model["dim_report"])),
            "patients": (
                "dim_patient", [as_of, self.cfg.strict_minor_bucket],
                lambda df: marts.patient_counts(df, as_of, self.cfg.strict_minor_bucket),
            ),
            "patient_disability": ("dim_patient", [], marts.mart_patient_disability),
        }
        return self._each("state", sources, lambda name: self._derived("state", name, *sources[name]))

    def load_marts(self, model: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Marts are summed up from states, so groups that no longer exist disappear."""
        state = self.states = self.load_states(model)
        professional = model["dim_professional"]
        uses = [self._version("state", "appointments"), self._version("model", "dim_professional")]
        sources = {
            "patients": (lambda: marts.patients_from_counts(state["patients"]), [self._version("state", "patients")]),
            "patient_disability": (lambda: state["patient_disability"], [self._version("state", "patient_disability")]),
            "professionals": (lambda: marts.professionals_from_states(professional, state["appointments"]), uses),
            "professional_appointments": (lambda: marts.professional_appointments_from_states(professional, state["appointments"]), uses),
        }

        def build(name: str) -> DataFrame:
            source, used = sources[name]
            return self._whole("mart", name, used, lambda: dimensions.conform(source(), name, MART_SCHEMAS))

        return self._each("mart", sources, build)

    # -- run ---------------------------------------------------------------------

    def run(self) -> DataFrame:
        """All layers in order, then the checks.  A failure raises before the next layer and before publishing."""
        with _freeing_shuffles(self.spark):
            self._build()
        self.store.publish()
        self.store.retain(self.cfg.keep_runs)
        return self.summary()

    def _build(self) -> None:
        self.raw = self._timed("raw", lambda: self._each("raw", SPECS, lambda n: self.load_raw(SPECS[n])))
        self.typed = self._timed(
            "typed", lambda: self._each("typed", SPECS, lambda n: self.load_typed(SPECS[n], self.raw[n]))
        )
        self.model = self._timed("model", lambda: self.load_model(self.typed))
        self.marts = self._timed("mart", lambda: self.load_marts(self.model))
        self._timed("check", self.check)

    def check(self) -> dict[str, DataFrame]:
        """Every check on what this run has changed; violations stop it.

        What was published has passed them, and dimensions lose no rows, so facts of other parts need no second look.
        """
        model, pii = self.model, set(self.cfg.fields.pii)
        found = {}
        months = self._changed_parts("model", "fact_appointments")
        if months or self._changed("mart", "professional_appointments"):
            fact = self.store.read(self.versions["model", "fact_appointments"], months)
            found["duplicate_fingerprints"] = checks.check_duplicate_fingerprints(fact)
            found["references"] = checks.check_references(fact, model)
            found["completed_totals"] = checks.check_completed_by_month(self.marts["professional_appointments"], model["fact_appointments"])
        for dim, natural in NATURAL_KEYS.items():
            if self._changed("model", dim):
                found[f"collisions_{dim}"] = checks.check_surrogate_collisions(model[dim], MODEL_KEYS[dim], natural)
        for layer, tables in (("raw", self.raw), ("typed", self.typed)):
            for name, df in tables.items():
                if self._changed(layer, name) and (columns := [c for c in df.columns if c in pii]):
                    found[f"pii_{layer}_{name}"] = checks.filled_counts(df, columns).filter("filled > 0")
        if any(self._changed("model", name) for name in ("dim_patient", "dim_professional")):
            found["pii_model"] = checks.check_model_pii(model)

        with ThreadPoolExecutor(PARALLEL_TABLES) as pool:
            counts = dict(zip(found, pool.map(lambda name: found[name].count(), found), strict=True))
        if bad := {name: n for name, n in counts.items() if n}:
            for name, n in bad.items():
                self._fail("check", name, f"{n} violations")
            raise RefreshFailed("checks: " + ", ".join(f"{name} ({n})" for name, n in bad.items()))
        return {}

    def summary(self) -> DataFrame:
        rows = sorted(self.results, key=lambda r: (r.layer, r.table_name))
        return self.spark.createDataFrame([vars(r) for r in rows], SUMMARY_DDL)

    def rejected(self) -> DataFrame:
        """(table_name, column_name, rejected): filled raw values no rule could read."""
        return rejected_report(self.raw, self.cfg.price_locale, self.cfg.fields.times)

    # -- helpers -----------------------------------------------------------------

    def _version(self, layer: str, name: str) -> str:
        return self.versions[layer, name].version

    def _added(self, layer: str, name: str, version: TableVersion) -> DataFrame:
        self.versions[layer, name] = self.store.add(layer, name, version)
        return self.store.read(version)

    def _gathers(self, layer: str, name: str, entity: str) -> bool:
        """Whether a first load brings the rows of a part together before it writes them.

        Ranges of ids are more for more rows, and so would the files be; months are no more, however many rows there are.
        """
        return PARTED_BY.get((layer, name)) == "id" or not self._spread.get(entity, False)

    def _changed(self, layer: str, name: str) -> bool:
        base, now = self.store.published(layer, name), self.versions.get((layer, name))
        return base is None or now is None or base.version != now.version

    def _changed_parts(self, layer: str, name: str) -> list[str]:
        base = self.store.published(layer, name)
        return [p for p, path in self.versions[layer, name].parts.items() if base is None or base.parts.get(p) != path]

    def _taken_over(self, layer: str, name: str, inputs: str) -> DataFrame | None:
        """The table as a run that failed had finished it, or as published, if made from the same inputs."""
        if done := self.store.finished(layer, name, inputs):
            s = done.stats
            self._record(
                layer, name, s["eligible"], s["inserted"], s["updated"], s["rows"], unchanged=s["unchanged"], removed=s["removed"]
            )
            return self._added(layer, name, done)
        base = self.store.published(layer, name)
        if base is None or base.inputs != inputs:
            return None
        rows, eligible = base.stats["rows"], base.stats["eligible"]
        again = {"eligible": eligible, "inserted": 0, "updated": 0, "removed": 0, "unchanged": eligible, "rows": rows}
        self._record(layer, name, eligible, 0, 0, rows, unchanged=eligible)
        return self._added(layer, name, replace(base, stats=again, feed=""))

    def _merge(
        self,
        build: Callable[[], DataFrame],
        layer: str,
        name: str,
        keys: Sequence[str],
        uses: Sequence[object],
        entity: str,
        only_new: bool = False,
        sort_by: str | None = None,
        removing: bool = False,
    ) -> DataFrame:
        """Upsert into the published table: writes the changed rows as a feed, then the parts they are in.

        The table has about as many rows as ``entity``.  Counts are observed in the tasks that write, where Spark counts each task once.
        """
        inputs = digest_of(RULES, layer, name, *uses)
        if (done := self._taken_over(layer, name, inputs)) is not None:
            return done
        src = build()
        part = PARTED_BY.get((layer, name))
        columns, src = src.columns, src.withColumn(PART, _part_of(src, part))
        base = self.store.published(layer, name)
        gather = base is None and part is not None and self._gathers(layer, name, entity)
        if gather:
            src = src.hint("rebalance", F.col(PART))  # before a row has its hash, which no shuffle can compress
        src = src.select(*columns, surrogate(*columns).alias(ROW), PART)
        if base is None:
            counted = _Counted(src, F.count(F.lit(1)).alias("n"))
            parts, schema = self.store.write_parts(counted.df, layer, name, sort_by, gather=False, spread=part is not None and not gather)
            rows = counted.counts()["n"]
            stats = {"eligible": rows, "inserted": rows, "updated": 0, "removed": 0, "unchanged": 0, "rows": rows}
            self._record(layer, name, rows, rows, 0, rows)
            return self._added(layer, name, TableVersion(parts, schema, digest_of(inputs), inputs, stats=stats))

        # Written once: the join's planner would otherwise infer constraints through every cleaning expression.
        src = materialize(src, f"{layer}-{name}")
        schema = src.drop(PART).schema.json()
        old = self.store.read(base, hidden=True)
        known = old.withColumn(PART, _part_of(old, part))
        ops = {"inserted": INSERTED, "updated": UPDATED, "removed": REMOVED}
        counted = _Counted(
            changes(known, src, keys, only_new, removing),
            F.count_if("_in_src").alias("eligible"),
            *[F.count_if(F.col("_op").eqNullSafe(op)).alias(count) for count, op in ops.items()],
        )
        feed, path = self.store.write_feed(counted.df.filter("_op is not null").drop("_in_src"), layer, name)
        counts = counted.counts()
        touched = sorted({p for r in feed.select(PART, "_old_part").distinct().collect() for p in r if p is not None})
        stats = {
            **counts,
            "unchanged": counts["eligible"] - counts["inserted"] - counts["updated"],
            "rows": base.stats["rows"] + counts["inserted"] - counts["removed"],
        }
        self._record(
            layer, name, stats["eligible"], stats["inserted"], stats["updated"], stats["rows"],
            unchanged=stats["unchanged"], removed=stats["removed"],
        )
        if not touched:
            return self._added(layer, name, replace(base, inputs=inputs, stats=stats, feed=""))
        rest = self.store.read(base, touched, hidden=True)
        merged = apply_changes(rest, feed, keys)
        parts, _ = self.store.write_parts(merged.withColumn(PART, _part_of(merged, part)), layer, name, sort_by, part is not None)
        kept = {p: path for p, path in base.parts.items() if p not in touched}
        return self._added(layer, name, TableVersion(kept | parts, schema, digest_of(base.version, inputs), inputs, stats=stats, feed=path))

    def _whole(self, layer: str, name: str, uses: Sequence[object], build: Callable[[], DataFrame]) -> DataFrame:
        """A table that is replaced as a whole when its inputs have changed."""
        inputs = digest_of(RULES, layer, name, *uses)
        done = self.store.finished(layer, name, inputs) or self.store.published(layer, name)
        if done is None or done.inputs != inputs:
            counted = _Counted(build().withColumn(PART, F.lit(WHOLE)), F.count(F.lit(1)).alias("n"))
            parts, schema = self.store.write_parts(counted.df, layer, name, gather=False)
            done = TableVersion(parts, schema, inputs, inputs, stats={"rows": counted.counts()["n"]})
        self._record(layer, name, done.stats["rows"], done.stats["rows"], 0, done.stats["rows"])
        return self._added(layer, name, done)

    def _derived(
        self, layer: str, name: str, source: str, uses: Sequence[object], build: Callable[[DataFrame], DataFrame]
    ) -> DataFrame:
        """A table each part of which is made from the same part of a model table: changed parts are made anew."""
        of = self.versions["model", source]
        params = digest_of(RULES, layer, name, *uses)
        inputs = digest_of(params, of.version)
        if (done := self.store.finished(layer, name, inputs)) is not None:
            return self._added(layer, name, done)
        base = self.store.published(layer, name)
        if base is not None and base.params != params:
            base = None
        stale = [p for p, path in of.parts.items() if base is None or base.checksums.get(p) != path]
        kept = {} if base is None else {p: path for p, path in base.parts.items() if p in of.parts and p not in stale}
        df = build(self.store.read(of, stale))
        if stale or base is None:
            parts, schema = self.store.write_parts(df.withColumn(PART, month_of(F.col("period_month"))), layer, name)
        else:
            parts, schema = {}, base.schema
        version = base.version if base is not None and not stale and kept == base.parts else digest_of(inputs, params)
        return self._added(layer, name, TableVersion(kept | parts, schema, version, inputs, params, checksums=dict(of.parts)))

    def _timed(self, layer: str, build: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        start = time.perf_counter()
        tables = build()
        self.seconds[layer] = time.perf_counter() - start
        return tables

    def _record(
        self,
        layer: str,
        name: str,
        eligible: int,
        inserted: int,
        updated: int,
        rows: int,
        sampled: bool = False,
        unchanged: int = 0,
        removed: int = 0,
    ) -> None:
        self.results.append(TableResult(layer, name, True, eligible, inserted, updated, rows, "", sampled, unchanged, removed))

    def _fail(self, layer: str, name: str, message: str) -> None:
        self.results.append(TableResult(layer, name, False, 0, 0, 0, 0, message))

    def _each(self, layer: str, names: Iterable[str], build: Callable[[str], DataFrame]) -> dict[str, DataFrame]:
        """Builds every table, then fails if one failed: the summary has a row for each."""

        def guarded(name: str) -> DataFrame | Exception:
            try:
                return build(name)
            except Exception as error:  # noqa: BLE001  raised below, once all tables have been tried
                self._fail(layer, name, f"{type(error).__name__}: {error}")
                return error

        with ThreadPoolExecutor(PARALLEL_TABLES) as pool:
            built = dict(zip(names, pool.map(guarded, names), strict=True))
        failed = {name: error for name, error in built.items() if isinstance(error, Exception)}
        if failed:
            first = next(iter(failed.values()))
            raise RefreshFailed("; ".join(f"{name}: {error}" for name, error in failed.items())) from first
        return built


def _part_of(df: DataFrame, column: str | None) -> Column:
    """The part of a typed or model row: the month of a time or date key, a range of ids, or the whole."""
    if column is None:
        return F.lit(WHOLE)
    kind = df.schema[column].dataType.simpleString()
    if kind != "int":
        return month_of(F.col(column))
    if column == "date_id":
        return month_of(date_of_id(column))
    return F.concat(F.lit("ids-"), F.call_function("div", F.col(column), F.lit(_IDS_PER_PART)).cast("string"))


def _raw_part(spec: TableSpec) -> Column:
    """The part of a raw row, from its text: the month it names first, or a range of ids."""
    column = PARTED_BY.get(("typed", spec.name))
    source = {c.target: c.source for c in spec.columns}.get(column)
    if source is None:
        return F.lit(WHOLE)
    if source == spec.raw_key:
        block = F.call_function("div", F.trim(source).try_cast("int"), F.lit(_IDS_PER_PART))
        return F.coalesce(F.when(block >= 0, F.concat(F.lit("ids-"), block.cast("string"))), F.lit("none"))
    month = F.regexp_extract(F.col(source), "((?:19|20|21)[0-9]{2}-(?:0[1-9]|1[0-2]))(?![0-9])", 1)
    return F.when(month != "", month).otherwise(F.lit("none"))


def _checksums(df: DataFrame) -> dict[str, str]:
    """Per part, how many rows it has and sums of their hashes: the same in any order, other for other rows."""
    columns = [c for c in df.columns if c != PART]
    h = F.col("h")
    sums = (
        df.select(PART, surrogate(*columns).alias("h"))
        .groupBy(PART)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.bit_xor(h).alias("x"),
            # Whole numbers of 31 bits; beyond four thousand million rows a part the sum is NULL, which compares as well.
            F.try_sum(h.bitwiseAND(0x7FFFFFFF)).alias("low"),
            F.try_sum(F.shiftrightunsigned(h, 33)).alias("high"),
        )
    )
    return {r[PART]: f"{r.n}:{r.x}:{r.low}:{r.high}" for r in sums.collect()}  # a row per part


def rejected_report(
    raw: dict[str, DataFrame], price_locale: str | None = None, times: TimeRule = ISO
) -> DataFrame:
    out = None
    for name, df in raw.items():
        if not any(c.lossy for c in SPECS[name].columns):
            continue
        part = rejected_values(df, SPECS[name], price_locale, times).select(
            F.lit(name).alias("table_name"), "column_name", "rejected"
        )
        out = part if out is None else out.unionByName(part)
    return out


def summary_totals(summary: DataFrame) -> DataFrame:
    """Totals over tables, per layer."""
    return summary.groupBy("layer").agg(
        F.count(F.lit(1)).alias("tables"),
        F.sum("eligible").alias("eligible"),
        F.sum("inserted").alias("inserted"),
        F.sum("updated").alias("updated"),
        F.sum("table_rows").alias("table_rows"),
    )


def run_refresh(spark: SparkSession, cfg: RefreshConfig) -> DataFrame:
    return Refresh(spark, cfg).run()
