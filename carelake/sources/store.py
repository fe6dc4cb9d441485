"""Layer tables as sets of Parquet directories, one per part, published together.

A table's version names its parts and where each lies.  A run writes the parts it changes under its own run id; the
others stay where an earlier run wrote them.  Only at the end it appends one manifest row per table.  Readers use the
manifest published last, so they see either the whole run or none of it, and a run never overwrites what it reads.  A
manifest names the run it was built on; a run whose base is no longer the last one refuses to publish, so overlapping
runs lose nothing silently.

Tables that are finished are noted in a journal.  A later run on the same base takes over what a run that failed had
finished, if it was made from the same inputs; a table that was half written is in no journal and is never read.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST_DDL = (
    "run_id string, layer string, table_name string, parts map<string,string>, checksums map<string,string>,"
    " stats map<string,bigint>, version string, inputs string, params string, feed string, schema string, base_run string,"
    " published bigint"
)
#: Columns of the files that readers do not see: the row's hash and the part it belongs to.
ROW, PART = "_row", "_part"
#: The part of a table that has no others.
WHOLE = "all"


class PublishConflict(RuntimeError):
    """Another run was published since this one read its base."""


def digest_of(*values: object) -> str:
    """A name for some values: equal ones give equal names in every run."""
    return hashlib.sha256(json.dumps(values, sort_keys=True, default=str).encode()).hexdigest()[:32]


@dataclass(frozen=True)
class TableVersion:
    """``parts``: part -> directory.  ``version`` names the content, ``inputs`` what it was made from and how."""

    parts: Mapping[str, str]
    schema: str
    version: str
    inputs: str = ""
    params: str = ""
    feed: str = ""
    checksums: Mapping[str, str] = field(default_factory=dict)
    stats: Mapping[str, int] = field(default_factory=dict)


class LayerStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.run_id = f"{dt.datetime.now(dt.UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
        self._tables: dict[tuple[str, str], TableVersion] = {}
        self._base, self._number, self._published = self._read_manifest()
        self._journal = self._read_journal()

    # -- what is published -----------------------------------------------------------

    def _manifest(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(_MANIFEST_DDL).json(f"{self.root}/manifest")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _read_manifest(self) -> tuple[str | None, int, dict[tuple[str, str], TableVersion]]:
        """The run published last, its number and its tables."""
        manifest = self._manifest()
        if manifest is None:
            return None, 0, {}
        # One row per table of one run, so this is safe to bring to the driver.
        number = F.coalesce("published", F.lit(0))
        newest = manifest.agg(F.max(F.struct(number.alias("number"), "run_id")).alias("last")).select("last.*")
        rows = manifest.join(newest, "run_id").collect()
        if not rows:
            return None, 0, {}
        return rows[0].run_id, rows[0].number, {(r.layer, r.table_name): _version_of(r.asDict()) for r in rows}

    def published(self, layer: str, table: str) -> TableVersion | None:
        return self._published.get((layer, table))

    def read_published(self, layer: str, table: str) -> DataFrame | None:
        """The table as of the last published run, or None before the first."""
        version = self.published(layer, table)
        return None if version is None else self.read(version)

    def read(self, version: TableVersion, parts: Iterable[str] | None = None, hidden: bool = False) -> DataFrame:
        """The table, or some of its parts; with ``hidden`` also the row hashes."""
        schema = T.StructType.fromJson(json.loads(version.schema))
        paths = [path for part, path in version.parts.items() if parts is None or part in set(parts)]
        # The known schema spares a footer pass.
        df = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return df if hidden else df.drop(ROW)

    # -- the tables of this run --------------------------------------------------------

    def write(self, df: DataFrame, layer: str, table: str, partition_by: Sequence[str] = ()) -> DataFrame:
        """A table of one part, written and read back: cuts the lineage at a place every executor can reach."""
        path = f"{self.root}/{layer}/{table}/run={self.run_id}"
        df.write.partitionBy(*partition_by).parquet(path)
        self.add(layer, table, TableVersion({WHOLE: path}, df.schema.json(), self.run_id))
        return self.spark.read.schema(df.schema).parquet(path)

    def write_parts(
        self, df: DataFrame, layer: str, table: str, sort_by: str | None = None, gather: bool = True, spread: bool = False
    ) -> tuple[dict[str, str], str]:
        """Writes ``df`` by its column PART; returns part -> directory, and the files' schema.

        With ``gather`` rows are brought together by part; a part larger than Spark aims at is written by several tasks.
        With ``spread`` no row is moved: every task writes a file of each part it has rows of.  Tasks are as many as there
        are cores, so files grow with the rows, and not their number.
        """
        path = f"{self.root}/{layer}/{table}/run={self.run_id}-{uuid.uuid4().hex[:6]}"
        placed = df.hint("rebalance", F.col(PART)) if gather else df
        if sort_by:
            placed = placed.sortWithinPartitions(PART, sort_by)
        if spread:
            placed = placed.coalesce(self.spark.sparkContext.defaultParallelism)
        placed.write.option("compression", "zstd").partitionBy(PART).parquet(path)
        return self._directories(path), df.drop(PART).schema.json()

    def holds(self, files: Iterable[str], least: int) -> bool:
        """Whether files hold ``least`` bytes; no more of them are looked at than it takes to know."""
        held = 0
        for name in files:
            hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            held += hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).getLen()
            if held >= least:
                return True
        return held >= least

    def write_feed(self, df: DataFrame, layer: str, table: str) -> tuple[DataFrame, str]:
        """The changed rows of a table, kept as long as the run's tables."""
        path = f"{self.root}/feed/{layer}/{table}/run={self.run_id}-{uuid.uuid4().hex[:6]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def read_feed(self, layer: str, table: str) -> DataFrame | None:
        """Rows that the run published last has inserted, updated or removed (``_op``); None if it changed none."""
        version = self.published(layer, table)
        return self.spark.read.parquet(version.feed) if version is not None and version.feed else None

    def _directories(self, path: str) -> dict[str, str]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        found = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(hadoop)
        names = [status.getPath().getName() for status in found]
        return {n.removeprefix(f"{PART}="): f"{path}/{n}" for n in sorted(names) if n.startswith(f"{PART}=")}

    def add(self, layer: str, table: str, version: TableVersion) -> TableVersion:
        """A finished table of this run; noted in the journal when its inputs are known."""
        self._tables[layer, table] = version
        if version.inputs:
            self._note(layer, table, version)
        return version

    def finished(self, layer: str, table: str, inputs: str) -> TableVersion | None:
        """What a run that was not published had made from these inputs, on the same base."""
        version = self._journal.get((layer, table))
        return version if version is not None and version.inputs == inputs else None

    def in_journal(self, layer: str, table: str) -> TableVersion | None:
        return self._journal.get((layer, table))

    # -- the journal -------------------------------------------------------------------

    def _journal_path(self) -> str:
        return f"{self.root}/journal/base={self._base or 'none'}"

    def _note(self, layer: str, table: str, version: TableVersion) -> None:
        """Written beside its place and renamed, so that a reader finds the whole note or none."""
        spark = self.spark
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{self._journal_path()}/{layer}.{table}.{self.run_id}.json")
        beside = spark._jvm.org.apache.hadoop.fs.Path(f"{self._journal_path()}/_{layer}.{table}.{self.run_id}")
        files = target.getFileSystem(spark._jsc.hadoopConfiguration())
        out = files.create(beside, True)
        out.write(bytearray(json.dumps({"layer": layer, "table_name": table, "run_id": self.run_id, **asdict(version)}).encode()))
        out.close()
        files.delete(target, False)
        files.rename(beside, target)

    def _read_journal(self) -> dict[tuple[str, str], TableVersion]:
        try:
            notes = self.spark.read.schema(_MANIFEST_DDL).json(f"{self._journal_path()}/*.json").collect()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return {}
            raise
        # A row per table of the runs that failed since the last publication; later runs come last.
        return {(r.layer, r.table_name): _version_of(r.asDict()) for r in sorted(notes, key=lambda r: r.run_id)}

    # -- publishing --------------------------------------------------------------------

    def publish(self) -> None:
        last = self._read_manifest()[0]
        if last != self._base:
            raise PublishConflict(f"run {last} was published after {self._base}, which this run was built on")
        self._number += 1
        rows = [
            {"run_id": self.run_id, "layer": layer, "table_name": table, **asdict(version),
             "base_run": self._base, "published": self._number}
            for (layer, table), version in self._tables.items()
        ]
        manifest = self.spark.createDataFrame(rows, _MANIFEST_DDL).coalesce(1)
        manifest.write.mode("append").json(f"{self.root}/manifest")
        left = {p for v in self._journal.values() for p in v.parts.values()}
        delete_path(self.spark, self._journal_path())
        used = {p for v in self._tables.values() for p in v.parts.values()} | _paths(self._published.values())
        for path in left - used:  # of runs that failed, and not taken over
            delete_path(self.spark, path)
        self._base, self._journal = self.run_id, {}
        self._published = dict(self._tables)

    def retain(self, runs: int) -> int:
        """Deletes what no published run but the newest ``runs`` uses; returns how many runs went."""
        manifest = self._manifest()
        if manifest is None:
            return 0
        # One row per run and table: as bounded as the number of runs ever published.
        number = F.coalesce("published", F.lit(0))
        rows = manifest.select("run_id", number.alias("n"), "parts", "feed").collect()
        order = sorted({(r.n, r.run_id) for r in rows}, reverse=True)
        kept_runs = {run for _, run in order[: max(runs, 1)]}
        kept = {path for r in rows if r.run_id in kept_runs for path in (r.parts or {}).values()}
        deleted = set()
        for r in rows:
            if r.run_id in kept_runs:
                continue
            for path in [*(r.parts or {}).values(), *([r.feed] if r.feed else [])]:
                if path not in kept and delete_path(self.spark, path):
                    deleted.add(r.run_id)
        return len(deleted)


def _version_of(row: Mapping) -> TableVersion:
    return TableVersion(
        row["parts"] or {}, row["schema"], row["version"], row["inputs"] or "", row["params"] or "",
        row["feed"] or "", row["checksums"] or {}, row["stats"] or {},
    )


def _paths(versions: Iterable[TableVersion]) -> set[str]:
    return {path for v in versions for path in v.parts.values()}


def month_of(c: Column) -> Column:
    """The part of a time: its month; one part for what lies before 1900 or after 2199, one for NULL."""
    month = F.date_format(c, "yyyy-MM")
    return F.when(c.isNull(), F.lit("none")).when(F.year(c).between(1900, 2199), month).otherwise(F.lit("far"))


def delete_path(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the one the session names, else one under its warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return shared.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table, deleted when the session's JVM ends."""
    path = f"{scratch_root(spark)}/carelake/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back, for tables that are used more than once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
