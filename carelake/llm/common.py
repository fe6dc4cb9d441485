"""Helpers that several corpus operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of output a Python task gathers before it hands a batch on.
BATCH_BYTES = 8 << 20
#: Rows of an input batch that are taken out of Arrow at once.
SLICE_ROWS = 256
#: Rows of a side that is broadcast at most.
BROADCAST_ROWS = 1_000_000
#: Applications whose tasks have this package.
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir, else one under the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: cuts the lineage, survives lost executors, and has a known size."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Gives the tasks this package, as a file that Spark hands out, once per application."""
    if (application := spark.sparkContext.applicationId) not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        folder = tempfile.mkdtemp()  # the driver's own: tasks fetch the file from the driver
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/carelake-{application}", "zip", root, "carelake"))
        _SHIPPED.add(application)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame) -> DataFrame:
    """A side of a join, to be broadcast if it has BROADCAST_ROWS at most; beyond, the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def text_of(column: str | Column) -> Column:
    """The column as text; null counts as empty."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def digest(column: Column) -> Column:
    """32 bytes that stand for a text."""
    return F.unhex(F.sha2(column, 256))


def give_back() -> None:
    """Returns what Python, Arrow and the C library hold unused to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[..., Iterator[tuple]]],
    schema: str,
) -> DataFrame:
    """Every row through a Python function in the tasks, by Arrow batches.

    `make` runs once per task and returns the function: it takes the row's values and yields tuples in the order
    of `schema`. Output is handed on every BATCH_BYTES, so a task holds one input batch and one output batch.
    """
    spark = df.sparkSession
    ship(spark)
    shape = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for at in range(0, batch.num_rows, SLICE_ROWS):  # few rows at once are Python objects
                for row in zip(*[c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns], strict=True):
                    for made in function(*row):
                        out.append(made)
                        held += 64 + sum(getattr(v, "nbytes", None) or len(v) for v in made if hasattr(v, "__len__"))
                    if held > BATCH_BYTES:
                        yield _batch(out, arrow)
                        out, held = [], 0
            if out:
                yield _batch(out, arrow)
        # a worker lives on: what this task held goes back to the machine
        del function
        give_back()

    return df.mapInArrow(run, shape)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(v, type=f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
    )
