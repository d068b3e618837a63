"""Helpers that the operators of this folder share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the contracts call white space: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, also where lambdas inside ``body`` use it."""
    return F.transform(F.array(value), body).getItem(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only a local master, as in tests, may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
    return named or tempfile.mkdtemp(prefix="kgloom-")


#: Rows of figures that a part of a checkpoint holds if fewer parts would do.
PART_ROWS = 50_000
#: So many parts aren't worth dealing anew.
MANY_PARTS = 1_000


def cut(df: DataFrame, rows: int | None = None, dealt: bool = False) -> DataFrame:
    """Computes ``df`` into the session's shared checkpoint folder and reads it from there.

    ``rows``: how many there are at most, if known. Then few rows go into few files, as each file costs a task, and on file systems
    without native calls a process. The parts are never more than ``df`` has, nor fewer than the cluster has cores. ``dealt``: the rows
    come from tasks that should stay as many as they are, so that few rows are dealt to fewer tasks behind them.

    Spark removes what is no longer used if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is true.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    if rows is not None:
        parts = max(rows // PART_ROWS + 1, sc.defaultParallelism)
        df = df.coalesce(parts) if not dealt else df.repartition(parts) if parts < MANY_PARTS else df
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, *folders: str) -> None:
    """Removes folders of any file system that Spark knows."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def on_batches(df: DataFrame, make: Callable[[list[list]], list[list]], schema: str, arrow: pa.Schema) -> DataFrame:
    """``make`` gets the columns of some rows as lists and returns the columns of the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                cols = make([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow.types, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of about ``most_bytes`` (one row at least), so that memory doesn't hang on the rows a batch holds."""
    step = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
    for k in range(0, batch.num_rows, step):
        yield batch.slice(k, step)
