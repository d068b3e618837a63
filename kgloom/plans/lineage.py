"""Cutting the lineage of iterative plans, and the folder that executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master, as in tests, may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
    return named or tempfile.mkdtemp(prefix="kgloom-")


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` into the session's shared checkpoint folder and reads it from there. Spark removes what is no longer used if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is true."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """``cut`` for a frame that was repartitioned by keys: joins and aggregates on these then leave it where it is. An adaptive plan's parts
    aren't known beforehand, so that Spark would shuffle what was read back from one."""
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    was = conf.get(name)
    conf.set(name, "false")
    try:
        return cut(df.select("*"))  # planned anew, without it
    finally:
        conf.set(name, was)


def dealt(rows: int, *sides: tuple[DataFrame, list[str]], each: int = 500_000) -> list[DataFrame]:
    """Frames by the keys they are joined on, in one number of parts, so that a part has about ``each`` of the ``rows`` of the largest.

    Spark joins parts by their compressed bytes, of which ids in order have about one a row: tens of millions of them would be sorted in one task.
    """
    n = max(1, -(-rows // each))
    return [df.repartition(n, *keys) for df, keys in sides]


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``df`` but for the rows whose ``key`` is in ``keys`` (each key once). An anti join would be pushed into each part of a union,
    all of which a task then runs at once, each with its own copy of ``keys``."""
    return df.join(keys.select(key, F.lit(True).alias("_out")), key, "left").filter("_out IS NULL").select(*df.columns)
