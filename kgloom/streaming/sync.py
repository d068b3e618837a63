"""Incremental change: applying a change log, the job queue's states, triggers. Batch functions, and their streaming form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def after(log: DataFrame, seq: int, limit: int = 1000) -> DataFrame:
    """The next page of a change log."""
    return log.filter(F.col("seq_id") > seq).orderBy("seq_id").limit(limit)


def last_changes(log: DataFrame, key: str = "entity_id") -> DataFrame:
    """The last change of each key by seq_id: the last write wins, in any order of arrival."""
    cols = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*cols), "seq_id").alias("r")).select(key, "r.*")


def applied(state: DataFrame, log: DataFrame, key: str = "entity_id") -> DataFrame:
    """``state`` after ``log`` (same columns; op 'delete', or an invalid row, removes). Idempotent: a change at or before a key's seq_id is ignored."""
    both = state.unionByName(log)
    return last_changes(both, key)


def live(state: DataFrame) -> DataFrame:
    return state.filter(F.col("op") != "delete")


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the complete tables in ``folder``, from its names: so a restart knows what a run before it has written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [(x.getPath().getName(), x.getPath()) for x in fs.listStatus(path)]
    return sorted(int(n) for n, at in names if n.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")))


def synced(spark: SparkSession, base: str, key: str = "entity_id") -> DataFrame:
    """The table that ``sync`` keeps in ``base``: the last merged version and the changes since, the last of each key."""
    merged = _versions(spark, f"{base}/merged")[-1:]
    since = [n for n in _versions(spark, f"{base}/changes") if not merged or n > merged[0]]
    paths = [f"{base}/merged/{n}" for n in merged] + [f"{base}/changes/{n}" for n in since]
    if not paths:
        raise ValueError("the stream has held no changes yet")
    return last_changes(spark.read.parquet(*paths), key)


def sync(spark: SparkSession, stream: DataFrame, base: str, key: str = "entity_id", merge_every: int = 20, quiet: str | None = None) -> None:
    """Applies a stream of changes to the table in ``base``, a shared folder: all there is, or with ``quiet`` (such as '10 seconds') on and on.

    A micro-batch writes only its own last changes, under its number, so that it costs what it holds and a repeated batch gives the same.
    Each ``merge_every`` batches they are merged with the version before. What is complete is told from the folder, so that a
    restarted run goes on from there; the stream's own log is in ``base`` too.
    """

    def step(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        last_changes(batch, key).write.mode("overwrite").parquet(f"{base}/changes/{number}")
        if (number + 1) % merge_every == 0:
            synced(s, base, key).write.mode("overwrite").parquet(f"{base}/merged/{number}")

    run = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/log")
    (run.trigger(processingTime=quiet) if quiet else run.trigger(availableNow=True)).start().awaitTermination()


def claimed(jobs: DataFrame, now: Column, limit: int) -> DataFrame:
    """The next pending jobs that are due, by due time, then id."""
    return jobs.filter((F.col("status") == "pending") & (F.col("next_due") <= now)).orderBy("next_due", "id").limit(limit)


def transition(status: Column, event: Column, attempt: Column, most: Column) -> Column:
    """The state after an event: claim, succeed, fail, resurrect, recover. Others leave it."""
    return (
        F.when((status == "pending") & (event == "claim"), "running")
        .when((status == "running") & (event == "succeed"), "succeeded")
        .when((status == "running") & (event == "fail"), F.when(attempt >= most, "dead").otherwise("pending"))
        .when((status == "running") & (event == "recover"), "pending")
        .when((status == "dead") & (event == "resurrect"), "pending")
        .otherwise(status)
    )


def enqueued(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` jobs whose idempotency key isn't in the queue; of equal keys the first id."""
    once = new.groupBy("idempotency_key").agg(F.min_by(F.struct(*(c for c in new.columns if c != "idempotency_key")), "id").alias("r")).select("idempotency_key", "r.*")
    return once.join(jobs.select("idempotency_key").distinct(), "idempotency_key", "left_anti").select(*new.columns)


def fan_in(jobs: DataFrame) -> DataFrame:
    """source_id, state: sources none of whose jobs is pending or running go on; partial if one is dead."""
    g = jobs.groupBy("source_id").agg(F.count_if(F.col("status").isin("pending", "running")).alias("open"), F.count_if(F.col("status") == "dead").alias("dead"))
    return g.filter("open = 0").select("source_id", F.when(F.col("dead") > 0, "partial").otherwise("complete").alias("state"))


def stalled(sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """Sources with a summary and no open compose job."""
    busy = jobs.filter((F.col("kind") == "compose") & F.col("status").isin("pending", "running")).select(F.get_json_object("payload", "$.source_id").cast("long").alias("id"))
    return sources.join(busy, "id", "left_anti")


def triggered(deltas: DataFrame, interval: int, threshold: float, accumulated: float) -> DataFrame:
    """Adds fires: seconds since the last change over the interval, a delta over the threshold, or a running sum over ``accumulated``, by topic.

    A topic may hold a third of all changes: sums and last times are taken by hour first, so that a window is over an hour of a topic.
    """
    d = deltas.withColumns({"_at": F.unix_micros(F.col("ts").cast("timestamp")), "_hour": F.date_trunc("hour", "ts")})
    inside, before = Window.partitionBy("topic", "_hour").orderBy("_at", "id"), Window.partitionBy("topic").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = d.groupBy("topic", "_hour").agg(F.sum("delta").alias("_sum"), F.max("_at").alias("_last"))
    hours = hours.select("topic", "_hour", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_base"), F.max("_last").over(before).alias("_prev"))
    d = d.withColumns({"total": F.sum("delta").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_lag": F.lag("_at").over(inside)}).join(hours, ["topic", "_hour"])
    d = d.withColumns({"total": F.col("total") + F.col("_base"), "elapsed": (F.col("_at") - F.coalesce("_lag", "_prev")) / 1e6})
    fires = (F.coalesce("elapsed", F.lit(0.0)) >= interval) | (F.col("delta") > threshold) | (F.col("total") > accumulated)
    return d.withColumn("fires", fires).drop("_at", "_hour", "_lag", "_base", "_prev")


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Event counts of tumbling windows; on a stream, late rows beyond the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
