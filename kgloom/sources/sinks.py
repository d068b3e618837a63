"""Where frames go: appended tables without repeats, replaced parts, audit rows, and figures of a run."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def appended(df: DataFrame, path: str, key: str, partition: list[str] | None = None) -> None:
    """Appends the rows of ``df`` whose ``key`` isn't in the table at ``path`` yet, one for each key; makes the table if it isn't there."""
    spark = df.sparkSession
    new = df.dropDuplicates([key])
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti").select(*df.columns)
    writer = new.write.mode("append")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def replaced(df: DataFrame, path: str, by: str) -> None:
    """Writes ``df`` partitioned by ``by`` over those partitions of the table that it has, and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def audited(rows: DataFrame, actor: str, now: Column) -> DataFrame:
    """Audit rows (target, action, changes) with who and when, to be appended."""
    return rows.select("target", "action", "changes", F.lit(actor).alias("actor"), now.alias("at"))


def recent(audit: DataFrame, limit: int = 50) -> DataFrame:
    return audit.orderBy(F.desc("at"), "target", "action").limit(limit)


def counted(df: DataFrame, name: str, labels: list[str]) -> tuple[DataFrame, Observation]:
    """``df`` with counters that Spark fills as it is computed: rows, and rows for each null or true value of ``labels``; no second pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(x).isNull()).alias(f"{x}_null") for x in labels)), seen


def exposition(name: str, figures: dict[str, float]) -> str:
    """Figures as lines of the text format that monitoring systems scrape."""
    return "".join(f"# TYPE {name}_{k} gauge\n{name}_{k} {v}\n" for k, v in sorted(figures.items()))


def ontology(spark: SparkSession, manifests: DataFrame) -> DataFrame:
    """kind, name, properties of all manifests (path, text as JSON): entity types, relation types, domains and views; a name that several declare
    is the last one's by path, as a later extension overrides an earlier one."""
    kinds = ("entity_types", "relation_types", "domains", "views")
    one = lambda k: F.transform(F.from_json(F.get_json_object("text", f"$.{k}"), "array<map<string,string>>"), lambda x: F.struct(F.lit(k).alias("kind"), x["name"].alias("name"), F.to_json(x).alias("properties")))
    every = F.flatten(F.array(*(F.coalesce(one(k), F.expr("cast(array() as array<struct<kind:string,name:string,properties:string>>)")) for k in kinds)))
    rows = manifests.select("path", F.explode(every).alias("x")).select("path", "x.*").filter("name IS NOT NULL")
    return rows.groupBy("kind", "name").agg(F.max_by("properties", "path").alias("properties"))


def settings(defaults: dict, stored: DataFrame) -> dict:
    """The configuration: ``defaults`` with what the table (key, value as JSON) has for their keys; a small table, read when it is asked for."""
    found = {r["key"]: json.loads(r["value"]) for r in stored.filter(F.col("key").isin(*defaults)).collect()}
    return defaults | found
