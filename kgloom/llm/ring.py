"""Operator 4: a consistent-hash ring with virtual nodes and bounded loads, in SQL expressions only.

The ring has ``POINTS`` points. Each shard stands at ``VIRTUAL`` of them; a document's id names a point, and its shard
is the next one clockwise. Loads are bounded by law ``rows``: shard s takes n div shards rows, and one more if s is
below n mod shards. Documents are let in clockwise; those that overflow a full shard go on to the next shard
on the ring that has room. As the bounds add up to n, all shards are full in the end: counts are at most one apart.

The fill is worked out on the ring, not on rows: from the row count of each point, one fold over the ring's arcs
gives for each arc a few segments (from, to, shard, slot). Its size hangs on the ring alone, at any size of the input. A
row then needs its rank at its own point, a window over 1/POINTS of the rows, and the point's segments, which are
broadcast: at most POINTS + arcs * shards of them. Rows are spread by their ids' hash, so that a source or a text with very
many rows is no hot point; this method has no groups, equal texts go wherever their ids go.

Defined results: a null text has size 1 and checksum 0; rows without doc_id are spread by size and checksum; repeated
rows each take a slot; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

SHARDS, VIRTUAL, POINTS = 16, 64, 1 << 14


def point(key: Column, points: int = POINTS) -> Column:
    return F.pmod(key, F.lit(points)).cast("int")


def arcs(spark: SparkSession, shards: int, virtual: int, points: int) -> DataFrame:
    """arc, start, stop (its points: start < p <= stop, or p > start or p <= stop in the arc over the end), shards (each once, clockwise)."""
    nodes = spark.range(0, shards * virtual, 1, 1).select((F.col("id") % shards).cast("int").alias("shard"), (F.col("id") / shards).cast("int").alias("n"))
    at = nodes.groupBy(point(F.xxhash64(F.lit("shard"), "shard", "n"), points).alias("p")).agg(F.min("shard").alias("shard"))
    ring = at.agg(F.sort_array(F.collect_list(F.struct("p", "shard"))).alias("ring"))
    one = ring.select("ring", F.posexplode("ring").alias("arc", "node"))
    order = F.transform("ring", lambda x: x["shard"])
    turned = F.array_distinct(F.concat(F.slice(order, F.col("arc") + 1, F.size(order)), F.slice(order, 1, F.size(order))))
    before = F.when(F.col("arc") > 0, F.element_at("ring", F.col("arc"))["p"]).otherwise(F.element_at("ring", -1)["p"])
    return one.select("arc", before.alias("start"), F.col("node.p").alias("stop"), turned.alias("shards"))


def _fill(parts: Column, bounds: Column) -> Column:
    """Segments (arc, from, to, shard, slot, hops), from arcs (arc, n, shards) in order and the shards' bounds."""
    segments = F.expr("cast(array() as array<struct<arc:int,from:long,to:long,shard:int,slot:long,hops:int>>)")
    state = lambda used, found: F.struct(used.alias("used"), found.alias("found"))

    def arc(acc: Column, a: Column) -> Column:
        def shard(x: Column, s: Column) -> Column:
            used = F.element_at(x["used"], s + 1)
            take = F.least(a["n"] - x["done"], F.element_at(bounds, s + 1) - used)
            new = F.struct(a["arc"].alias("arc"), x["done"].alias("from"), (x["done"] + take).alias("to"), s.alias("shard"), used.alias("slot"), x["hops"].alias("hops"))
            go = F.struct(
                (x["done"] + take).alias("done"), (x["hops"] + 1).alias("hops"),
                F.transform(x["used"], lambda v, k: F.when(k == s, v + take).otherwise(v)).alias("used"), F.concat(x["found"], F.array(new)).alias("found"),
            )
            skip = F.struct(x["done"].alias("done"), (x["hops"] + 1).alias("hops"), x["used"].alias("used"), x["found"].alias("found"))
            return F.when(take > 0, go).otherwise(skip)

        zero = F.struct(F.lit(0).cast("long").alias("done"), F.lit(0).alias("hops"), acc["used"].alias("used"), acc["found"].alias("found"))
        return F.when(a["n"] > 0, F.aggregate(a["shards"], zero, shard, lambda x: state(x["used"], x["found"]))).otherwise(acc)

    used = F.transform(bounds, lambda _: F.lit(0).cast("long"))
    return F.aggregate(parts, state(used, segments), arc, lambda acc: acc["found"])


def place(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, points: int = POINTS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, hops (full shards passed by): one row for each row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    figures = docs.select(F.col("doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("size", "text_crc32")).otherwise(F.xxhash64("doc_id"))
    rows = cut(figures.withColumn("point", point(key, points)).withColumn("mix", F.xxhash64(F.lit("rank"), "doc_id", "size", "text_crc32")))
    counts = rows.groupBy("point").agg(F.count("*").alias("n"))
    ring = arcs(spark, shards, virtual, points)
    # Points are integers: the arc over the end is cut in two, and each arc lists its points, POINTS in all.
    listed = F.when(F.col("start") < F.col("stop"), F.sequence(F.col("start") + 1, "stop")).otherwise(
        F.concat(F.filter(F.sequence(F.col("start") + 1, F.lit(points)), lambda p: p < points), F.sequence(F.lit(0), "stop"))
    )
    of_point = cut(ring.select("arc", F.posexplode(listed).alias("k", "point")).join(F.broadcast(counts), "point").select("arc", "point", "n", F.expr("sum(n) OVER (PARTITION BY arc ORDER BY k) - n").alias("before")), points)
    of_arc = of_point.groupBy("arc").agg(F.sum("n").alias("n")).join(ring.select("arc", "shards"), "arc")
    one = of_arc.agg(F.sort_array(F.collect_list(F.struct("arc", "n", "shards"))).alias("parts"), F.sum("n").alias("total"))
    bounds = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.expr(f"total div {shards}") + F.when(s < F.col("total") % shards, 1).otherwise(0))
    segments = one.withColumn("bounds", bounds).filter("total > 0").select(F.inline(_fill(F.col("parts"), F.col("bounds"))))
    s = segments.withColumnsRenamed({"from": "s_from", "to": "s_to"})
    met = of_point.join(s, "arc").filter("s_from < before + n AND s_to > before")
    of_point = met.groupBy("point").agg(F.collect_list(F.struct((F.col("s_from") - F.col("before")).alias("begin"), (F.col("s_to") - F.col("before")).alias("stop"), "shard", "slot", "hops")).alias("segments"))
    ranked = rows.withColumn("rank", F.expr("row_number() OVER (PARTITION BY point ORDER BY mix, doc_id, size, text_crc32) - 1L"))
    rank = F.col("rank")
    found = F.filter("segments", lambda x: (x["begin"] <= rank) & (rank < x["stop"])).getItem(0)
    out = ranked.join(F.broadcast(of_point), "point").select("doc_id", "size", "text_crc32", "rank", found.alias("at"))
    return out.select("doc_id", "size", "text_crc32", "at.shard", (F.col("at.slot") + F.col("rank") - F.col("at.begin")).alias("slot"), "at.hops")


def op4_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = place(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hops")
