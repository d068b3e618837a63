"""The knowledge graph's frames, made from the driver's tables; ``SQL`` has the same frames for DuckDB.

nodes: id, name, node_type, entity_class, domain, mention_count; edges: id, src, dst, rel_type, weight, confidence,
valid_from, invalid, synthetic; sources: id, uri, title, source_type, domains, content, content_hash; chunks: id,
source_id, ordinal, content; extractions: chunk_id, entity_id, confidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE_TYPES = ("document", "web_page", "conversation", "code", "api", "manual", "tool_output", "observation")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem")

    def kind(df, key, n, name, node_type, entity_class, domain, mentions):
        return df.select((F.col(key).cast("long") * 10 + n).alias("id"), F.col(name).alias("name"), F.lit(node_type).alias("node_type"), F.lit(entity_class).alias("entity_class"), domain.alias("domain"), mentions.cast("long").alias("mention_count"))

    counted = lambda df, key, line: df.join(lines.groupBy(F.col(line).alias(key)).agg(F.count("*").alias("n")), key, "left")
    n, one = F.coalesce("n", F.lit(0)), F.lit(1)
    out = [
        kind(counted(t("part"), "p_partkey", "l_partkey"), "p_partkey", 1, "p_name", "technology", "domain", F.lower("p_brand"), n),
        kind(counted(t("supplier"), "s_suppkey", "l_suppkey"), "s_suppkey", 2, "s_name", "organization", "actor", F.lit("supply"), n),
        kind(t("customer"), "c_custkey", 3, "c_name", "person", "actor", F.lower("c_mktsegment"), one),
        kind(t("nation"), "n_nationkey", 4, "n_name", "location", "actor", F.lit("geo"), one),
        kind(t("region"), "r_regionkey", 5, "r_name", "component", "analysis", F.lit("geo"), one),
    ]
    first, *rest = out
    for x in rest:
        first = first.unionByName(x)
    return first


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    line = t("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_suppkey") * 10 + 2).alias("src"), (F.col("l_partkey") * 10 + 1).alias("dst"),
        F.when(F.col("l_linestatus") == "O", "supplies").otherwise("delivered").alias("rel_type"), (F.col("l_quantity") / 50).alias("weight"), (1 - F.col("l_discount")).alias("confidence"),
        F.col("l_shipdate").alias("valid_from"), (F.col("l_returnflag") == "R").alias("invalid"), F.lit(False).alias("synthetic"),
    )

    def fixed(name, key, n, to, m, rel):
        src, dst = (F.col(key).cast("long") * 10 + n).alias("src"), (F.col(to).cast("long") * 10 + m).alias("dst")
        return t(name).select((-(F.col(key).cast("long") * 10 + n)).alias("id"), src, dst, F.lit(rel).alias("rel_type"), F.lit(1.0).alias("weight"), F.lit(1.0).alias("confidence"), F.lit(None).cast("timestamp_ntz").alias("valid_from"), F.lit(False).alias("invalid"), F.lit(False).alias("synthetic"))

    return line.unionByName(fixed("supplier", "s_suppkey", 2, "s_nationkey", 4, "located_in")).unionByName(fixed("customer", "c_custkey", 3, "c_nationkey", 4, "located_in")).unionByName(fixed("nation", "n_nationkey", 4, "n_regionkey", 5, "part_of"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, SOURCE_TYPES))
    kind = F.element_at(kinds, (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("https://"), "source", F.lit(".example/"), F.substring(F.sha2("text", 256), 1, 8)).alias("uri"), F.col("source").alias("title"), kind.alias("source_type"),
        F.array("lang", F.when(kind == "code", "code").otherwise("text")).alias("domains"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for each line with text."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "content"))
    return lines.filter(F.trim("content") != "").select((F.col("doc_id") * 100_000 + F.col("ordinal")).alias("id"), F.col("doc_id").alias("source_id"), F.col("ordinal").cast("long").alias("ordinal"), "content")


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), (F.col("l_partkey") * 10 + 1).alias("entity_id"), (1 - F.col("l_discount")).alias("confidence"))


_TYPES = "[" + ", ".join(f"'{x}'" for x in SOURCE_TYPES) + "]"
SQL = f"""
nodes AS (
  SELECT p_partkey * 10 + 1 AS id, p_name AS name, 'technology' AS node_type, 'domain' AS entity_class, lower(p_brand) AS domain, coalesce(n, 0) AS mention_count
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey
  UNION ALL SELECT s_suppkey * 10 + 2, s_name, 'organization', 'actor', 'supply', coalesce(n, 0) FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey
  UNION ALL SELECT c_custkey * 10 + 3, c_name, 'person', 'actor', lower(c_mktsegment), 1 FROM customer
  UNION ALL SELECT n_nationkey::BIGINT * 10 + 4, n_name, 'location', 'actor', 'geo', 1 FROM nation
  UNION ALL SELECT r_regionkey::BIGINT * 10 + 5, r_name, 'component', 'analysis', 'geo', 1 FROM region),
edges AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey * 10 + 2 AS src, l_partkey * 10 + 1 AS dst, CASE l_linestatus WHEN 'O' THEN 'supplies' ELSE 'delivered' END AS rel_type,
         l_quantity / 50 AS weight, 1 - l_discount AS confidence, l_shipdate AS valid_from, l_returnflag = 'R' AS invalid, false AS synthetic FROM lineitem
  UNION ALL SELECT -(s_suppkey * 10 + 2), s_suppkey * 10 + 2, s_nationkey * 10 + 4, 'located_in', 1, 1, NULL, false, false FROM supplier
  UNION ALL SELECT -(c_custkey * 10 + 3), c_custkey * 10 + 3, c_nationkey * 10 + 4, 'located_in', 1, 1, NULL, false, false FROM customer
  UNION ALL SELECT -(n_nationkey::BIGINT * 10 + 4), n_nationkey::BIGINT * 10 + 4, n_regionkey::BIGINT * 10 + 5, 'part_of', 1, 1, NULL, false, false FROM nation),
sources AS (
  SELECT doc_id AS id, 'https://' || source || '.example/' || sha256(text)[1:8] AS uri, source AS title, {_TYPES}[doc_id % 8 + 1] AS source_type,
         [lang, CASE WHEN doc_id % 8 = 3 THEN 'code' ELSE 'text' END] AS domains, text AS content, sha256(text) AS content_hash FROM documents),
chunks AS (
  SELECT doc_id * 100000 + i - 1 AS id, doc_id AS source_id, i - 1 AS ordinal, content
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE trim(content) <> ''),
extractions AS (SELECT l_orderkey AS chunk_id, l_partkey * 10 + 1 AS entity_id, 1 - l_discount AS confidence FROM lineitem)
"""
