"""Queries on expressions, ranked lists and relational analyses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import opinion as O
from ..functions import text as T
from ..functions import vector as V
from ..operators import fusion, graph, relational
from ..sources import kgview as kg
from .registry import query

WITH = "WITH " + kg.SQL
NOW = "2024-01-31 00:00:00"


def vectors(spark, sf):
    return kg.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def probe(spark, sf):
    return list(vectors(spark, sf).filter("id = 0").first()["embedding"])


def lists(spark, sf):
    """Three dimensions over ids: vectors near vector 0, recent orders, parts of many lines."""
    v = relational.top_vectors(vectors(spark, sf), probe(spark, sf), 50).withColumn("dimension", F.lit("vector"))
    days = F.datediff(F.lit("2001-01-01").cast("date"), F.col("o_orderdate").cast("date"))
    t = fusion.top(kg.table(spark, sf, "orders").select((F.col("o_orderkey") % 500).alias("id"), (1 / (1 + F.greatest(days, F.lit(0)))).alias("score")).groupBy("id").agg(F.max("score").alias("score")), 50, F.desc("score"), "id").withColumn("dimension", F.lit("temporal"))
    n = kg.table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 500).alias("id")).agg(F.count("*").cast("double").alias("score"))
    s = fusion.top(n, 50, F.desc("score"), "id").withColumn("dimension", F.lit("structural"))
    return v.unionByName(t).unionByName(s)


LISTS = """
q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0),
lists AS (
  SELECT 'vector' AS dimension, id, score FROM (SELECT * FROM (SELECT vec_id AS id, greatest(1 - greatest(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)), 0), 0) AS score FROM embeddings) ORDER BY round(score, 12) DESC, id LIMIT 50)
  UNION ALL SELECT 'temporal', id, score FROM (SELECT o_orderkey % 500 AS id, max(1 / (1 + greatest(date_diff('day', o_orderdate::DATE, DATE '2001-01-01'), 0))) AS score FROM orders GROUP BY 1 ORDER BY score DESC, id LIMIT 50)
  UNION ALL SELECT 'structural', id, score FROM (SELECT l_partkey % 500 AS id, count(*)::DOUBLE AS score FROM lineitem GROUP BY 1 ORDER BY score DESC, id LIMIT 50)),
weights(dimension, w) AS (VALUES ('vector', 0.28::DOUBLE), ('lexical', 0.22), ('temporal', 0.13), ('graph', 0.18), ('structural', 0.09), ('global', 0.10)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY score DESC, id) AS rank FROM lists)
"""


@query("rrf_search", f"WITH {LISTS} SELECT id, round(sum(w / (60 + rank)), 9) AS score FROM ranked JOIN weights USING (dimension) GROUP BY id ORDER BY score DESC, id LIMIT 20")
def rrf_search(spark, sf):
    out = fusion.rrf(fusion.ranked(lists(spark, sf))).select("id", F.round("score", 9).alias("score"))
    return fusion.top(out, 20, F.desc("score"), "id")


@query("dimension_ranking", f"WITH {LISTS} SELECT dimension, id, round(score, 9) AS score, rank FROM ranked")
def dimension_ranking(spark, sf):
    return fusion.ranked(lists(spark, sf)).select("dimension", "id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("convex_fusion", f"""WITH {LISTS}, n AS (SELECT *, min(score) OVER (PARTITION BY dimension) lo, max(score) OVER (PARTITION BY dimension) hi FROM lists),
m AS (SELECT dimension, id, CASE WHEN hi - lo <= 1e-12 THEN 1 ELSE (score - lo) / (hi - lo) END AS norm FROM n)
SELECT id, round(sum(w * norm) * (0.5 + 0.5 * count(DISTINCT dimension) / (SELECT count(DISTINCT dimension) FROM lists)), 8) AS score FROM m JOIN weights USING (dimension) GROUP BY id""")
def convex_fusion(spark, sf):
    return fusion.convex(lists(spark, sf)).select("id", F.round("score", 8).alias("score"))


@query("quality_gate", f"""WITH {LISTS}, s AS (SELECT dimension, (max(score) - min(score)) / max(score) AS spread FROM lists GROUP BY dimension),
k AS (SELECT dimension, spread, w * least(spread / 0.05, 1) AS kept FROM s JOIN weights USING (dimension))
SELECT dimension, round(spread, 8) AS spread, round(kept / (SELECT sum(kept) FROM k), 8) AS weight FROM k""")
def quality_gate(spark, sf):
    return fusion.gate(lists(spark, sf)).select("dimension", F.round("spread", 8).alias("spread"), F.round("weight", 8).alias("weight"))


GINI = """g AS (SELECT g, i, score, count(*) OVER (PARTITION BY g) AS n, sum(score) OVER (PARTITION BY g) AS total FROM (
  SELECT l_suppkey AS g, l_extendedprice AS score, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS i FROM lineitem)),
r AS (SELECT g, n, 2 * sum(i * score) / (n * any_value(total)) - (n + 1) / n AS gini FROM g GROUP BY g, n)"""


@query("gini_route", f"WITH {GINI} SELECT g, n, round(gini, 6) AS gini, CASE WHEN n < 5 THEN 'balanced' WHEN gini > 0.5 THEN 'precise' WHEN gini < 0.15 THEN 'global' ELSE 'balanced' END AS strategy FROM r")
def gini_route(spark, sf):
    s = kg.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_extendedprice").alias("score"))
    return fusion.route(fusion.gini(s, "g")).select("g", "n", F.round("gini", 6).alias("gini"), "strategy")


@query("abstention", f"WITH {LISTS} SELECT count(*) = 0 OR count(*) < 3 OR max(score) < 0.9 AS abstain, count(*) AS n_results FROM lists WHERE dimension = 'vector' AND id > 0")
def abstention(spark, sf):
    return fusion.abstains(lists(spark, sf).filter("dimension = 'vector' AND id > 0"), 3, 0.9)


@query("strategy_weights", "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{d}', round({w}::DOUBLE, 9))" for s, ws in fusion.STRATEGIES.items() for d, w in zip(fusion.DIMENSIONS, ws, strict=True)) + ") AS t(strategy, dimension, weight)")
def strategy_weights(spark, sf):
    rows = spark.range(1).select(F.explode(F.lit(list(fusion.DIMENSIONS))).alias("dimension"))
    first, *rest = [rows.select(F.lit(s).alias("strategy"), "dimension", F.round(fusion.weight_of(F.col("dimension"), s), 9).alias("weight")) for s in fusion.STRATEGIES]
    for x in rest:
        first = first.unionByName(x)
    return first


RESULTS = """r AS (SELECT n.id, name, node_type AS nt, CASE WHEN id % 3 = 0 THEN 'chunk' ELSE 'node' END AS result_type, id % 4 AS dims, id % 7 = 0 AS named,
  CASE WHEN id % 5 = 0 THEN NULL ELSE (id % 100) / 100 END AS confidence, 1 / (1 + mention_count) AS score, CASE WHEN id % 2 = 0 THEN 'code' ELSE 'document' END AS source_type FROM nodes n)"""


def results(spark, sf):
    c = F.col("id")
    return kg.nodes(spark, sf).select("id", "name", F.col("node_type").alias("nt"), F.when(c % 3 == 0, "chunk").otherwise("node").alias("result_type"), (c % 4).alias("dims"), (c % 7 == 0).alias("named"), F.when(c % 5 != 0, (c % 100) / 100).alias("confidence"), (1 / (1 + F.col("mention_count"))).alias("score"), F.when(c % 2 == 0, "code").otherwise("document").alias("source_type"))


@query("score_adjustments", f"""{WITH}, {RESULTS}
SELECT id, round(score * CASE WHEN result_type = 'node' AND NOT named THEN CASE WHEN dims <= 1 THEN 0.3 WHEN dims = 2 THEN 0.5 ELSE 0.7 END ELSE 1 END, 9) AS demoted,
  round(score * CASE WHEN result_type <> 'node' AND source_type = 'code' THEN 0.5 ELSE 1 END, 9) AS code_demoted,
  round(CASE WHEN confidence IS NULL THEN score ELSE score * (1 + 0.3 * (confidence - 0.5)) END, 9) AS boosted, round(0.6 * score + 0.4 * coalesce(confidence / 0.99, 0), 9) AS blended FROM r""")
def score_adjustments(spark, sf):
    s = F.col("score")
    r = results(spark, sf)
    return r.select("id", F.round(fusion.demoted(s, F.col("result_type"), F.col("dims"), F.col("named")), 9).alias("demoted"), F.round(fusion.code_demoted(s, F.col("result_type"), F.col("source_type")), 9).alias("code_demoted"), F.round(fusion.boosted(s, F.col("confidence")), 9).alias("boosted"), F.round(fusion.blended(s, F.col("confidence"), F.lit(0.99)), 9).alias("blended"))


@query("post_filters", f"{WITH}, {RESULTS} SELECT id FROM r WHERE confidence >= 0.3 AND nt IN ('technology', 'person') AND source_type IN ('document')")
def post_filters(spark, sf):
    return fusion.post_filters(results(spark, sf).withColumnRenamed("nt", "node_type"), 0.3, ["technology", "person"], None, ["document"]).select("id")


@query("rank_nodes_last", f"{WITH}, {RESULTS} SELECT id, row_number() OVER (PARTITION BY source_type ORDER BY result_type = 'node', score DESC, id) AS rank FROM r")
def rank_nodes_last(spark, sf):
    return fusion.nodes_last(results(spark, sf).withColumn("dimension", F.col("source_type"))).select("id", F.col("rank").cast("long").alias("rank"))


CHUNKS = "c AS (SELECT id, title AS uri, content, 1 / (1 + id % 97) AS score FROM sources)"


@query("diversification", f"""{WITH}, {CHUNKS}, a AS (SELECT *, row_number() OVER (PARTITION BY uri, content[1:100] ORDER BY score DESC, id) n FROM c),
b AS (SELECT id, uri, content, score, row_number() OVER (PARTITION BY content[1:100] ORDER BY score DESC, id) n FROM a WHERE n = 1),
d AS (SELECT id, uri, score, row_number() OVER (PARTITION BY uri ORDER BY score DESC, id) n FROM b WHERE n = 1) SELECT id, uri FROM d WHERE n <= 2""")
def diversification(spark, sf):
    c = kg.sources(spark, sf).select("id", F.col("title").alias("uri"), "content", (1 / (1 + F.col("id") % 97)).alias("score"))
    return fusion.diversified(c).select("id", "uri")


@query("context_budget", f"""{WITH}, {CHUNKS}, p AS (SELECT *, ceil(strlen(content) / 4)::BIGINT AS tokens, row_number() OVER (PARTITION BY uri ORDER BY score DESC, id) n FROM c),
u AS (SELECT id, uri, sum(tokens) OVER (PARTITION BY uri ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM p WHERE n <= 30) SELECT id, uri, used FROM u WHERE used <= 8000""")
def context_budget(spark, sf):
    c = kg.sources(spark, sf).select("id", F.col("title").alias("uri"), F.col("title").alias("source"), fusion.token_count(F.col("content")).alias("tokens"), (1 / (1 + F.col("id") % 97)).alias("score"))
    return fusion.within_budget(fusion.per_source(c, 30), "uri").select("id", "uri", "used")


@query("vector_topk", "SELECT vec_id AS id, round(greatest(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 0), 9) AS score FROM embeddings ORDER BY score DESC, id LIMIT 25")
def vector_topk(spark, sf):
    return relational.top_vectors(vectors(spark, sf), probe(spark, sf), 25).select("id", F.round("score", 9).alias("score"))


@query("matryoshka", "SELECT vec_id AS id, round(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE ^ 2)) / nullif(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE ^ 2)), 0), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE ^ 2))), 6) AS x FROM embeddings")
def matryoshka(spark, sf):
    v = vectors(spark, sf).select("id", V.truncated(F.col("embedding"), 16).alias("v"))
    return v.select("id", F.round(V.norm(F.col("v")), 6).alias("norm"), F.round(F.get("v", F.lit(0)), 6).alias("x"))


@query("close_pairs", "SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(greatest(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0), 6) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id WHERE 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) < 0.8")
def close_pairs(spark, sf):
    v = vectors(spark, sf)
    return relational.close_pairs(v.filter("id % 50 = 0"), v, 0.8).filter("left_id <> right_id").withColumn("distance", F.round("distance", 6))


@query("nearest_concept", "SELECT a.vec_id AS left_id, arg_min(b.vec_id, {'d': round(greatest(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0), 12), 'r': b.vec_id}) AS right_id, round(min(greatest(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0)), 6) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND b.vec_id % 50 <> 0 GROUP BY 1")
def nearest_concept(spark, sf):
    v = vectors(spark, sf)
    return relational.nearest(v.filter("id % 50 = 0"), v.filter("id % 50 <> 0")).withColumn("distance", F.round("distance", 6))


@query("sources_page", f"{WITH} SELECT id, title FROM sources ORDER BY id LIMIT 20 OFFSET 40")
def sources_page(spark, sf):
    return relational.page(kg.sources(spark, sf), 40, 20, "id").select("id", "title")


@query("point_lookup", f"{WITH} SELECT id, name, node_type FROM nodes WHERE id IN (11, 12, 13, 14, 15)")
def point_lookup(spark, sf):
    return relational.by_ids(kg.nodes(spark, sf), [11, 12, 13, 14, 15]).select("id", "name", "node_type")


@query("hash_dedup", f"{WITH} SELECT id FROM sources WHERE content_hash NOT IN (SELECT content_hash FROM sources WHERE source_type = 'code')")
def hash_dedup(spark, sf):
    s = kg.sources(spark, sf)
    return relational.unseen(s, s.filter("source_type = 'code'")).select("id")


@query("provenance_chain", f"{WITH}, c AS (SELECT o_orderkey AS id, o_custkey % 200 AS source_id FROM orders) SELECT DISTINCT entity_id, uri, title FROM extractions e JOIN c ON c.id = e.chunk_id JOIN sources s ON s.id = c.source_id")
def provenance_chain(spark, sf):
    c = kg.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 200).alias("source_id"))
    return relational.provenance(kg.extractions(spark, sf), c, kg.sources(spark, sf))


@query("provenance_triples", f"{WITH} SELECT s.name AS subject, rel_type AS predicate, o.name AS object, round(max(confidence), 6) AS confidence, count(*) AS n FROM edges JOIN nodes s ON src = s.id JOIN nodes o ON dst = o.id WHERE NOT invalid GROUP BY ALL")
def provenance_triples(spark, sf):
    t = relational.triples(kg.edges(spark, sf), kg.nodes(spark, sf))
    return t.groupBy("subject", "predicate", "object").agg(F.round(F.max("confidence"), 6).alias("confidence"), F.count("*").alias("n"))


@query("orphan_nodes", f"{WITH} SELECT id, name FROM nodes WHERE node_type = 'technology' AND id NOT IN (SELECT dst FROM edges WHERE NOT invalid AND rel_type = 'supplies')")
def orphan_nodes(spark, sf):
    return relational.without_edge(kg.nodes(spark, sf).filter("node_type = 'technology'"), kg.edges(spark, sf), "supplies", "dst").select("id", "name")


@query("implemented_count", f"{WITH} SELECT count(DISTINCT id) AS implemented, round(count(DISTINCT id) / (SELECT count(*) FROM nodes WHERE node_type = 'technology'), 6) AS coverage FROM nodes WHERE node_type = 'technology' AND id IN (SELECT dst FROM edges WHERE NOT invalid AND rel_type = 'delivered')")
def implemented_count(spark, sf):
    n = kg.nodes(spark, sf).filter("node_type = 'technology'")
    got = relational.with_edge(n, kg.edges(spark, sf), "delivered", "dst").agg(F.countDistinct("id").alias("implemented"))
    return got.join(n.agg(F.count("*").alias("total"))).select("implemented", F.round(F.coalesce(F.try_divide("implemented", "total"), F.lit(0.0)), 6).alias("coverage"))


@query("ungrounded_nodes", f"{WITH} SELECT id FROM nodes WHERE id NOT IN (SELECT entity_id FROM extractions)")
def ungrounded_nodes(spark, sf):
    return relational.ungrounded(kg.nodes(spark, sf), kg.extractions(spark, sf)).select("id")


@query("degree_counts", f"{WITH}, d AS (SELECT src AS id, 1 AS o, 0 AS i FROM edges WHERE NOT invalid UNION ALL SELECT dst, 0, 1 FROM edges WHERE NOT invalid) SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM d GROUP BY id")
def degree_counts(spark, sf):
    return relational.degrees(kg.edges(spark, sf))


PAIRS = "x AS (SELECT DISTINCT chunk_id, entity_id FROM extractions), p AS (SELECT a.entity_id AS a, b.entity_id AS b, count(*) AS n FROM x a JOIN x b USING (chunk_id) WHERE a.entity_id < b.entity_id GROUP BY 1, 2 HAVING count(*) >= 2)"
DEGREE = "d AS (SELECT id, count(*) AS deg FROM (SELECT src AS id FROM edges WHERE NOT invalid UNION ALL SELECT dst FROM edges WHERE NOT invalid) GROUP BY 1)"


@query("cooccurrence_edges", f"{WITH}, {PAIRS}, {DEGREE} SELECT a AS src, b AS dst, n, round(least(n / 5, 1), 6) AS weight, round(least(0.3 + 0.1 * n, 0.9)::DOUBLE, 6) AS confidence FROM p LEFT JOIN d da ON da.id = a LEFT JOIN d db ON db.id = b WHERE coalesce(da.deg, 0) < 500 AND coalesce(db.deg, 0) < 500")
def cooccurrence_edges(spark, sf):
    e = kg.edges(spark, sf)
    p = relational.cooccurrence(kg.extractions(spark, sf), 2, e, relational.degrees(e), 500)
    return relational.synthetic_edges(p, "n").select("src", "dst", "n", F.round("weight", 6).alias("weight"), F.round("confidence", 6).alias("confidence"))


@query("health_report", f"""{WITH}, o AS (SELECT id FROM nodes WHERE id NOT IN (SELECT entity_id FROM extractions))
SELECT (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM sources GROUP BY uri HAVING count(*) > 1)) AS duplicate_sources, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges,
 (SELECT count(*) FROM edges WHERE invalid) AS invalid_edges, (SELECT count(*) FROM edges WHERE synthetic) AS synthetic_edges, (SELECT count(*) FROM sources) AS sources, (SELECT count(*) FROM o) AS orphan_nodes,
 (SELECT count(*) FROM o WHERE id IN (SELECT src FROM edges UNION SELECT dst FROM edges)) AS orphans_with_edges""")
def health_report(spark, sf):
    return relational.health(kg.nodes(spark, sf), kg.edges(spark, sf), kg.sources(spark, sf), kg.extractions(spark, sf))


@query("graph_stats", f"""{WITH.replace('WITH', 'WITH RECURSIVE', 1)}, near AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), c(id, root) USING KEY (id) AS (SELECT id, id FROM nodes UNION SELECT near.b, min(c.root) FROM c JOIN near ON near.a = c.id JOIN recurring.c AS k ON k.id = near.b WHERE c.root < k.root GROUP BY near.b),
n AS (SELECT count(*) AS n FROM nodes), e AS (SELECT count(*) AS e FROM edges) SELECT n AS nodes, e AS edges, 0::BIGINT AS synthetic, e AS semantic, round(e / (n * (n - 1)), 9) AS density, (SELECT count(DISTINCT root) FROM c) AS components FROM n, e""")
def graph_stats(spark, sf):
    n, e = kg.nodes(spark, sf), kg.edges(spark, sf)
    parts = graph.membership(n, e).agg(F.countDistinct("component").alias("components"))
    return relational.stats(n, e).withColumn("density", F.round("density", 9)).join(F.broadcast(parts))


@query("invalidated_by_type", f"{WITH} SELECT rel_type, count(*) AS n FROM edges WHERE invalid GROUP BY rel_type ORDER BY n DESC, rel_type LIMIT 10")
def invalidated_by_type(spark, sf):
    return fusion.top(kg.edges(spark, sf).filter("invalid").groupBy("rel_type").agg(F.count("*").alias("n")), 10, F.desc("n"), "rel_type")


@query("invalidated_by_node", f"{WITH}, u AS (SELECT src AS id FROM edges WHERE invalid UNION ALL SELECT dst FROM edges WHERE invalid) SELECT id, name, count(*) AS n FROM u JOIN nodes USING (id) GROUP BY id, name ORDER BY n DESC, id LIMIT 20")
def invalidated_by_node(spark, sf):
    n = relational.endpoints(kg.edges(spark, sf)).filter("invalid").groupBy("id").agg(F.count("*").alias("n"))
    return fusion.top(n.join(kg.nodes(spark, sf), "id").select("id", "name", "n"), 20, F.desc("n"), "id")


@query("invalidated_neighbours", f"{WITH} SELECT CASE WHEN src = 12 THEN dst ELSE src END AS other, count(*) AS n FROM edges WHERE invalid AND (src = 12 OR dst = 12) GROUP BY 1")
def invalidated_neighbours(spark, sf):
    return relational.endpoints(kg.edges(spark, sf)).filter("invalid AND id = 12").groupBy("other").agg(F.count("*").alias("n"))


@query("knowledge_gaps", f"{WITH}, g AS (SELECT id, sum(o) AS o, sum(i) AS i FROM (SELECT src AS id, 1 AS o, 0 AS i FROM edges WHERE NOT invalid UNION ALL SELECT dst, 0, 1 FROM edges WHERE NOT invalid) GROUP BY id) SELECT id, name, (i - o)::BIGINT AS gap FROM g JOIN nodes USING (id) WHERE i >= 5 AND i > o AND length(name) >= 3 AND node_type <> 'component' ORDER BY gap DESC, id LIMIT 20")
def knowledge_gaps(spark, sf):
    return relational.gaps(kg.nodes(spark, sf), kg.edges(spark, sf), 5, 3, ("component",)).select("id", "name", "gap")


@query("landmarks", f"{WITH} SELECT id, name, mention_count FROM nodes ORDER BY mention_count DESC, id LIMIT 25")
def landmarks(spark, sf):
    return fusion.top(kg.nodes(spark, sf).select("id", "name", "mention_count"), 25, F.desc("mention_count"), "id")


@query("latest_version", "SELECT o_custkey AS uri, max(o_orderdate) AS at, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS id FROM orders GROUP BY 1")
def latest_version(spark, sf):
    o = kg.table(spark, sf, "orders").select(F.col("o_custkey").alias("uri"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"))
    return relational.latest(o, "uri", "at").select("uri", "at", "id")


LIFE = "e AS (SELECT o_orderkey AS id, o_custkey AS src, 'owns' AS rel_type, o_totalprice AS dst, o_orderdate AS b, o_orderdate + INTERVAL (o_orderkey % 200) DAY AS t FROM orders)"


@query("edge_conflicts", "WITH e AS (SELECT o_orderkey AS id, o_custkey AS src, o_orderkey % 3 AS dst, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS b, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate + INTERVAL 1 DAY * (o_orderkey % 200) END AS t, o_orderkey % 7 = 0 AS invalid FROM orders), l AS (SELECT * FROM e WHERE NOT invalid AND coalesce(b < t, true)) SELECT id, src, id IN (SELECT x.id FROM l x JOIN l y ON x.src = y.src AND x.dst <> y.dst AND coalesce(x.b < y.t, true) AND coalesce(y.b < x.t, true)) AS conflict FROM e")
def edge_conflicts(spark, sf):
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    until = F.when(k % 11 != 0, F.expr("o_orderdate + make_dt_interval(o_orderkey % 200)"))
    e = kg.table(spark, sf, "orders").select(k.alias("id"), F.col("o_custkey").alias("src"), (k % 3).alias("dst"), F.lit("owns").alias("rel_type"), F.when(k % 13 != 0, at).alias("valid_from"), until.alias("valid_until"), (k % 7 == 0).alias("invalid"))
    return relational.conflicts(e).select("id", "src", "conflict")


@query("temporal_overlap", "SELECT o_orderkey AS id, (o_orderdate < TIMESTAMP '1998-01-01') AND (o_orderkey % 4 = 0 OR TIMESTAMP '1997-01-01' < o_orderdate + INTERVAL 30 DAY) AS hit FROM orders")
def temporal_overlap(spark, sf):
    until = F.expr("CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate + INTERVAL '30' DAY END")
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return kg.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), relational.overlap_in_time(F.col("o_orderdate"), until, at("1997-01-01"), at("1998-01-01")).alias("hit"))


RULES = [(1, "code", None, None, "code"), (2, None, "https://src0.", None, "main"), (3, None, None, "src[0-9]\\.example", "single"), (4, "manual", None, None, "main"), (5, None, None, None, "any")]


@query("domain_rules", f"""{WITH}, r(priority, st, pre, rx, domain) AS (VALUES {", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in RULES).replace(chr(92) * 2, chr(92))}),
m AS (SELECT id, domain, min(priority) AS p FROM sources JOIN r ON (st IS NULL OR st = source_type) AND (pre IS NULL OR starts_with(uri, pre)) AND (rx IS NULL OR regexp_matches(uri, rx)) GROUP BY id, domain)
SELECT id, string_agg(domain, ',' ORDER BY p) AS domains FROM m GROUP BY id""")
def domain_rules(spark, sf):
    rules = spark.createDataFrame(RULES, "priority int, source_type string, uri_prefix string, uri_regex string, domain string")
    return relational.rules_matched(kg.sources(spark, sf), rules).select("id", F.array_join("domains", ",").alias("domains"))


@query("beta_aggregate", f"{WITH} SELECT entity_id, round(4 + sum(confidence), 6) AS alpha, round(1 + sum(1 - confidence), 6) AS beta, round((4 + sum(confidence)) / (5 + count(*)), 9) AS mean FROM extractions GROUP BY 1")
def beta_aggregate(spark, sf):
    a, b = relational.seniority(4.0, 1.0, F.lit(1.0), F.col("confidence"))
    return kg.extractions(spark, sf).groupBy("entity_id").agg(F.round(a, 6).alias("alpha"), F.round(b, 6).alias("beta"), F.round(a / (a + b), 9).alias("mean"))


@query("epistemic_delta", f"{WITH}, x AS (SELECT entity_id AS id, avg(confidence) AS p FROM extractions WHERE chunk_id % 2 = 0 GROUP BY 1), y AS (SELECT entity_id AS id, avg(confidence) AS p FROM extractions WHERE chunk_id % 2 = 1 GROUP BY 1) SELECT round(sum(abs(coalesce(y.p, 0) - coalesce(x.p, 0))), 4) AS delta, sum(abs(coalesce(y.p, 0) - coalesce(x.p, 0))) > 0.1 AS changed FROM x FULL JOIN y USING (id)")
def epistemic_delta(spark, sf):
    half = lambda k: kg.extractions(spark, sf).filter(F.col("chunk_id") % 2 == k).groupBy(F.col("entity_id").alias("id")).agg(F.avg("confidence").alias("p"))
    return relational.delta(half(0), half(1)).withColumn("delta", F.round("delta", 4))


@query("contention_groups", f"{WITH}, c AS (SELECT DISTINCT src, 'contradicts' AS rel_type, dst FROM edges WHERE invalid) SELECT src, rel_type, array_to_string(list_sort(list(dst)), ',') AS targets FROM c GROUP BY 1, 2")
def contention_groups(spark, sf):
    e = kg.edges(spark, sf).filter("invalid").withColumn("rel_type", F.lit("contradicts"))
    return relational.contentions(e).withColumn("targets", F.array_join("targets", ","))


@query("queue_status", "SELECT event_type AS kind, CASE WHEN value < 10 THEN 'pending' WHEN value < 30 THEN 'running' ELSE 'done' END AS status, count(*) AS n FROM events GROUP BY 1, 2")
def queue_status(spark, sf):
    v = F.col("value")
    return kg.table(spark, sf, "events").groupBy(F.col("event_type").alias("kind"), F.when(v < 10, "pending").when(v < 30, "running").otherwise("done").alias("status")).agg(F.count("*").alias("n"))


@query("stale_documents", "SELECT user_id, event_type, string_agg(DISTINCT props, '|' ORDER BY props) AS entities, round(epoch(TIMESTAMP '2024-02-01' - max(ts)) / 86400, 6) AS days_behind FROM events GROUP BY 1, 2 HAVING max(ts) > TIMESTAMP '2024-01-05'")
def stale_documents(spark, sf):
    last = F.max("ts")
    behind = (F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros(last.cast("timestamp"))) / 86400e6
    return kg.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.array_join(F.array_sort(F.collect_set("props")), "|").alias("entities"), F.round(behind, 6).alias("days_behind"), last.alias("_last")).filter("_last > timestamp_ntz'2024-01-05'").drop("_last")


@query("bridged_entities", f"{WITH}, b AS (SELECT DISTINCT dst FROM edges WHERE rel_type = 'supplies' AND NOT invalid) SELECT domain, count(DISTINCT id) AS total, count(DISTINCT CASE WHEN dst IS NOT NULL THEN id END) AS bridged, round(1 - count(DISTINCT CASE WHEN dst IS NOT NULL THEN id END) / count(DISTINCT id), 6) AS whitespace FROM nodes LEFT JOIN b ON dst = id WHERE node_type = 'technology' GROUP BY domain")
def bridged_entities(spark, sf):
    b = relational.valid(kg.edges(spark, sf)).filter("rel_type = 'supplies'").select("dst").distinct()
    n = kg.nodes(spark, sf).filter("node_type = 'technology'")
    total, got = F.countDistinct("id"), F.countDistinct(F.when(F.col("dst").isNotNull(), F.col("id")))
    return n.join(b, n["id"] == b["dst"], "left").groupBy("domain").agg(total.alias("total"), got.alias("bridged"), F.round(1 - got / total, 6).alias("whitespace"))


@query("erosion", "WITH c AS (SELECT list(embedding::DOUBLE[]) AS es FROM embeddings WHERE vec_id < 1), d AS (SELECT label, vec_id AS id, greatest(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT es[1] FROM c)), 0) AS d FROM embeddings), r AS (SELECT *, avg(d) OVER (PARTITION BY label) AS drift, row_number() OVER (PARTITION BY label ORDER BY round(d, 9) DESC, id) AS n FROM d) SELECT label, id, round(d, 6) AS distance, round(drift, 6) AS drift FROM r WHERE n <= 5 AND drift >= 0.3")
def erosion(spark, sf):
    d = vectors(spark, sf).select("label", "id", V.distance(F.col("embedding"), F.lit(probe(spark, sf))).alias("d"))
    w = Window.partitionBy("label")
    r = d.withColumns({"drift": F.avg("d").over(w), "n": F.row_number().over(w.orderBy(F.desc(F.round("d", 9)), "id"))})
    return r.filter("n <= 5 AND drift >= 0.3").select("label", "id", F.round("d", 6).alias("distance"), F.round("drift", 6).alias("drift"))


OPS = "t AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey, l_suppkey, l_discount * 4 AS b1, l_tax AS d1, 1 - l_discount * 4 - l_tax AS u1, 0.3 AS b2, 0.2 AS d2, 0.5 AS u2 FROM lineitem)"


@query("opinion_algebra", f"""WITH {OPS}, k AS (SELECT *, u1 + u2 - u1 * u2 AS k, b1 * d2 + d1 * b2 AS c FROM t)
SELECT id, l_partkey, l_suppkey, round((b1 * u2 + b2 * u1) / k, 6) AS cum_b, round(u1 * u2 / k, 6) AS cum_u, round(2 * u1 * u2 / (u1 + u2), 6) AS avg_u, round(b1 * 0.7, 6) AS disc_b, round(1 - 0.7 * (b1 + d1), 6) AS disc_u,
 round((b1 * b2 + b1 * u2 + u1 * b2) / (1 - c), 6) AS ds_b, round(b1 + 0.5 * u1, 6) AS p, round((b1 + 0.5 * u1) * (1 - 0.3 * 0.6), 6) AS attacked FROM k""")
def opinion_algebra(spark, sf):
    c, r = F.col, lambda x, n: F.round(x, 6).alias(n)
    x, y = O.opinion(c("l_discount") * 4, c("l_tax"), 1 - c("l_discount") * 4 - c("l_tax")), O.opinion(0.3, 0.2, 0.5)
    t = kg.table(spark, sf, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), "l_partkey", "l_suppkey", x.alias("x"), y.alias("y"))
    x, y = c("x"), c("y")
    cum, avg, disc, ds = O.cumulative(x, y), O.averaging(x, y), O.discounted(x, F.lit(0.7)), O.dempster_shafer(x, y)
    return t.select("id", "l_partkey", "l_suppkey", r(cum["b"], "cum_b"), r(cum["u"], "cum_u"), r(avg["u"], "avg_u"), r(disc["b"], "disc_b"), r(disc["u"], "disc_u"), r(ds["b"], "ds_b"), r(O.projected(x), "p"), r(O.attacked(O.projected(x), F.lit(0.6), F.lit(0.3)), "attacked"))


@query("content_overlap", "WITH p AS (SELECT a.item_id AS x, b.item_id AS y, list_filter(string_split(regexp_replace(a.text, '[ \\t\\n\\r]+', ' ', 'g'), ' '), lambda w: w <> '') AS u, list_filter(string_split(regexp_replace(b.text, '[ \\t\\n\\r]+', ' ', 'g'), ' '), lambda w: w <> '') AS v FROM benchmark a JOIN benchmark b ON a.item_id % 50 = 0 AND a.item_id <> b.item_id), s AS (SELECT x, y, len(list_intersect(u, v)) / len(list_distinct(list_concat(u, v))) AS s FROM p) SELECT x, y, round(s, 6) AS jaccard, CASE WHEN s >= 0.8 THEN 'correction' WHEN s < 0.2 THEN 'refactor' ELSE 'versioned' END AS update_class FROM s WHERE s > 0")
def content_overlap(spark, sf):
    b = kg.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    s = relational.overlaps(b.filter("id % 50 = 0"), b).filter("x <> y")
    return s.select("x", "y", F.round("s", 6).alias("jaccard"), T.update_class(F.col("s")).alias("update_class"))


@query("entity_classes", f"{WITH} SELECT id, CASE WHEN node_type IN ('person', 'organization', 'location', 'role') THEN 'actor' WHEN node_type = 'component' THEN 'analysis' ELSE 'domain' END AS class FROM nodes")
def entity_classes(spark, sf):
    return kg.nodes(spark, sf).select("id", T.entity_class(F.col("node_type")).alias("class"))


@query("retry_backoff", "SELECT event_id, CASE event_type WHEN 'error' THEN 'rate_limit' WHEN 'click' THEN 'permanent' ELSE 'transient' END AS kind, CASE event_type WHEN 'error' THEN least(900 * 2.0 ^ (event_id % 6), 7200) WHEN 'click' THEN 0 ELSE least(30 * 2.0 ^ (event_id % 6), 7200) END::DOUBLE AS seconds FROM events")
def retry_backoff(spark, sf):
    e = kg.table(spark, sf, "events")
    error = F.when(F.col("event_type") == "error", "HTTP 429: Too many requests").when(F.col("event_type") == "click", "Invalid payload").otherwise("connection reset")
    return e.select("event_id", T.failure(error).alias("kind"), T.backoff(T.failure(error), F.col("event_id") % 6 + 1).alias("seconds"))


@query("source_trust", f"{WITH} SELECT id, CASE source_type WHEN 'document' THEN 0.8 WHEN 'code' THEN 0.7 WHEN 'api' THEN 0.7 WHEN 'tool_output' THEN 0.7 WHEN 'web_page' THEN 0.6 WHEN 'manual' THEN 0.6 WHEN 'conversation' THEN 0.5 ELSE 0.4 END::DOUBLE AS reliability FROM sources")
def source_trust(spark, sf):
    return kg.sources(spark, sf).select("id", F.round(O.reliability(F.col("source_type")), 9).alias("reliability"))


@query("last_turns", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal FROM r WHERE n <= 3")
def last_turns(spark, sf):
    w = Window.partitionBy("conv_id")
    t = kg.table(spark, sf, "conversations").withColumn("n", F.row_number().over(w.orderBy(F.desc("turn")))).filter("n <= 3")
    return t.select("conv_id", "turn", "role", F.row_number().over(w.orderBy("turn")).cast("long").alias("ordinal"))


@query("session_transcript", "SELECT conv_id, count(*) AS turns, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def session_transcript(spark, sf):
    said = F.sort_array(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line"))))
    return kg.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sha2(F.array_join(F.transform(said, lambda x: x["line"]), "\n"), 256).alias("digest"))


@query("expired_memories", "SELECT event_id FROM events WHERE value > 40 AND ts < TIMESTAMP '2024-01-20' UNION ALL SELECT event_id FROM events WHERE value <= 40 AND ts < TIMESTAMP '2024-01-31' - INTERVAL 25 DAY")
def expired_memories(spark, sf):
    e = kg.table(spark, sf, "events")
    old = e.filter("value <= 40 AND ts < timestamp_ntz'2024-01-31' - INTERVAL '25' DAY")
    return e.filter("value > 40 AND ts < timestamp_ntz'2024-01-20'").select("event_id").unionAll(old.select("event_id"))


@query("json_fields", "SELECT event_id, (props ->> '$.k')::BIGINT AS k, (props ->> '$.k')::BIGINT > 50 AS high FROM events")
def json_fields(spark, sf):
    k = F.try_to_number(F.get_json_object("props", "$.k"), F.lit("999999999")).cast("long")
    return kg.table(spark, sf, "events").select("event_id", k.alias("k"), (k > 50).alias("high"))
