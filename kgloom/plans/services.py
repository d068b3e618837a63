"""Queries on edits with an audit, reprocessing, per-chunk entities, summaries, delivery, checks, the debounced log and its schedule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieve, services
from ..sources import kgview as kg
from .core import WITH
from .knowledge import members
from .registry import query

HEALTH = """so AS (SELECT id, uri, CASE WHEN id % 7 = 0 THEN id + 1 END AS superseded_by, CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE title END AS summary FROM sources),
nd AS (SELECT id, CASE WHEN id % 5 = 1 THEN 'code' ELSE entity_class END AS entity_class, id % 4 = 0 AS bare, CASE WHEN id % 3 = 0 THEN 'x' END AS summary FROM nodes), o AS (SELECT id FROM nodes WHERE id NOT IN (SELECT entity_id FROM extractions))"""


@query("data_health", f"""{WITH}, {HEALTH} SELECT (SELECT count(*) FROM so WHERE superseded_by IS NOT NULL) AS superseded_sources, (SELECT count(*) FROM so WHERE superseded_by IS NULL AND coalesce(summary, '') = '') AS unsummarized_sources,
(SELECT count(*) FROM chunks JOIN so ON so.id = source_id WHERE superseded_by IS NOT NULL) AS superseded_chunks, (SELECT count(*) FROM o) AS orphan_nodes, (SELECT count(*) FROM o WHERE id IN (SELECT src FROM edges UNION SELECT dst FROM edges)) AS orphan_nodes_with_edges,
(SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM so WHERE superseded_by IS NULL GROUP BY uri HAVING count(*) > 1)) AS duplicate_sources, (SELECT count(*) FROM nd WHERE bare) AS unembedded_nodes, (SELECT count(*) FROM nd WHERE entity_class = 'code' AND summary IS NULL) AS unsummarized_code""")
def data_health(spark, sf):
    i = F.col("id")
    s = kg.sources(spark, sf).select("id", "uri", F.when(i % 7 == 0, i + 1).alias("superseded_by"), F.when(i % 3 == 0, None).when(i % 3 == 1, "").otherwise(F.col("title")).alias("summary"))
    n = kg.nodes(spark, sf).select("id", F.when(i % 5 == 1, "code").otherwise(F.col("entity_class")).alias("entity_class"), F.when(i % 4 != 0, F.array(F.lit(1.0))).alias("embedding"), F.when(i % 3 == 0, "x").alias("summary"))
    return services.data_health(n, kg.edges(spark, sf), s, kg.chunks(spark, sf), kg.extractions(spark, sf))


@query("whitespace_gaps", f"""{WITH}, r AS (SELECT id FROM sources WHERE source_type = 'document'), m AS (SELECT DISTINCT chunk_id % (SELECT count(*) FROM sources) AS source_id, entity_id AS id FROM extractions), b AS (SELECT src AS id FROM edges WHERE rel_type = 'delivered' AND id % 1997 = 0 UNION SELECT dst FROM edges WHERE rel_type = 'delivered' AND id % 1997 = 0),
p AS (SELECT source_id, count(*) AS nodes, count(*) FILTER (m.id IN (SELECT id FROM b)) AS bridged FROM m WHERE source_id IN (SELECT id FROM r) GROUP BY 1 HAVING count(*) >= 2),
k AS (SELECT m.source_id, name, row_number() OVER (PARTITION BY m.source_id ORDER BY mention_count DESC, m.id) AS k FROM m JOIN p ON p.source_id = m.source_id AND bridged = 0 JOIN nodes ON nodes.id = m.id)
SELECT p.source_id, p.nodes, string_agg(name, ', ' ORDER BY k) AS representatives, round((SELECT count(*) FILTER (bridged = 0) / count(*) FROM p), 9) AS score FROM p JOIN k ON k.source_id = p.source_id WHERE bridged = 0 AND k <= 10 GROUP BY p.source_id, p.nodes""")
def whitespace_gaps(spark, sf):
    s = kg.sources(spark, sf)
    m = kg.extractions(spark, sf).select((F.col("chunk_id") % s.count()).alias("source_id"), F.col("entity_id").alias("id"))
    b = kg.edges(spark, sf).filter("rel_type = 'delivered' AND id % 1997 = 0")
    return services.whitespace(s.filter("source_type = 'document'"), m, kg.nodes(spark, sf), b, 2).withColumn("score", F.round("score", 9))


FIXES = "fx AS (SELECT DISTINCT id, CASE WHEN id % 2 = 0 THEN 'moved' END AS rel, CASE id // 10 % 4 WHEN 0 THEN NULL WHEN 1 THEN 1.5 ELSE id % 10 / 20 END AS conf FROM edges WHERE id > 0 AND id // 10 % 5 = 0 UNION ALL SELECT -5, 'gone', NULL)"


def fixes(spark, sf):
    e, i = kg.edges(spark, sf).filter("id > 0 AND id div 10 % 5 = 0"), F.expr("id div 10 % 4")
    one = e.select("id", F.when(F.col("id") % 2 == 0, "moved").alias("rel_type"), F.when(i == 0, None).when(i == 1, 1.5).otherwise(F.col("id") % 10 / 20).alias("confidence"))
    return one.unionByName(spark.createDataFrame([(-5, "gone", None)], one.schema))


@query("edges_corrected", f"{WITH}, {FIXES}, ok AS (SELECT * FROM fx WHERE conf IS NULL OR conf BETWEEN 0 AND 1) SELECT edges.id, coalesce(rel, rel_type) AS rel_type, coalesce(conf, confidence) AS confidence FROM edges LEFT JOIN ok USING (id)")
def edges_corrected(spark, sf):
    return services.edges_corrected(kg.edges(spark, sf), fixes(spark, sf))[0].select("id", "rel_type", "confidence")


@query("correction_audit", f"{WITH}, {FIXES} SELECT fx.id AS target, CASE WHEN edges.id IS NULL THEN 'not_found' WHEN conf NOT BETWEEN 0 AND 1 THEN 'refused' ELSE 'edge_correct' END AS action FROM fx LEFT JOIN edges USING (id)")
def correction_audit(spark, sf):
    return services.edges_corrected(kg.edges(spark, sf), fixes(spark, sf))[1].select("target", "action")


@query("edges_deleted", f"{WITH} SELECT id FROM edges WHERE NOT (id > 0 AND (id // 10) % 4 = 0)")
def edges_deleted(spark, sf):
    bad = kg.table(spark, sf, "lineitem").filter("l_orderkey % 4 = 0").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit("wrong").alias("reason"))
    return services.edges_deleted(kg.edges(spark, sf), bad)[0].select("id")


@query("deletion_audit", """SELECT l_orderkey * 10 + l_linenumber AS target, 'edge_delete' AS action, '{"edge_id":' || (l_orderkey * 10 + l_linenumber) || ',"reason":"wrong"}' AS changes FROM lineitem WHERE l_orderkey % 4 = 0 UNION ALL SELECT -7, 'not_found', '{"edge_id":-7,"reason":"a"}'""")
def deletion_audit(spark, sf):
    bad = kg.table(spark, sf, "lineitem").filter("l_orderkey % 4 = 0").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit("wrong").alias("reason"))
    return services.edges_deleted(kg.edges(spark, sf), bad.unionByName(spark.createDataFrame([(-7, "b"), (-7, "a")], bad.schema)))[1]


@query("reprocessed_sources", f"{WITH} SELECT id, 1 + (id % 3 = 0)::INT AS version, CASE WHEN id % 3 <> 0 THEN title END AS summary, CASE WHEN id % 3 = 0 THEN 0 ELSE (SELECT count(*) FROM chunks WHERE source_id = sources.id) END AS chunks FROM sources")
def reprocessed_sources(spark, sf):
    s = kg.sources(spark, sf).select("id", F.lit(1).alias("version"), F.col("title").alias("summary"))
    out, left, _ = services.reprocessed(s, {"chunks": kg.chunks(spark, sf).select("id", "source_id")}, s.filter("id % 3 = 0").select("id"))
    n = left["chunks"].groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("chunks"))
    return out.join(n, "id", "left").select("id", "version", "summary", F.coalesce("chunks", F.lit(0)).alias("chunks"))


MENTIONS = "me AS (SELECT l_orderkey AS chunk_id, CASE l_linenumber % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name ELSE '1' || l_linenumber END AS name, 1 - l_discount AS confidence FROM lineitem JOIN part ON p_partkey = l_partkey), en AS (SELECT chunk_id, lower(name) AS key, max({'c': confidence, 'n': name}) AS m FROM me WHERE NOT starts_with(name, '1') GROUP BY 1, 2)"


def mentions(spark, sf):
    p = kg.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    k = F.col("l_linenumber") % 3
    x = kg.table(spark, sf, "lineitem").join(p, "l_partkey")
    return x.select(F.col("l_orderkey").alias("chunk_id"), F.when(k == 0, F.upper("p_name")).when(k == 1, F.col("p_name")).otherwise(F.concat(F.lit("1"), "l_linenumber")).alias("name"), F.lit("thing").alias("node_type"), (1 - F.col("l_discount")).alias("confidence"))


@query("chunk_entities", f"WITH {MENTIONS} SELECT chunk_id, key, m.n AS name, m.c AS confidence FROM en")
def chunk_entities(spark, sf):
    return services.chunk_entities(mentions(spark, sf)).select("chunk_id", "key", "name", "confidence")


@query("chunk_relations", f"WITH {MENTIONS}, r AS (SELECT a.l_orderkey AS chunk_id, lower(p.p_name) AS source, lower(q.p_name) AS target FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 JOIN part p ON p.p_partkey = a.l_partkey JOIN part q ON q.p_partkey = b.l_partkey) SELECT DISTINCT r.chunk_id, source, target, 'near' AS rel_type FROM r JOIN en a ON a.chunk_id = r.chunk_id AND a.key = source JOIN en b ON b.chunk_id = r.chunk_id AND b.key = target WHERE source <> target")
def chunk_relations(spark, sf):
    p = kg.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    x = kg.table(spark, sf, "lineitem").join(p, "l_partkey").select(F.col("l_orderkey").alias("chunk_id"), "l_linenumber", "p_name")
    r = x.withColumnRenamed("p_name", "source").join(x.select("chunk_id", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("p_name").alias("target")), ["chunk_id", "l_linenumber"])
    return services.chunk_relations(r.withColumn("rel_type", F.lit("near")), services.chunk_entities(mentions(spark, sf)))


CODE = """co AS (SELECT o_orderkey AS id, o_custkey AS source_id, CASE o_orderkey % 4 WHEN 0 THEN 'fn f' || o_custkey || '() { return ' || o_orderkey || ' }; struct S of many fields and words' WHEN 1 THEN 'call f' || o_custkey || ' and then go on to other things ' || repeat('x', o_orderkey % 7) || ' of it' ELSE 'nothing' END AS content FROM orders),
nd AS (SELECT c_custkey AS id, c_custkey AS source_id, CASE c_custkey % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'struct' ELSE 'other' END AS node_type, CASE c_custkey % 3 WHEN 1 THEN 'S' ELSE 'f' || c_custkey END AS name, CASE WHEN c_custkey % 10 = 0 THEN 'done' END AS summary FROM customer),
df AS (SELECT *, CASE node_type WHEN 'function' THEN 'fn ' WHEN 'struct' THEN 'struct ' ELSE '' END || name AS def, CASE c WHEN 1 THEN 'a long description of the entity, for want of a chunk' END AS description FROM (SELECT *, id % 2 AS c FROM nd) WHERE summary IS NULL),
ow AS (SELECT df.id, arg_max(co.id, [(co.id % 8) / 8, -co.id]) AS k FROM df JOIN co ON co.source_id = df.source_id AND co.id % 2 = 0 AND contains(content, def) GROUP BY 1),
ot AS (SELECT df.id, arg_min(co.id, [strlen(content), co.id]) AS k FROM df JOIN co ON co.source_id = df.source_id AND contains(content, def) WHERE df.id NOT IN (SELECT id FROM ow) GROUP BY 1)"""


@query("summary_texts", f"WITH {CODE} SELECT df.id, coalesce(ow.k, ot.k) AS chunk_id, coalesce(content, description, name) AS text FROM df LEFT JOIN ow USING (id) LEFT JOIN ot USING (id) LEFT JOIN co ON co.id = coalesce(ow.k, ot.k) WHERE strlen(coalesce(content, description, name)) >= 50")
def summary_texts(spark, sf):
    o, k = kg.table(spark, sf, "orders"), F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("fn f"), "o_custkey", F.lit("() { return "), k, F.lit(" }; struct S of many fields and words"))).when(k % 4 == 1, F.concat(F.lit("call f"), "o_custkey", F.lit(" and then go on to other things "), F.repeat(F.lit("x"), (k % 7).cast("int")), F.lit(" of it"))).otherwise("nothing")
    c = o.select(k.alias("id"), F.col("o_custkey").alias("source_id"), text.alias("content"))
    i = F.col("c_custkey")
    n = kg.table(spark, sf, "customer").select(i.alias("id"), i.alias("source_id"), F.when(i % 3 == 0, "function").when(i % 3 == 1, "struct").otherwise("other").alias("node_type"), F.when(i % 3 == 1, "S").otherwise(F.concat(F.lit("f"), i)).alias("name"), F.when(i % 10 == 0, "done").alias("summary"), F.when(i % 2 == 1, "a long description of the entity, for want of a chunk").alias("description"))
    x = o.filter(k % 2 == 0).select(F.col("o_custkey").alias("entity_id"), k.alias("chunk_id"), ((k % 8) / 8).alias("confidence"))
    return services.summary_texts(n, x, c)


@query("composed_summaries", f"{WITH}, n AS (SELECT *, CASE WHEN id % 3 <> 0 THEN 'about ' || name END AS summary FROM nodes), p AS (SELECT DISTINCT chunk_id // 50 AS source_id, entity_id AS id FROM extractions) SELECT source_id, count(*) AS entities, string_agg(name || ' (' || node_type || '): ' || summary, chr(10) ORDER BY node_type, name, id) AS summary FROM p JOIN n USING (id) WHERE summary IS NOT NULL GROUP BY 1")
def composed_summaries(spark, sf):
    n = kg.nodes(spark, sf).withColumn("summary", F.when(F.col("id") % 3 != 0, F.concat(F.lit("about "), "name")))
    return services.composed_summaries(n, kg.extractions(spark, sf).select(F.expr("chunk_id div 50").alias("source_id"), F.col("entity_id").alias("id")))


@query("community_nodes", f"{WITH}, m AS (SELECT id, (id // 10) % 5 AS community FROM nodes), x AS (SELECT community, id, min({{'s': -(chunk_id // 50), 'p': chunk_id}}) AS w FROM extractions JOIN m ON m.id = entity_id WHERE (chunk_id // 50) % 2 = 0 GROUP BY 1, 2) SELECT community, row_number() OVER (PARTITION BY community ORDER BY w, id) AS ordinal, id FROM x")
def community_nodes(spark, sf):
    x = kg.extractions(spark, sf).select(F.expr("chunk_id div 50").alias("source_id"), F.col("chunk_id").alias("place"), F.col("entity_id").alias("id"))
    s = x.select("source_id").distinct().filter("source_id % 2 = 0").select("source_id", (-F.col("source_id")).alias("place"))
    return services.community_nodes(x, s, members(spark, sf))


@query("group_domains", "SELECT r_name AS \"group\", CASE WHEN r_regionkey % 2 = 0 THEN (SELECT list_sort(list_distinct(list(n_name))) FROM nation WHERE n_regionkey = r_regionkey) WHEN r_regionkey = 1 THEN ['a', 'b'] ELSE [] END AS domains FROM region")
def group_domains(spark, sf):
    r = kg.table(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("group"))
    g = kg.table(spark, sf, "nation").select(F.col("n_regionkey").alias("r_regionkey"), F.col("n_name").alias("domain")).join(r, "r_regionkey").filter("r_regionkey % 2 = 0").select("group", "domain")
    fixed = r.filter("r_regionkey = 1").first()
    return services.group_domains(g, r, {fixed["group"]: ["a", "b"]})


@query("delivered_results", r"""WITH r AS (SELECT doc_id AS id, source AS query, CASE doc_id % 3 WHEN 0 THEN 'node' ELSE 'chunk' END AS kind, CASE doc_id % 4 WHEN 0 THEN '12 34' WHEN 1 THEN text ELSE NULL END AS content, (doc_id * 7 % 101) / 101 AS score FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS n FROM r)
SELECT query, id FROM k WHERE n <= 200 AND (kind <> 'chunk' OR content IS NULL OR content <> '12 34') AND NOT (kind = 'chunk' AND content IS NOT NULL AND id % 4 = 1)""")
def delivered_results(spark, sf):
    i = F.col("doc_id")
    r = kg.table(spark, sf, "documents").select(i.alias("id"), F.col("source").alias("query"), F.when(i % 3 == 0, "node").otherwise("chunk").alias("result_type"), F.when(i % 4 == 0, "12 34").when(i % 4 == 1, F.lit("Sign up\nLog in\nSubscribe\n")).alias("content"), (i * 7 % 101 / 101).alias("score"))
    return services.delivered(r, "query", limit=1_000).select("query", "id")


@query("metadata_errors", """SELECT event_id AS id, CASE event_type WHEN 'click' THEN [x FOR x IN [CASE WHEN event_id % 3 = 1 THEN 'k is missing' END, CASE WHEN event_id % 3 = 2 THEN 'k is no number' END] IF x IS NOT NULL] WHEN 'view' THEN CASE WHEN event_id % 5 = 0 THEN ['no object'] ELSE [] END ELSE [] END AS errors FROM events""")
def metadata_errors(spark, sf):
    k = F.col("event_id") % 3
    click = F.when(k == 0, F.col("props")).when(k == 1, F.lit('{"z": [1]}')).otherwise(F.lit('{"k": "7"}'))
    view = F.when(F.col("event_id") % 5 == 0, F.lit("no json")).otherwise(F.lit('{"a": {"b": true}, "l": [1, 2]}'))
    e = kg.table(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type", F.when(F.col("event_type") == "click", click).otherwise(view).alias("metadata"))
    return services.metadata_errors(e, {"click": {"required": ["k"], "types": {"k": "number", "z": "array"}}, "view": {"types": {"a": "object", "a.b": "boolean", "l": "array"}}}, "event_type")


@query("log_flushes", """WITH e AS (SELECT event_id AS seq_id, ts, lag(ts) OVER (ORDER BY ts, event_id) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch(ts) - epoch(p) >= 300 THEN 1 ELSE 0 END) OVER (ORDER BY ts, seq_id) AS session FROM e)
SELECT seq_id, session::BIGINT AS session, ((row_number() OVER (PARTITION BY session ORDER BY ts, seq_id) - 1) // 5)::BIGINT AS part FROM s""")
def log_flushes(spark, sf):
    e = kg.table(spark, sf, "events").select(F.col("event_id").alias("seq_id"), "ts")
    return services.flushes(e, 300, 5).select("seq_id", "flush.session", "flush.part")


@query("schedule_ticks", "SELECT o_orderkey AS id, job, o_orderdate + to_seconds(every * unnest(range(1, (o_orderkey % 30 * 43200) // every + 1))) AS due FROM orders, (VALUES ('edges', 21600), ('gc', 604800)) j(job, every)")
def schedule_ticks(spark, sf):
    s = kg.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("begin"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(12) * (F.col("o_orderkey") % 30).cast("int"))).alias("end"))
    return services.ticks(s, {"edges": 6 * 3600, "gc": 7 * 86400})


@query("search_traces", """SELECT label AS query, '{"lexical":' || count(*) FILTER (vec_id % 3 <> 0) || CASE WHEN count(*) FILTER (vec_id % 3 = 0) > 0 THEN ',"vector":' || count(*) FILTER (vec_id % 3 = 0) ELSE '' END || '}' AS found, 'balanced' AS strategy, count(*) FILTER (vec_id % 2 = 0) AS results, max(vec_id) FILTER (vec_id % 2 = 0) / 10 AS best FROM embeddings GROUP BY 1""")
def search_traces(spark, sf):
    v = kg.table(spark, sf, "embeddings").select(F.col("label").alias("query"), F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 3 == 0, "vector").otherwise("lexical").alias("dimension"), (F.col("vec_id") / 10).alias("score"))
    return services.traced(v.filter("id % 2 = 0"), "query", v, F.lit("balanced"))


@query("replayed_searches", "SELECT label AS query, count(*) FILTER (vec_id % 2 = 0) AS before, nullif(count(*) FILTER (vec_id % 10 <> 0 AND label <> 3), 0) AS now FROM embeddings GROUP BY 1 HAVING count(*) FILTER (vec_id % 2 = 0) IS DISTINCT FROM nullif(count(*) FILTER (vec_id % 10 <> 0 AND label <> 3), 0)")
def replayed_searches(spark, sf):
    v = kg.table(spark, sf, "embeddings").select(F.col("label").alias("query"), F.col("vec_id").alias("id"), F.lit("vector").alias("dimension"), F.col("vec_id").alias("score"))
    run = lambda r: services.traced(r, "query", r, F.lit("balanced"))
    return services.replayed(run(v.filter("id % 2 = 0")), run(v.filter("id % 10 <> 0 AND query <> 3")), "query")


@query("windowed_mentions", "SELECT doc_id AS id, (length(text) - length(replace(text, 'tion', 'tio'))) AS n FROM documents WHERE contains(text, 'tion')")
def windowed_mentions(spark, sf):
    """What windows of 1,000 characters that share 100 find of a short word, merged, is what the whole texts hold."""
    w = services.coref_windows(kg.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), 1_000, 100)
    found = w.select("id", "window", "start", F.explode(services.occurrences(F.col("text"), "tion")).alias("at"), F.lit("tion").alias("label"), F.lit(4).alias("size"))
    return services.coref_merged(found, 100).groupBy("id").agg(F.count("*").alias("n"))


@query("low_quality_chunks")
def low_quality_chunks(spark, sf):
    return kg.chunks(spark, sf).filter(retrieve.low_quality(F.col("content"))).select("id")
