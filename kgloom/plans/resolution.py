"""Queries on the resolver's tiers, what follows from them, and on expansion and choice of search results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import memory, relational, resolve, retrieve
from ..sources import kgview as kg
from .core import WITH
from .knowledge import TRI, VALID, valid
from .registry import query

#: Vectors whose id isn't divisible by five are nodes; the others are mentions, written in five ways.
WORLD = f"""
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, 'type' || (vec_id % 3) AS node_type FROM embeddings),
n AS (SELECT *, 'entity ' || id AS name FROM v WHERE id % 5 <> 0),
al AS (SELECT 'Also ' || id AS alias, id AS node_id FROM n WHERE id % 7 = 0),
ed AS (SELECT a.id AS src, b.id AS dst FROM n a JOIN n b ON b.id = a.id + 1 WHERE a.id % 3 = 0),
me AS (SELECT id AS mention_id, e, node_type, id % 25 = 20 AS from_code,
  CASE id % 25 WHEN 0 THEN 'ENTITY ' || (id + 1) WHEN 5 THEN 'also ' || (id // 7 * 7) WHEN 10 THEN 'fresh ' || id WHEN 15 THEN 'entit ' || (id + 2) ELSE 'entity' || id END AS name FROM v WHERE id % 5 = 0),
f1 AS (SELECT me.*, lower(trim(me.name)) AS key, (SELECT min(n.id) FROM n WHERE lower(n.name) = lower(trim(me.name))) AS exact, (SELECT min(node_id) FROM al WHERE lower(alias) = lower(trim(me.name))) AS alias FROM me),
rest AS (SELECT * FROM f1 WHERE exact IS NULL AND alias IS NULL AND NOT from_code),
nb AS (SELECT src AS node, dst AS o FROM ed UNION SELECT dst, src FROM ed),
ok AS (SELECT c.id AS node, t.node_type AS mtype FROM n c, (SELECT DISTINCT node_type FROM me) t WHERE c.node_type = t.node_type OR c.id NOT IN (SELECT node FROM nb) OR EXISTS (SELECT 1 FROM nb JOIN n x ON x.id = nb.o WHERE nb.node = c.id AND x.node_type = t.node_type)),
cl AS (SELECT mention_id, rest.node_type AS mtype, arg_min(n.id, [round(greatest(1 - list_cosine_similarity(rest.e, n.e), 0), 12), n.id]) AS node FROM rest JOIN n ON greatest(1 - list_cosine_similarity(rest.e, n.e), 0) < 1 - 0.4 GROUP BY 1, 2),
vc AS (SELECT mention_id, node FROM cl JOIN ok USING (node, mtype)),
l2 AS (SELECT * FROM rest WHERE mention_id NOT IN (SELECT mention_id FROM vc)),
tn AS (SELECT id, node_type, {TRI.format('name')} AS tb FROM n), tm AS (SELECT mention_id, node_type, {TRI.format('key')} AS ta FROM l2),
fc AS (SELECT mention_id, tm.node_type AS mtype, tn.id AS node, row_number() OVER (PARTITION BY mention_id ORDER BY tn.node_type = tm.node_type DESC, round(len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))), 9) DESC, tn.id) AS r FROM tm, tn WHERE len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) >= 0.5),
fz AS (SELECT mention_id, node FROM fc JOIN ok USING (node, mtype) WHERE r = 1),
res AS (SELECT f1.mention_id, f1.name AS said, coalesce(exact, alias, vc.node, fz.node) AS node, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN alias IS NOT NULL THEN 'alias' WHEN vc.node IS NOT NULL THEN 'vector' WHEN fz.node IS NOT NULL THEN 'fuzzy' ELSE 'new' END AS match
  FROM f1 LEFT JOIN vc USING (mention_id) LEFT JOIN fz USING (mention_id))"""


def world(spark, sf):
    """(nodes, aliases, edges, mentions), as WORLD has them."""
    v = kg.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("type"), F.col("vec_id") % 3).alias("node_type"))
    i = F.col("id")
    n = v.filter(i % 5 != 0).withColumn("name", F.concat(F.lit("entity "), "id"))
    al = n.filter(i % 7 == 0).select(F.concat(F.lit("Also "), "id").alias("alias"), i.alias("node_id"))
    ed = n.filter(i % 3 == 0).select(i.alias("src"), (i + 1).alias("dst")).join(n.select(i.alias("dst")), "dst", "left_semi").select("src", "dst")
    say = F.when(i % 25 == 0, F.concat(F.lit("ENTITY "), i + 1)).when(i % 25 == 5, F.concat(F.lit("also "), F.expr("id div 7 * 7"))).when(i % 25 == 10, F.concat(F.lit("fresh "), i)).when(i % 25 == 15, F.concat(F.lit("entit "), i + 2)).otherwise(F.concat(F.lit("entity"), i))
    return n, al, ed, v.filter(i % 5 == 0).select(i.alias("mention_id"), say.alias("name"), "node_type", (i % 25 == 20).alias("from_code"), "embedding")


def found(spark, sf):
    n, al, ed, m = world(spark, sf)
    return resolve.tiered(m, n, al, ed, similarity=0.4, threshold=0.5)


@query("resolver_tiers", f"WITH {WORLD} SELECT mention_id, res.node, coalesce(n.name, said) AS name, match FROM res LEFT JOIN n ON n.id = res.node")
def resolver_tiers(spark, sf):
    return found(spark, sf)


@query("graph_support", f"WITH {WORLD} SELECT node, mtype AS node_type FROM ok")
def graph_support(spark, sf):
    n, _, ed, m = world(spark, sf)
    pairs = n.select(F.col("id").alias("node"), F.col("node_type").alias("candidate_type")).join(m.select("node_type").distinct())
    return resolve.supported(pairs, n, ed).select("node", "node_type")


FRESH = "fr AS (SELECT lower(trim(name)) AS key, count(*) AS k, min(mention_id) AS mid FROM me JOIN res USING (mention_id) WHERE match = 'new' GROUP BY 1)"


@query("resolved_or_created", f"WITH {WORLD}, {FRESH} SELECT n.id, n.name, n.id % 4 + (SELECT count(*) FROM res WHERE res.node = n.id) AS mention_count, CASE WHEN NOT EXISTS (SELECT 1 FROM res JOIN me USING (mention_id) WHERE res.node = n.id AND mention_id % 2 = 0) THEN 'about' END AS summary FROM n UNION ALL SELECT 1000000 + row_number() OVER (ORDER BY encode(key)) - 1, trim(me.name), k, NULL FROM fr JOIN me ON me.mention_id = mid")
def resolved_or_created(spark, sf):
    n, al, _, m = world(spark, sf)
    n = n.select("id", "name", "node_type", (F.col("id") % 4).alias("mention_count"), F.lit("about").alias("summary"), F.lit("old").alias("ast_hash"))
    m = m.withColumn("ast_hash", F.when(F.col("mention_id") % 2 == 0, F.concat(F.lit("h"), "mention_id")))
    return resolve.upserted(m, found(spark, sf), n, al, 1_000_000)[0].select("id", "name", "mention_count", "summary")


@query("aliases_learnt", f"WITH {WORLD} SELECT alias, node_id FROM al UNION ALL SELECT arg_min(trim(said), mention_id), arg_min(node, mention_id) FROM res WHERE match = 'vector' AND length(trim(said)) >= 3 AND lower(trim(said)) NOT IN (SELECT lower(alias) FROM al) GROUP BY lower(trim(said))")
def aliases_learnt(spark, sf):
    n, al, _, m = world(spark, sf)
    n = n.select("id", "name", "node_type", F.lit(1).cast("long").alias("mention_count"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("ast_hash"))
    return resolve.upserted(m.withColumn("ast_hash", F.lit(None).cast("string")), found(spark, sf), n, al, 1_000_000)[1]


@query("pending_names", """WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, (vec_id % 11) / 10 AS confidence FROM embeddings), p AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON greatest(1 - list_cosine_similarity(a.e, b.e), 0) < 1 - 0.4),
c(id, root) USING KEY (id) AS (SELECT id, id FROM v UNION SELECT p.b, min(c.root) FROM c JOIN p ON p.a = c.id JOIN recurring.c AS k ON k.id = p.b WHERE c.root < k.root GROUP BY p.b),
g AS (SELECT root, count(*) AS n, arg_max(id, [confidence, -id]) AS best FROM c JOIN v USING (id) GROUP BY root) SELECT id, CASE WHEN n < 2 THEN id ELSE best END AS canonical, n < 2 AS noise FROM c JOIN g USING (root)""")
def pending_names(spark, sf):
    v = kg.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", ((F.col("vec_id") % 11) / 10).alias("confidence"))
    return resolve.pending_resolved(v, 0.4)


STATEMENTS = """v AS (SELECT vec_id AS id, label AS source_id, embedding::DOUBLE[] AS e, 'w' || (vec_id % 40) AS hash FROM embeddings),
o AS (SELECT *, 'alpha' || (id % 3) || ' bravo' || (id % 4) || ' delta of it' AS content, 'only ALPHA0 or bravo1 and delta' || repeat('x', id % 2) || ' are left' AS span FROM v WHERE id % 2 = 0), nw AS (SELECT * FROM v WHERE id % 2 = 1 OR id % 10 = 0),
re AS (SELECT * FROM nw WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.source_id = nw.source_id AND o.hash = nw.hash)),
b AS (SELECT re.id, arg_max(o.id, [round(list_cosine_similarity(re.e, o.e), 12), -o.id]) AS old_id FROM re JOIN o ON re.source_id = o.source_id AND list_cosine_similarity(re.e, o.e) > 0.3 GROUP BY 1)"""


def statements(spark, sf):
    i = F.col("id")
    v = kg.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("source_id"), "embedding", F.concat(F.lit("w"), F.col("vec_id") % 40).alias("hash"))
    old = v.filter(i % 2 == 0).withColumns({"content": F.concat(F.lit("alpha"), i % 3, F.lit(" bravo"), i % 4, F.lit(" delta of it")), "span": F.concat(F.lit("only ALPHA0 or bravo1 and delta"), F.when(i % 2 == 1, "x").otherwise(""), F.lit(" are left"))})
    return v.filter((i % 2 == 1) | (i % 10 == 0)), old


@query("statements_added", f"WITH {STATEMENTS} SELECT source_id, id FROM re WHERE id NOT IN (SELECT id FROM b)")
def statements_added(spark, sf):
    return resolve.statements_matched(*statements(spark, sf), similarity=0.3)[0]


@query("statements_evicted", f"WITH {STATEMENTS} SELECT source_id, id FROM o WHERE NOT EXISTS (SELECT 1 FROM nw WHERE nw.source_id = o.source_id AND nw.hash = o.hash) AND id NOT IN (SELECT old_id FROM b) AND ((id % 3 = 0)::INT + (id % 4 = 1)::INT + 1) / 3 <= 0.4")
def statements_evicted(spark, sf):
    return resolve.statements_matched(*statements(spark, sf), similarity=0.3, kept_words=0.4)[1]


@query("seed_neighbours", f"""{WITH}, {VALID}, s AS (SELECT id FROM nodes WHERE node_type = 'organization' AND id % 3 = 0), b AS (SELECT src AS seed, dst AS o, confidence, id FROM v UNION ALL SELECT dst, src, confidence, id FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY confidence DESC, o, id) AS k FROM b WHERE seed IN (SELECT id FROM s) AND o NOT IN (SELECT id FROM s)) SELECT o AS id, round(sum(confidence), 9) AS weight FROM r WHERE k <= 5 GROUP BY o""")
def seed_neighbours(spark, sf):
    s = kg.nodes(spark, sf).filter("node_type = 'organization' AND id % 3 = 0").select("id")
    return retrieve.activated(s, valid(spark, sf)).withColumn("weight", F.round("weight", 9))


QUESTIONS = "q AS (SELECT n_nationkey::BIGINT AS id, 'Why is ' || upper(n_name) || ' near Region_' || (n_regionkey + 1) % 5 || '?' AS text FROM nation)"


@query("expanded_questions", f"""{WITH}, {VALID}, {QUESTIONS}, h AS (SELECT q.id AS q, nodes.id AS node, name FROM q JOIN nodes ON strlen(name) >= 3 AND contains(lower(text), lower(name))),
b AS (SELECT src AS node, dst AS o, rel_type, 0 AS side, id FROM v UNION ALL SELECT dst, src, rel_type, 1, id FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY side, id) AS k FROM b WHERE node IN (SELECT node FROM h)),
p AS (SELECT node, string_agg(rel_type || CASE side WHEN 1 THEN ' of ' ELSE ' ' END || n.name, ', ' ORDER BY k) AS t FROM r JOIN nodes n ON n.id = o WHERE k <= 5 GROUP BY node),
c AS (SELECT q, string_agg(name || ' (' || t || ')', '; ' ORDER BY node) AS c FROM h JOIN p USING (node) GROUP BY q) SELECT id, text || coalesce(' [Context: ' || c || ']', '') AS expanded FROM q LEFT JOIN c ON q = id""")
def expanded_questions(spark, sf):
    text = F.concat(F.lit("Why is "), F.upper("n_name"), F.lit(" near Region_"), (F.col("n_regionkey") + 1) % 5, F.lit("?"))
    q = kg.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), text.alias("text"))
    return retrieve.textually_expanded(q, kg.nodes(spark, sf), valid(spark, sf))


def context_items(spark, sf):
    v = kg.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding", ((F.col("vec_id") % 17) / 17).alias("score"))
    return v.withColumn("topic", F.expr("label * 100 + id div 50")).withColumn("embedding", F.when(F.col("id") % 13 != 0, F.col("embedding")))


@query("context_dedup")
def context_dedup(spark, sf):
    return memory.deduplicated(context_items(spark, sf), "topic", 0.2).select("topic", "id")


@query("close_pairs_blocked")
def close_pairs_blocked(spark, sf):
    v = kg.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return relational.close_pairs(v, v, 0.6, recall=0.95, bits=4).filter("left_id < right_id").withColumn("distance", F.round("distance", 9))


ABBREVIATED = "SELECT c_custkey AS doc_id, 'The Machine Learning Group, or MLG, of ' || c_name || CASE c_custkey % 3 WHEN 0 THEN ' met A Data Team (DT).' WHEN 1 THEN ' met Open Graph Works.' ELSE '' END AS text FROM customer"


@query("abbreviation_links", f"WITH d AS ({ABBREVIATED}) SELECT doc_id, 'Machine Learning Group' AS term, 'MLG' AS short FROM d UNION ALL SELECT doc_id, 'Data Team', 'DT' FROM d WHERE doc_id % 3 = 0")
def abbreviation_links(spark, sf):
    more = F.when(F.col("c_custkey") % 3 == 0, " met A Data Team (DT).").when(F.col("c_custkey") % 3 == 1, " met Open Graph Works.").otherwise("")
    d = kg.table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("The Machine Learning Group, or MLG, of "), "c_name", more).alias("text"))
    return resolve.abbreviations(d)
