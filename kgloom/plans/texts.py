"""Queries on conversion, text predicates, chunking, streaming, retrieval and memory."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, curate, fusion, memory, relational, resolve, retrieve
from ..sources import convert
from ..sources import kgview as kg
from ..streaming import sync
from .core import LISTS, WITH, lists, probe, vectors
from .knowledge import TRI, members, valid
from .lineage import shared_folder
from .registry import query


def _steps(column: str, steps) -> str:
    out = column
    for pattern, new in steps:
        lit = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
        out = f"regexp_replace({out}, {lit(pattern.replace('(?is)', '').replace('(?s)', '').replace('(?i)', ''))}, {lit(new)}, '{'g' + ('i' if '(?i' in pattern else '') + ('s' if 's)' in pattern[:5] else '')}')"
    return out


def _decoded(column: str) -> str:
    out = column
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{char}')"
    return out


@query("html_text", f"SELECT page_id, sha256(trim({_steps(_steps(_decoded(_steps('html', convert.HTML_STEPS)), convert.TIDY_STEPS), (('^[' + chr(92) + 'n]+', ''), ('[' + chr(92) + 'n]+$', '')))})) AS digest FROM pages")
def html_text(spark, sf):
    return kg.table(spark, sf, "pages").select("page_id", F.sha2(convert.strip_html(F.col("html")), 256).alias("digest"))


@query("page_metadata", r"SELECT page_id, nullif(trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')), '') AS title, regexp_matches(lower(html), '^\s*(<!doctype|<html)') AS is_html, CASE WHEN regexp_matches(lower(url), '\.pdf([?]|#|$)') THEN 'document' WHEN contains(lower(url), '/api/') THEN 'api' WHEN regexp_matches(lower(url), '/(docs|manual)/') THEN 'manual' ELSE 'web_page' END AS source_type FROM pages")
def page_metadata(spark, sf):
    return kg.table(spark, sf, "pages").select("page_id", convert.html_title(F.col("html")).alias("title"), convert.is_html(F.col("html")).alias("is_html"), convert.source_type_of(F.col("url")).alias("source_type"))


@query("html_windows", "SELECT page_id, sha256(html) AS digest, true AS short FROM pages")
def html_windows(spark, sf):
    """The windows of a page, joined, are the page; each is as short as asked for."""
    w = convert.split_html(kg.table(spark, sf, "pages"), 1000)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window", "html"))), lambda x: x["html"]), "")
    return w.groupBy("page_id").agg(F.sha2(joined, 256).alias("digest"), (F.max(F.length("html")) <= 1000).alias("short"))


@query("converted_documents", "SELECT doc_id AS id, sha256(trim(text)) AS digest FROM documents WHERE trim(text) <> ''")
def converted_documents(spark, sf):
    d = kg.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), convert.converted(F.col("text"), F.lit("Text/Plain; charset=utf-8")).alias("t"))
    return d.filter("t IS NOT NULL").select("id", F.sha2("t", 256).alias("digest"))


@query("linearised_tables", "SELECT o_orderkey, 'before' || chr(10) || 'Key: ' || o_orderkey || ', Status: ' || o_orderstatus || '.' || chr(10) || 'Key: x, Status: ' || o_orderpriority || '.' || chr(10) || 'after' AS text FROM orders")
def linearised_tables(spark, sf):
    table = F.concat(F.lit("before\n| Key | Status |\n|---|:-:|\n| "), "o_orderkey", F.lit(" | "), "o_orderstatus", F.lit(" |\n| x | "), "o_orderpriority", F.lit(" |\nafter"))
    return kg.table(spark, sf, "orders").select("o_orderkey", convert.linearise(table).alias("text"))


CTRL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


@query("normalised_text", rf"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{CTRL}', '', 'g'), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'))) AS digest FROM documents")
def normalised_text(spark, sf):
    return kg.table(spark, sf, "documents").select("doc_id", F.sha2(T.normalised(F.col("text")), 256).alias("digest"))


@query("chunk_quality", rf"""{WITH}, l AS (SELECT id, content, trim(content) AS t FROM chunks)
SELECT id, length(regexp_replace(content, '\s', '', 'g')) < 30 OR (strlen(t) < 80 AND (regexp_matches(t, '^\*\*.*:\*\*') OR (regexp_matches(t, '^\[[0-9]{{4}}') AND strlen(t) < 20))) AS metadata_only,
 length(content) <= 300 AND regexp_matches(t, '{T.CITATION}') AS bibliography FROM l""")
def chunk_quality(spark, sf):
    c = F.col("content")
    return kg.chunks(spark, sf).select("id", T.metadata_only(c).alias("metadata_only"), T.bibliography_entry(c).alias("bibliography"))


@query("query_terms", f"SELECT item_id, array_to_string(list_filter(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' '), lambda w: strlen(w) >= 3 AND w NOT IN ({', '.join(repr(w) for w in T.STOP)})), ' ') AS terms FROM benchmark")
def query_terms(spark, sf):
    return kg.table(spark, sf, "benchmark").select("item_id", F.array_join(T.terms(F.col("text")), " ").alias("terms"))


@query("intent", "SELECT item_id, CASE WHEN regexp_matches(lower(text), 'last|latest|new|recent|today|yesterday') THEN 'recent' WHEN regexp_matches(lower(text), 'connected to|related to|relationship between|tell me about|who is') THEN 'exploratory' ELSE 'balanced' END AS intent FROM benchmark")
def intent(spark, sf):
    return kg.table(spark, sf, "benchmark").select("item_id", T.intent(F.col("text")).alias("intent"))


@query("path_labels", "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '_', 'g') AS label FROM part")
def path_labels(spark, sf):
    return kg.table(spark, sf, "part").select("p_partkey", T.label(F.col("p_name")).alias("label"))


@query("statement_windows", "SELECT doc_id, start, substr(text, start + 1, 800) AS text FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 101, 0) + 1, 700)) AS start FROM documents WHERE length(text) > 0)")
def statement_windows(spark, sf):
    w = F.inline(chunking.windows(F.col("text"), 800, 100))
    return kg.table(spark, sf, "documents").select("doc_id", w).withColumn("start", F.col("start").cast("long"))


@query("sentence_counts", rf"{WITH} SELECT id, (len(regexp_extract_all(content, '[.!?]\s+')) + 1 - regexp_matches(content, '[.!?]\s+$')::INT)::INT AS n FROM chunks")
def sentence_counts(spark, sf):
    return kg.chunks(spark, sf).select("id", F.size(chunking.sentences(F.col("content"))).alias("n"))


@query("chunked_documents")
def chunked_documents(spark, sf):
    return chunking.chunk_documents(kg.table(spark, sf, "documents")).select("doc_id", "ord", "level", "byte_start", "byte_end", F.sha2("text", 256).alias("digest"))


@query("group_summaries", f"{WITH}, j AS (SELECT source_id, count(*) AS children, string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY ordinal, id) AS s FROM chunks GROUP BY 1 HAVING count(*) >= 2) SELECT source_id, children, sha256(s[1:12000]) AS digest FROM j")
def group_summaries(spark, sf):
    return chunking.group_texts(kg.chunks(spark, sf), "source_id").select("source_id", "children", F.sha2("summary", 256).alias("digest"))


@query("span_projection", "WITH l AS (SELECT o_custkey AS source_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * 100 AS m FROM orders), s AS (SELECT c_custkey AS source_id, 250 AS a, 260 AS b FROM customer) SELECT s.source_id, a + coalesce(sum(CASE WHEN m + 10 <= a THEN 5 END), 0)::BIGINT AS canonical_start FROM s LEFT JOIN l ON l.source_id = s.source_id GROUP BY s.source_id, a")
def span_projection(spark, sf):
    m = F.expr("row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)") * 100
    ledger = kg.table(spark, sf, "orders").select(F.col("o_custkey").alias("source_id"), m.alias("mutated_start")).selectExpr("source_id", "mutated_start", "mutated_start + 10 AS mutated_end", "mutated_start AS canonical_start", "mutated_start + 15 AS canonical_end")
    spans = kg.table(spark, sf, "customer").select(F.col("c_custkey").alias("source_id"), F.lit(250).cast("long").alias("start"), F.lit(260).cast("long").alias("end"))
    return relational.projected(spans, ledger).select("source_id", "canonical_start")


def log(spark, sf):
    return kg.table(spark, sf, "events").select(F.col("event_id").alias("seq_id"), F.col("user_id").alias("entity_id"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.col("props").alias("payload"))


LAST = "l AS (SELECT user_id AS entity_id, max(event_id) AS seq_id, arg_max(CASE event_type WHEN 'error' THEN 'delete' ELSE 'upsert' END, event_id) AS op, arg_max(props, event_id) AS payload FROM events GROUP BY 1)"


@query("change_page", "SELECT event_id AS seq_id, user_id AS entity_id FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def change_page(spark, sf):
    return sync.after(log(spark, sf), 500, 100).select("seq_id", "entity_id")


@query("changes_applied", f"WITH {LAST} SELECT * FROM l WHERE op <> 'delete'")
def changes_applied(spark, sf):
    c = log(spark, sf)
    half = F.col("seq_id") % 2 == 0
    return sync.live(sync.applied(sync.applied(c.limit(0), c.filter(half)), c.filter(~half))).select("entity_id", "seq_id", "op", "payload")


@query("changes_streamed", f"WITH {LAST} SELECT * FROM l WHERE op <> 'delete'")
def changes_streamed(spark, sf):
    schema = kg.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("recursiveFileLookup", "true").load(sf)
    stream = raw.select(F.col("event_id").alias("seq_id"), F.col("user_id").alias("entity_id"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.col("props").alias("payload"))
    base = f"{shared_folder(spark)}/sync-{uuid.uuid4().hex}"
    sync.sync(spark, stream, base, merge_every=1)
    return sync.live(sync.synced(spark, base)).select("entity_id", "seq_id", "op", "payload")


JOBS = "j AS (SELECT event_id AS id, event_id // 4 AS source_id, CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'error' THEN 'dead' ELSE 'succeeded' END AS status, ts AS next_due, event_id % 5 AS attempt, value FROM events)"


def jobs(spark, sf):
    t = F.col("event_type")
    return kg.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.expr("event_id div 4").alias("source_id"), F.when(t == "click", "pending").when(t == "view", "running").when(t == "error", "dead").otherwise("succeeded").alias("status"), F.col("ts").alias("next_due"), (F.col("event_id") % 5).alias("attempt"), "value")


@query("job_claims", f"WITH {JOBS} SELECT id FROM j WHERE status = 'pending' AND next_due <= TIMESTAMP '2024-01-20' ORDER BY next_due, id LIMIT 50")
def job_claims(spark, sf):
    return sync.claimed(jobs(spark, sf), F.lit("2024-01-20").cast("timestamp_ntz"), 50).select("id")


@query("job_states", f"WITH {JOBS} SELECT id, CASE WHEN status = 'running' THEN CASE WHEN attempt >= 3 THEN 'dead' ELSE 'pending' END ELSE status END AS after_fail, CASE status WHEN 'pending' THEN 'running' ELSE status END AS after_claim FROM j")
def job_states(spark, sf):
    step = lambda e: sync.transition(F.col("status"), F.lit(e), F.col("attempt"), F.lit(3))
    return jobs(spark, sf).select("id", step("fail").alias("after_fail"), step("claim").alias("after_claim"))


@query("fan_in", f"WITH {JOBS} SELECT source_id, CASE WHEN count(*) FILTER (status = 'dead') > 0 THEN 'partial' ELSE 'complete' END AS state FROM j GROUP BY 1 HAVING count(*) FILTER (status IN ('pending', 'running')) = 0")
def fan_in(spark, sf):
    return sync.fan_in(jobs(spark, sf))


@query("enqueued_jobs", "SELECT user_id AS idempotency_key, min(event_id) AS id FROM events WHERE value > 20 AND user_id NOT IN (SELECT user_id FROM events WHERE value < 0.5) GROUP BY 1")
def enqueued_jobs(spark, sf):
    e = kg.table(spark, sf, "events").select(F.col("user_id").alias("idempotency_key"), F.col("event_id").alias("id"), "value")
    return sync.enqueued(e.filter("value < 0.5").select("idempotency_key", "id"), e.filter("value > 20").select("idempotency_key", "id"))


@query("consolidation_trigger", "WITH d AS (SELECT event_type AS topic, event_id AS id, sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total, coalesce(epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id), 0) AS gap, value FROM events) SELECT topic, id, gap >= 3600 OR value > 50 OR total > 10000 AS fires FROM d")
def consolidation_trigger(spark, sf):
    d = kg.table(spark, sf, "events").select(F.col("event_type").alias("topic"), F.col("event_id").alias("id"), "ts", F.col("value").alias("delta"))
    return sync.triggered(d, 3600, 50.0, 10_000.0).select("topic", "id", "fires")


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    return sync.windowed(kg.table(spark, sf, "events")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("lexical_search", r"WITH d AS (SELECT doc_id AS id, string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') AS w FROM documents), h AS (SELECT id, len(w) AS n, list_filter(w, lambda x: x IN ('thre', 'tion')) AS h FROM d) SELECT id, round(len(h) / (1 + ln(n)), 6) AS score FROM h WHERE len(list_distinct(h)) = 2 ORDER BY score DESC, id LIMIT 50")
def lexical_search(spark, sf):
    d = kg.sources(spark, sf).select("id", "content")
    return retrieve.lexical(d, "the thre, tion").withColumn("score", F.round("score", 6))


WORDS = r"SELECT doc_id AS id, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS t FROM documents"


@query("web_search", f"""WITH w AS ({WORDS}), d AS (SELECT id, t, len(string_split(trim(t), ' ')) AS n, string_split(trim(t), ' ') AS ws FROM w)
SELECT id, round((len(list_filter(ws, lambda x: x IN ('ther', 'tion'))) + (length(replace(t, ' ', '  ')) - length(replace(replace(t, ' ', '  '), ' and  the ', ''))) // 10) / (1 + ln(n)), 6) AS score FROM d
WHERE (contains(t, ' ther ') AND contains(t, ' and the ') OR contains(t, ' tion ')) AND NOT contains(t, ' thre ') ORDER BY round((len(list_filter(ws, lambda x: x IN ('ther', 'tion'))) + (length(replace(t, ' ', '  ')) - length(replace(replace(t, ' ', '  '), ' and  the ', ''))) // 10) / (1 + ln(n)), 12) DESC, id LIMIT 50""")
def web_search(spark, sf):
    return retrieve.websearch(kg.sources(spark, sf).select("id", "content"), 'ther "and the" or tion -thre').withColumn("score", F.round("score", 6))


@query("lexical_fallback", f"WITH p AS (SELECT p_partkey AS id, p_name AS content, {TRI.format(repr('red widgit'))} AS q, {TRI.format('p_name')} AS t FROM part), s AS (SELECT id, len(list_intersect(t, q)) / len(list_distinct(list_concat(t, q))) AS score FROM p) SELECT id, round(score, 9) AS score FROM s WHERE score >= 0.1 ORDER BY round(score, 12) DESC, id LIMIT 50")
def lexical_fallback(spark, sf):
    p = kg.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("content"))
    return retrieve.lexical_or_fuzzy(p, "red widgit").withColumn("score", F.round("score", 9))


@query("temporal_search", "SELECT event_id AS id, round(CASE WHEN epoch(TIMESTAMP '2024-01-25' - ts) < -60 THEN 0.1 ELSE 1 / (1 + greatest(epoch(TIMESTAMP '2024-01-25' - ts), 0) / 86400) END, 9) AS score FROM events ORDER BY round(score, 12) DESC, id LIMIT 50")
def temporal_search(spark, sf):
    e = kg.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return retrieve.temporal(e, F.lit("2024-01-25").cast("timestamp")).withColumn("score", F.round("score", 9))


@query("graph_seeds", f"{WITH} SELECT id, 1 AS matches FROM nodes WHERE contains(lower(name), 'nation_1') OR contains('nation_1', lower(name)) ORDER BY id LIMIT 10")
def graph_seeds(spark, sf):
    return retrieve.seeds(kg.nodes(spark, sf), "nation_1")


@query("graph_dimension")
def graph_dimension(spark, sf):
    return retrieve.graph_dimension(kg.nodes(spark, sf), valid(spark, sf), "nation_3 and region", 2).withColumn("score", F.round("score", 9))


@query("structural_dimension")
def structural_dimension(spark, sf):
    return retrieve.structural(kg.nodes(spark, sf), valid(spark, sf), "red widget").withColumn("score", F.round("score", 9))


@query("fuzzy_names", f"WITH q AS (SELECT {TRI.format(repr('red widgit'))} AS tq), p AS (SELECT p_partkey AS id, {TRI.format('p_name')} AS tp FROM part), s AS (SELECT id, len(list_intersect(tp, tq)) / len(list_distinct(list_concat(tp, tq))) AS score FROM p, q) SELECT id, round(score, 9) AS score FROM s WHERE score >= 0.1 ORDER BY round(score, 12) DESC, id LIMIT 50")
def fuzzy_names(spark, sf):
    p = kg.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return retrieve.fuzzy(p, "red widgit").withColumn("score", F.round("score", 9))


@query("query_expansion", f"""{WITH}, {LISTS}, f AS (SELECT id * 10 + 2 AS id, sum(w / (60 + rank)) AS score FROM ranked JOIN weights USING (dimension) GROUP BY 1), b AS (SELECT id FROM f ORDER BY score DESC, id LIMIT 5),
m AS (SELECT src AS seed, dst AS id, confidence, id AS edge FROM edges UNION ALL SELECT dst, src, confidence, id FROM edges),
n AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY confidence DESC, id, edge) AS k FROM m WHERE seed IN (SELECT id FROM b) AND id NOT IN (SELECT id FROM b)),
x AS (SELECT id, (SELECT min(score) FROM f) * 0.5 * least(sum(confidence), 1) AS score FROM n WHERE k <= 5 AND id NOT IN (SELECT id FROM f) GROUP BY id) SELECT id, round(score, 9) AS score FROM (FROM f UNION ALL FROM x)""")
def query_expansion(spark, sf):
    f = fusion.rrf(fusion.ranked(lists(spark, sf))).select((F.col("id") * 10 + 2).alias("id"), "score")
    return retrieve.expanded(f, kg.edges(spark, sf)).withColumn("score", F.round("score", 9))


@query("graph_context", f"""{WITH}, v AS (SELECT * FROM edges WHERE NOT invalid), b AS (SELECT DISTINCT src AS id, dst AS o, rel_type, 'out' AS dir FROM v WHERE src IN (12, 14, 15) UNION ALL SELECT DISTINCT dst, src, rel_type, 'in' FROM v WHERE dst IN (12, 14, 15)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dir DESC, o, rel_type)::INT AS n FROM b) SELECT r.id, n, name, rel_type, dir FROM r JOIN nodes ON nodes.id = o WHERE n <= 10""")
def graph_context(spark, sf):
    return retrieve.context_of(spark.createDataFrame([(12,), (14,), (15,)], "id long"), kg.nodes(spark, sf), valid(spark, sf)).select("id", F.explode("context").alias("c")).select("id", "c.n", "c.name", "c.rel_type", "c.dir")


@query("search")
def search(spark, sf):
    """Six dimensions, over sources; the graph's nodes and edges stand for the sources of their number."""
    s = kg.sources(spark, sf)
    n = s.count()
    of = lambda c: F.expr(f"({c} div 10) % {n}")
    named = F.lower("title").isin("thre", "tion", "src1")
    items = s.select("id", F.col("title").alias("name"), "content", "uri", F.when(F.col("id") % 5 == 0, "node").otherwise("chunk").alias("result_type"), "source_type", F.lit("document").alias("node_type"), F.when(F.col("source_type") == "code", "code").otherwise("text").alias("entity_class"), "domains", ((F.col("id") % 100) / 100).alias("confidence"), named.alias("named"), (F.col("source_type") == "manual").alias("internal"))
    lex = retrieve.lexical(items, "thre tion").withColumn("dimension", F.lit("lexical"))
    near = retrieve.graph_dimension(kg.nodes(spark, sf), valid(spark, sf), "nation_3 and region", 2).groupBy(of("id").alias("id")).agg(F.max("score").alias("score")).withColumn("dimension", F.lit("graph"))
    v = vectors(spark, sf)
    wide = curate.global_dimension(v.filter("label < 3"), v.filter("label BETWEEN 3 AND 6"), v.filter("label > 6"), probe(spark, sf), 12).select("id", "score", F.lit("global").alias("dimension"))
    edges = valid(spark, sf).withColumns({"src": of("src"), "dst": of("dst")})
    every = lists(spark, sf)
    for more in (lex, near, wide):
        every = every.unionByName(more.select(*every.columns))
    out = retrieve.search(every, items, edges, None, 10, 0.05, ["document", "web_page", "manual", "code"], lambda text: F.size(F.split(text, "tion")) / F.log2(F.length(text) + 2))
    return out.select("id", "name", "result_type", F.round("score", 9).alias("score"))


@query("query_cache", "SELECT a.vec_id AS query_id, arg_min(b.vec_id, {'d': round(greatest(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0), 9), 'k': b.vec_id}) AS cache_id FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.label = b.label AND b.vec_id % 3 <> 0 AND 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) < 0.4 GROUP BY 1")
def query_cache(spark, sf):
    v = vectors(spark, sf).withColumn("strategy", F.col("label"))
    at = F.when(F.col("id") % 3 != 0, F.lit("2024-01-01 11:30:00")).otherwise(F.lit("2024-01-01 09:00:00")).cast("timestamp_ntz")
    # A third of the cache is too old. The queries are the stated set: ids divisible by 50.
    return retrieve.cached(v.filter("id % 50 = 0"), v.withColumn("at", at), F.lit("2024-01-01 12:00:00").cast("timestamp"), within=0.4).select("query_id", "cache_id")


@query("snippets", r"""WITH d AS (SELECT doc_id, text, strpos(lower(text), 'tion') AS place FROM documents WHERE contains(lower(text), 'tion')), b AS (SELECT *, greatest(place - 60, 1) AS b FROM d), p AS (SELECT *, substr(text, b, 120) AS p FROM b),
q AS (SELECT *, CASE WHEN b > 1 THEN '...' || regexp_replace(p, '^[^ \t\n\x0B\f\r]{0,29}[ \t\n\x0B\f\r]+', '') ELSE p END AS q FROM p) SELECT doc_id, CASE WHEN b + 120 <= length(text) THEN regexp_replace(q, '[ \t\n\x0B\f\r]+[^ \t\n\x0B\f\r]{0,29}$', '') || '...' ELSE q END AS snippet FROM q""")
def snippets(spark, sf):
    return kg.table(spark, sf, "documents").filter(F.lower("text").contains("tion")).select("doc_id", fusion.snippet(F.col("text"), F.lit("tion"), 120).alias("snippet"))


@query("memory_recall", "SELECT event_id AS id FROM events WHERE event_type = 'view' AND (event_id % 3 <> 0 OR ts > TIMESTAMP '2024-01-15') AND user_id < 50 ORDER BY value DESC, id LIMIT 20")
def memory_recall(spark, sf):
    e = kg.table(spark, sf, "events")
    m = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("topic"), F.when(F.col("user_id") < 50, "a").otherwise("b").alias("agent"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("expires_at"))
    return memory.recalled(m, e.select(F.col("event_id").alias("id"), F.col("value").alias("score")), F.lit("2024-01-15").cast("timestamp_ntz"), "a", "view", 20).select("id")


@query("memory_forget", "SELECT event_id AS id FROM events WHERE CASE WHEN event_id % 3 = 0 THEN ts <= TIMESTAMP '2024-01-15' ELSE ts < TIMESTAMP '2024-01-15' - INTERVAL 10 DAY END")
def memory_forget(spark, sf):
    m = kg.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("expires_at"), F.col("ts").alias("created_at"))
    return memory.forgotten(m, F.lit("2024-01-15").cast("timestamp_ntz"), 10).select("id")


@query("memory_groups")
def memory_groups(spark, sf):
    m = vectors(spark, sf).select("id", F.col("label").alias("topic"), "embedding")
    return memory.consolidated(m, 0.2).select("id", "topic", "group")


@query("session_memories", "SELECT conv_id AS session, count(*) AS n FROM (SELECT conv_id, unnest(string_split(text, chr(10))) AS line FROM conversations WHERE role = 'assistant') WHERE trim(line) <> '' GROUP BY 1")
def session_memories(spark, sf):
    return memory.reflected(kg.table(spark, sf, "conversations")).groupBy("session").agg(F.count("*").alias("n"))


@query("context_assembly", f"""{WITH}, r AS (SELECT id, title, lang, content, ceil(strlen(content) / 4)::BIGINT AS tokens, 1 / (1 + id % 53) AS score FROM (SELECT s.*, domains[1] AS lang FROM sources s)),
a AS (SELECT *, row_number() OVER (PARTITION BY lang, title ORDER BY score DESC, id) AS k FROM r), b AS (SELECT *, sum(tokens) OVER (PARTITION BY lang ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM a WHERE k <= 3)
SELECT lang, id, row_number() OVER (PARTITION BY lang ORDER BY score DESC, id) AS n FROM b WHERE used <= 8000""")
def context_assembly(spark, sf):
    r = kg.sources(spark, sf).select("id", F.col("title").alias("source"), F.col("domains").getItem(0).alias("lang"), "content", F.lit(None).cast("string").alias("snippet"), F.col("title").alias("name"), (1 / (1 + F.col("id") % 53)).alias("score"))
    return memory.context(r, "lang").select("lang", "id", F.col("n").cast("long").alias("n"))


@query("community_summaries", f"""{WITH}, v AS (SELECT * FROM edges WHERE NOT invalid), m AS (SELECT id, (id // 10) % 5 AS community, name, mention_count FROM nodes), k AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY mention_count DESC, id) AS r FROM m),
x AS (SELECT community, string_agg(name, ', ' ORDER BY r) AS x FROM k WHERE r <= 10 GROUP BY 1), e AS (SELECT DISTINCT src, dst, rel_type FROM v), l AS (SELECT a.community, a.name || ' --[' || rel_type || ']--> ' || b.name AS t, row_number() OVER (PARTITION BY a.community ORDER BY src, dst, rel_type) AS r FROM e JOIN m a ON a.id = src JOIN m b ON b.id = dst WHERE a.community = b.community),
y AS (SELECT community, string_agg(t, '; ' ORDER BY r) AS y FROM l WHERE r <= 10 GROUP BY 1) SELECT community, 'Key entities: ' || x || '.' || coalesce(' Relationships: ' || y || '.', '') AS summary FROM x LEFT JOIN y USING (community)""")
def community_summaries(spark, sf):
    return memory.community_summary(members(spark, sf), kg.nodes(spark, sf), valid(spark, sf))


@query("answer_prompt", f"""{WITH}, n AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM nodes WHERE node_type = 'component') SELECT node_type, string_agg('[' || n || '] (component, confidence: 0.90, ' || domain || ', graph)' || chr(10) || name[1:2000], chr(10) || chr(10) ORDER BY n) AS blocks FROM n GROUP BY 1""")
def answer_prompt(spark, sf):
    n = kg.nodes(spark, sf).filter("node_type = 'component'").select("id", "node_type", "domain", F.col("name").alias("content"), F.lit("graph").alias("source"), F.lit(0.9).alias("confidence"), F.expr("row_number() OVER (PARTITION BY node_type ORDER BY id)").alias("n"))
    return memory.prompt(n, "node_type")


@query("canonical_relations", f"""{WITH}, k AS (SELECT rel_type, count(*) AS n, {TRI.format('any_value(rel_type)')} AS tk FROM edges GROUP BY 1), q AS (SELECT name, {TRI.format('trim(name)')} AS tq FROM (VALUES ('Supply'), ('located in'), ('part-of'), ('unheard')) t(name)),
s AS (SELECT name, rel_type, n, len(list_intersect(tk, tq)) / len(list_distinct(list_concat(tk, tq))) AS s FROM q, k) SELECT name, coalesce(arg_max(rel_type, {{'s': s * ln(n + 1), 'r': rel_type}}) FILTER (s >= 0.4), lower(trim(name))) AS canonical FROM s GROUP BY name""")
def canonical_relations(spark, sf):
    e = kg.edges(spark, sf)
    known = e.groupBy("rel_type").agg(F.count("*").alias("n"))
    names = spark.createDataFrame([("Supply",), ("located in",), ("part-of",), ("unheard",)], "name string")
    return relational.canonical_rel(names, known)
