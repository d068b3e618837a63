"""Matching of adapters and profiles, links between code, design and research, edits of nodes, reports and context choice.

Configured tables (adapters, profiles, path patterns) become ``CASE`` expressions, so that matching needs no join whatever
the size of the data. Comparisons of vectors go through ``relational``.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vector as V
from ..plans.lineage import cut
from . import epistemic, fusion, graph, relational

#: profile: (chunk size, overlap)
PROFILES = {"document": (1500, 200), "code": (2000, 100), "web_page": (1200, 150), "manual": (1000, 100)}


def first_of(tests: list[tuple[Column, str]]) -> Column:
    """The name of the first test that holds; null if none does."""
    return F.coalesce(*(F.when(test, F.lit(name)) for test, name in tests)) if tests else F.lit(None).cast("string")


def adapter_of(uri: Column, mime: Column, adapters: list[dict]) -> Column:
    """By host and MIME type, then host alone, then MIME type alone, then a pattern of the URI; the first of each by order."""
    host = F.lower(F.regexp_extract(uri, r"^[a-zA-Z]+://([^/:?#]+)", 1))
    bare = F.lower(F.trim(F.regexp_replace(mime, ";.*$", "")))
    tiers: list[list[tuple[Column, str]]] = [[], [], [], []]
    for a in adapters:
        by_host, by_mime = host == F.lit(a.get("host")), bare == F.lit(a.get("mime"))
        if a.get("host"):
            tiers[0 if a.get("mime") else 1].append((by_host & by_mime if a.get("mime") else by_host, a["name"]))
        elif a.get("mime"):
            tiers[2].append((by_mime, a["name"]))
        elif a.get("uri_regex"):
            tiers[3].append((uri.rlike(a["uri_regex"]), a["name"]))
    return first_of([x for tier in tiers for x in tier])


def profile_of(source_type: Column, uri: Column, prefixes: dict[str, str] | None = None) -> Column:
    """(name, size, overlap): by the URI's prefix, then by type, else that of documents."""
    name = first_of([(F.startswith(uri, F.lit(p)), n) for p, n in (prefixes or {}).items()] + [(source_type == n, n) for n in PROFILES])
    name = F.coalesce(name, F.lit("document"))
    part = lambda k: F.coalesce(*(F.when(name == n, F.lit(v[k])) for n, v in PROFILES.items()))
    return F.struct(name.alias("name"), part(0).alias("size"), part(1).alias("overlap"))


def scratch_uri(uri: Column) -> Column:
    return F.startswith(uri, F.lit("/tmp/")) | F.startswith(uri, F.lit("file:///tmp/"))


def effective_type(source_type: Column, domains: Column) -> Column:
    return F.when(F.array_contains(domains, "code"), "code").otherwise(source_type)


def spec_concept(name: Column, node_type: Column, entity_class: Column, domain: Column, mentions: Column, domains: list[str]) -> Column:
    """A node that stands for a concept of a specification."""
    named = (F.length(name) >= 3) & ~name.rlike("^[a-z]+$")
    return (entity_class == "domain") & domain.isin(*domains) & (mentions >= 2) & named & ~node_type.isin("technology", "actor")


def hierarchical(chunks: DataFrame, sources: DataFrame, k_sources: int = 10, k: int = 50) -> DataFrame:
    """Chunks (id, source_id, score) of the best sources (id, score); a tenth of the source's score is added."""
    best = fusion.top(sources, k_sources, F.desc("score"), "id").select(F.col("id").alias("source_id"), F.col("score").alias("_s"))
    out = chunks.join(F.broadcast(best), "source_id").select("id", "source_id", (F.col("score") + 0.1 * F.col("_s")).alias("score"))
    return fusion.top(out, k, F.desc("score"), "id")


def budgeted(items: DataFrame, query: list[float], limit: int) -> DataFrame:
    """The nearest items (id, kind, embedding) of each kind within its share of ``limit``, together at most ``limit``.

    A bounded rank by kind lets Spark keep each task's best before the shuffle.
    """
    score = F.greatest(F.lit(0.0), 1 - V.distance(F.col("embedding"), F.lit(query)))
    shares = fusion.limits(limit)
    w = Window.partitionBy("kind").orderBy(F.desc(F.round("score", 12)), "id")
    best = items.select("id", "kind", score.alias("score")).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max(shares.values()))
    within = F.coalesce(*(F.when(F.col("kind") == kind, F.col("_n") <= n) for kind, n in shares.items()))
    return fusion.top(best.filter(within).drop("_n"), limit, F.desc(F.round("score", 12)), "id")


def global_dimension(summaries: DataFrame, sections: DataFrame, articles: DataFrame, query: list[float], limit: int = 10) -> DataFrame:
    """Sections take half of the limit, two at least, community summaries the rest; articles stand in only if there are neither."""
    half = max(2, limit // 2)
    near = lambda df, n, kind: relational.top_vectors(df, query, n).select("id", F.lit(kind).alias("kind"), "score")
    own = near(summaries, max(0, limit - half), "summary").unionByName(near(sections, half, "section"))
    none = own.agg((F.count("*") == 0).alias("_none"))
    return own.unionByName(near(articles, limit, "article").join(F.broadcast(none)).filter("_none").drop("_none"))


def code_paths(nodes: DataFrame, provenance: DataFrame) -> DataFrame:
    """id, path: the node's own ``file_path``, else the URI of a source of it, those of the code domain first."""
    best = provenance.groupBy("id").agg(F.min_by("uri", F.struct(~F.array_contains("domains", "code"), "uri")).alias("_uri"))
    return nodes.join(best, "id", "left").select("id", F.coalesce("file_path", "_uri").alias("path"))


def nearest_k(left: DataFrame, right: DataFrame, k: int, least: float, known: DataFrame | Column | None = None) -> DataFrame:
    """src, dst, similarity: for each of ``left`` its ``k`` most similar of ``right`` from ``least`` on, but for ``known`` edges: rows (src, dst), or a test of src and dst."""
    pairs = relational.close_pairs(left, right, 1 - least + 1e-12).select(F.col("left_id").alias("src"), F.col("right_id").alias("dst"), (1 - F.col("distance")).alias("similarity"))
    if isinstance(known, Column):
        pairs = pairs.filter(~F.coalesce(known, F.lit(False)))
    elif known is not None:
        pairs = pairs.join(known.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    w = Window.partitionBy("src").orderBy(F.desc(F.round("similarity", 12)), "dst")
    return pairs.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def path_links(code: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """src, component: code nodes (id, path) by the first pattern that their path holds."""
    return code.select(F.col("id").alias("src"), first_of([(F.contains("path", F.lit(p)), c) for p, c in patterns]).alias("component")).filter("component IS NOT NULL")


def verification(links: DataFrame) -> DataFrame:
    """component, score: the mean of the mean similarities to research and to code."""
    mean = lambda side: F.avg(F.when(F.col("side") == side, F.col("similarity")))
    return links.groupBy("component").agg(((F.coalesce(mean("research"), F.lit(0.0)) + F.coalesce(mean("code"), F.lit(0.0))) / 2).alias("score"))


def split_node(nodes: DataFrame, edges: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``parts`` (edge_id, old, new, name): each edge named goes from the old node to the new one, which is added. Rows that repeat an edge count once."""
    parts = parts.dropDuplicates(["edge_id"])
    fresh = parts.groupBy("new").agg(F.min("name").alias("name"), F.min("old").alias("old"), F.count("*").alias("mention_count"))
    like = nodes.select(F.col("id").alias("old"), *(c for c in nodes.columns if c not in ("id", "name", "mention_count")))
    added = fresh.join(like, "old").select(F.col("new").alias("id"), *(c for c in nodes.columns if c != "id"))
    to = parts.select(F.col("edge_id").alias("id"), F.col("old").alias("_old"), F.col("new").alias("_new"))
    end = lambda c: F.when(F.col(c) == F.col("_old"), F.col("_new")).otherwise(F.col(c)).alias(c)
    moved = edges.join(to, "id", "left").select(*(end(c) if c in ("src", "dst") else F.col(c) for c in edges.columns))
    return nodes.unionByName(added), moved


def corrected(nodes: DataFrame, patch: DataFrame) -> DataFrame:
    """``patch`` (id, and columns of nodes): values that aren't null replace the node's."""
    names = [c for c in patch.columns if c != "id"]
    new = patch.select("id", *(F.col(c).alias(f"_{c}") for c in names))
    return nodes.join(new, "id", "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in names else F.col(c) for c in nodes.columns))


def annotated(nodes: DataFrame, notes: DataFrame) -> DataFrame:
    """``notes`` (id, ord, note) are added to descriptions, a line each, in order."""
    text = notes.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "note"))), lambda x: x["note"]), "\n").alias("_note"))
    return nodes.join(text, "id", "left").withColumn("description", F.concat_ws("\n", "description", "_note")).drop("_note")


def tombstoned(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """Nodes with clearance; those ``gone`` (id) have -1."""
    mark = gone.select("id", F.lit(-1).alias("_c")).distinct()
    return nodes.join(mark, "id", "left").withColumn("clearance", F.coalesce("_c", "clearance")).drop("_c")


def superseded(sources: DataFrame, key: str, order: str) -> DataFrame:
    """id, superseded_by: the next version of the same key; null for the latest."""
    w = Window.partitionBy(key).orderBy(order, "id")
    return sources.select("id", F.lead("id").over(w).alias("superseded_by"))


def alignment(ahead: DataFrame, contradictions: DataFrame, stale: DataFrame, least: float = 0.4) -> DataFrame:
    """check, subject, other, reason. ahead: (left_id, right_id, distance) of code and its nearest concept, null or far; contradictions: close pairs of
    design and research; stale: (subject, days_behind)."""
    sim = lambda c: F.format_string("%.2f", 1 - F.col(c))
    far = ahead.filter(F.col("distance").isNull() | (F.col("distance") > 1 - least))
    a = far.select(F.lit("ahead").alias("check"), F.col("left_id").alias("subject"), F.col("right_id").alias("other"), F.concat(F.lit("nearest concept at similarity "), F.coalesce(sim("distance"), F.lit("0.00"))).alias("reason"))
    c = contradictions.select(F.lit("contradiction").alias("check"), F.col("left_id").alias("subject"), F.col("right_id").alias("other"), F.concat(F.lit("similarity "), sim("distance")).alias("reason"))
    s = stale.select(F.lit("staleness").alias("check"), "subject", F.lit(None).cast("long").alias("other"), F.format_string("%.1f days behind", "days_behind").alias("reason"))
    return a.unionByName(c).unionByName(s)


def evidence(items: DataFrame, query: list[float], by: str, k: int = 15) -> DataFrame:
    """The ``k`` items (id, embedding) nearest to a claim in each domain (``by``)."""
    d = items.select(by, "id", V.distance(F.col("embedding"), F.lit(query)).alias("distance"))
    w = Window.partitionBy(by).orderBy(F.round("distance", 12), "id")
    return d.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k)


def named_chunk(content: Column, title: Column, most: int = 80) -> Column:
    """The first heading, else the first sentence, cut at ``most`` characters; a generic name is qualified by the title."""
    heading = F.trim(F.regexp_extract(content, r"(?m)^#{1,6}\s+(.+)$", 1))
    sentence = F.trim(F.regexp_extract(F.trim(content), r"^([^.!?\n]+[.!?]?)", 1))
    name = F.substring(F.coalesce(F.nullif(heading, F.lit("")), sentence), 1, most)
    generic = F.lower(name).isin("introduction", "overview", "summary", "background", "conclusion", "notes", "references", "abstract", "discussion", "results", "methods")
    return F.when(generic, F.concat(title, F.lit(" — "), name)).otherwise(name)


def at_resolution(results: DataFrame, chunks: DataFrame, sources: DataFrame, level: str) -> DataFrame:
    """id, content of results (id, source_id, parent_id) as paragraph, section or source."""
    if level == "source":
        return results.join(sources.select(F.col("id").alias("source_id"), "content"), "source_id", "left").select("id", "content")
    own = chunks.select("id", F.col("content").alias("_own"))
    out = results.join(own, "id", "left")
    if level == "section":
        out = out.join(chunks.select(F.col("id").alias("parent_id"), F.col("content").alias("_up")), "parent_id", "left")
        return out.select("id", F.coalesce("_up", "_own").alias("content"))
    return out.select("id", F.col("_own").alias("content"))


def content_types(markdown: Column) -> Column:
    """(code, table, list, example): fences anywhere; the others outside fences."""
    plain = F.regexp_replace(markdown, r"(?s)```.*?(```|$)", "")
    return F.struct(
        F.contains(markdown, F.lit("```")).alias("code"), plain.rlike(r"(?m)^\s*\|.*\|\s*$").alias("table"), plain.rlike(r"(?m)^\s*([-*+]|[0-9]+\.)\s+\S").alias("list"),
        F.lower(plain).rlike(r"for example|for instance|e\.g\.|such as").alias("example"),
    )


#: kind: (pattern, confidence); fixed values.
PRIVATE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0.95),
    "phone": (r"(?:\+?1[-. ]?)?\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}", 0.85),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.90),
    "credit_card": (r"[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}", 0.80),
}


def private_spans(text: Column) -> Column:
    """Array of (start, end, kind, confidence) by start. The places come from the lengths of matches and of what lies between."""

    def of(kind: str, pattern: str, confidence: float) -> Column:
        hits, gaps = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), F.split(text, pattern, -1)
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:long,end:long,kind:string,confidence:double>>)").alias("out"))

        def add(acc: Column, p: Column) -> Column:
            start = acc["at"] + F.length(p["gap"])
            end = start + F.length(p["hit"])
            one = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
        return F.when(F.size(hits) > 0, F.aggregate(pairs, zero, add, lambda acc: acc["out"]))

    found = F.concat(*(F.coalesce(of(k, p, c), F.expr("cast(array() as array<struct<start:long,end:long,kind:string,confidence:double>>)")) for k, (p, c) in PRIVATE.items()))
    return F.array_sort(found)


def closed(text: str | None) -> str | None:
    """JSON that breaks off, with its string, arrays and objects closed; null if that doesn't make it JSON."""
    if text is None:
        return None
    ends, quoted, skip = [], False, False
    for c in text:
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            ends.append("}" if c == "{" else "]")
        elif c in "}]" and ends:
            ends.pop()
    body = (text[:-1] if skip else text) + '"' * quoted
    for tail in (body, body.rstrip().rstrip(","), body + ":null", body + "null"):
        try:
            json.loads(done := tail + "".join(reversed(ends)))
            return done
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def repaired(texts: pd.Series) -> pd.Series:
    return texts.map(closed, na_action="ignore")


def context_scores(contexts: DataFrame, expected: DataFrame) -> DataFrame:
    """query, precision, recall: of the contexts (query, rank, content), those that hold an expected passage (query, passage), and the passages that are held."""
    hit = contexts.join(expected, "query").filter(F.contains("content", F.col("passage")))
    n = contexts.groupBy("query").agg(F.count("*").alias("_c")).join(expected.groupBy("query").agg(F.count("*").alias("_e")), "query", "full")
    got = hit.groupBy("query").agg(F.countDistinct("rank").alias("_p"), F.countDistinct("passage").alias("_r"))
    share = lambda a, b: F.coalesce(F.try_divide(F.coalesce(a, F.lit(0)), b), F.lit(0.0))
    return n.join(got, "query", "left").select("query", share("_p", "_c").alias("precision"), share("_r", "_e").alias("recall"))


def neighbourhood(edges: DataFrame, nodes: DataFrame, ids: DataFrame, most: int = 50) -> DataFrame:
    """id, dir, rel_type, other, name, invalid: the edges of each of ``ids``, at most ``most`` a direction, strongest first."""
    out = edges.join(ids, edges["src"] == ids["id"]).select(ids["id"], F.lit("out").alias("dir"), F.col("dst").alias("other"), "rel_type", "invalid", "weight", edges["id"].alias("edge"))
    back = edges.join(ids, edges["dst"] == ids["id"]).select(ids["id"], F.lit("in").alias("dir"), F.col("src").alias("other"), "rel_type", "invalid", "weight", edges["id"].alias("edge"))
    w = Window.partitionBy("id", "dir").orderBy(F.desc("weight"), "edge")
    near = out.unionByName(back).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    return near.join(nodes.select(F.col("id").alias("other"), "name"), "other").select("id", "dir", "n", "rel_type", "other", "name", "invalid")


def consolidated(nodes: DataFrame, edges: DataFrame, least: int = 2, trust_rounds: int = 50) -> DataFrame:
    """id, trust, community, between, keep, decision, bridge: the deep consolidation, in its order.

    Trust from the cleared nodes (``clearance`` of 1 or more; all if there are none); communities of the core numbers; betweenness; the
    score to keep a memory by (structure: betweenness; activation: five times trust; accommodations: 3 for cleared nodes, else 1);
    then the bridges between these very communities, lifted by betweenness.
    """
    cleared = F.col("clearance") >= 1
    some = not nodes.filter(cleared).isEmpty()
    seeds = (nodes.filter(cleared) if some else nodes).select("id", F.lit(1.0).alias("weight"))
    trust = cut(graph.rank(nodes, edges, iterations=trust_rounds, seeds=seeds, weight=graph.effective("confidence"), lose_unweighted=True).select("id", F.col("score").alias("trust")))
    groups = cut(graph.communities(nodes, edges, graph.cores(nodes, edges), least).select("id", "community"))
    between = cut(graph.betweenness(nodes, edges).select("id", F.col("score").alias("between")))
    signals = nodes.select("id", F.when(cleared, 3).otherwise(1).alias("accommodations"), F.lit(0).alias("contradiction_days")).join(trust, "id").join(between, "id")
    keep = epistemic.evicted(signals.withColumns({"structural": F.col("between"), "activation": F.col("trust") * 5})).select("id", F.col("score").alias("keep"), "decision")
    bridges = graph.bridges(edges, groups, between.withColumnRenamed("between", "score")).select("id", F.col("score").alias("bridge"))
    out = trust.join(groups, "id", "left").join(between, "id").join(keep, "id").join(bridges, "id", "left")
    return out.select("id", F.round("trust", 9).alias("trust"), "community", F.round("between", 12).alias("between"), F.round("keep", 6).alias("keep"), "decision", F.round("bridge", 6).alias("bridge"))
