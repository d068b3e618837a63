"""The six search dimensions and the search that fuses them."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.lineage import cut
from . import blocks, fusion, graph, relational


def lexical(docs: DataFrame, query: str, k: int = 50) -> DataFrame:
    """id, score of documents (id, content) with all terms of the query: occurrences of terms over 1 + ln(words).

    One pass: only the query's terms are looked up in each document's words; no index row is shuffled.
    """
    words = F.split(F.regexp_replace(F.lower("content"), r"[^\p{L}\p{N}]+", " "), " ")
    terms = docs.sparkSession.range(1).select(T.terms(F.regexp_replace(F.lit(query), r"[^\p{L}\p{N}]+", " ")).alias("t")).first()["t"]
    if not terms:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    unique = list(dict.fromkeys(terms))
    hits = F.filter(words, lambda w: w.isin(*unique))
    found = docs.select("id", hits.alias("h"), F.size(words).alias("n")).filter(F.size(F.array_distinct("h")) == len(unique))
    return found.select("id", (F.size("h") / (1 + F.ln("n"))).alias("score")).orderBy(F.desc(F.round("score", 12)), "id").limit(k)


def websearch(docs: DataFrame, query: str, k: int = 50) -> DataFrame:
    """id, score of documents (id, content) by a query in the web's form: words and "phrases" that must all be there, ``or`` between
    alternatives, ``-`` before what must not. The score: occurrences of what is asked for over 1 + ln(words)."""
    bare = lambda x: re.sub(r"[\W_]+", " ", x.lower()).strip()
    groups: list[list[str]] = [[]]
    without: list[str] = []
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        if word.lower() == "or" and not minus:
            groups.append([])
        elif found := bare(phrase or word.removeprefix("-")):
            (without if minus or word.startswith("-") else groups[-1]).append(found)
    groups = [g for g in groups if g]
    if not groups:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    text = F.trim(F.regexp_replace(F.lower("content"), r"[^\p{L}\p{N}]+", " "))
    has = lambda x: F.contains("_t", F.lit(f" {x} "))
    wanted = reduce(or_, (reduce(and_, map(has, g)) for g in groups))
    # Blanks are doubled, so that neighbours don't share one.
    wide, apart = F.replace("_t", F.lit(" "), F.lit("  ")), lambda x: f" {x.replace(' ', '  ')} "
    n = [(F.length(wide) - F.length(F.replace(wide, F.lit(apart(x)), F.lit("")))) / len(apart(x)) for x in dict.fromkeys(sum(groups, []))]
    found = docs.select("id", F.concat(F.lit(" "), text, F.lit(" ")).alias("_t"), F.size(F.split(text, " ")).alias("_n")).filter(reduce(and_, [wanted, *(~has(x) for x in without)]))
    return found.select("id", (reduce(add, n) / (1 + F.ln("_n"))).alias("score")).orderBy(F.desc(F.round("score", 12)), "id").limit(k)


def lexical_or_fuzzy(docs: DataFrame, query: str, k: int = 50, least: float = 0.1) -> DataFrame:
    """All terms; if no document has them, the query in the web's form; if none fits it, similar trigrams of the content."""
    empty = lambda df: df.agg((F.count("*") == 0).alias("_none"))
    plain, web = lexical(docs, query, k), websearch(docs, query, k)
    near = fuzzy(docs.withColumnRenamed("content", "name"), query, k, least)
    second = web.join(F.broadcast(empty(plain))).filter("_none").drop("_none")
    third = near.join(F.broadcast(empty(plain.unionByName(web)))).filter("_none").drop("_none")
    return plain.unionByName(second).unionByName(third)


def fuzzy(docs: DataFrame, query: str, k: int = 50, least: float = 0.1) -> DataFrame:
    """The fallback: names by trigram similarity with the query."""
    q = docs.sparkSession.range(1).select(T.trigrams(F.lit(query)).alias("t")).first()["t"]
    s = T.similarity(T.trigrams(F.col("name")), F.lit(q))
    return docs.select("id", s.alias("score")).filter(F.col("score") >= least).orderBy(F.desc(F.round("score", 12)), "id").limit(k)


def temporal(docs: DataFrame, now: Column, k: int = 50) -> DataFrame:
    """id, score by age in days of ``at``: 1/(1 + days); 0.1 for what lies over a minute ahead."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("at").cast("timestamp"))) / 1e6
    score = F.when(age < -60, 0.1).otherwise(1 / (1 + F.greatest(age, F.lit(0.0)) / 86400))
    return docs.select("id", score.alias("score")).orderBy(F.desc(F.round("score", 12)), "id").limit(k)


def seeds(nodes: DataFrame, query: str, k: int = 10) -> DataFrame:
    """id, matches: nodes whose name holds a term of the query, or is held by one."""
    terms = nodes.sparkSession.range(1).select(T.terms(F.lit(query)).alias("t")).first()["t"]
    low = F.lower("name")
    hits = F.size(F.filter(F.lit(terms or [""]), lambda t: low.contains(t) | t.contains(low)))
    return nodes.select("id", F.when(F.lit(bool(terms)), hits).otherwise(0).alias("matches")).filter("matches > 0").orderBy(F.desc("matches"), "id").limit(k)


def graph_dimension(nodes: DataFrame, edges: DataFrame, query: str, hops: int = 3, k: int = 50) -> DataFrame:
    """id, score: 0.7 to the power of the hops from the nearest seed, plus a tenth of that by out-degree. A seed scores only from another seed."""
    found = graph.bfs(edges, seeds(nodes, query).select("id"), hops).groupBy("id").agg(F.min("hops").alias("hops"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o"))
    base = F.pow(F.lit(0.7), F.col("hops"))
    top = out.agg(F.max("o").alias("_m"))
    j = found.join(out, "id", "left").join(F.broadcast(top))
    return j.select("id", (base + 0.1 * base * F.coalesce("o", F.lit(0)) / F.greatest("_m", F.lit(1))).alias("score")).orderBy(F.desc(F.round("score", 12)), "id").limit(k)


def structural(nodes: DataFrame, edges: DataFrame, query: str, iterations: int = 20, k: int = 50) -> DataFrame:
    """id, score: PageRank over its maximum, twice for nodes that the query names and a tenth for others."""
    terms = nodes.sparkSession.range(1).select(T.terms(F.lit(query)).alias("t")).first()["t"]
    r = graph.rank(nodes, edges, iterations=iterations)
    named = F.exists(F.lit(terms or [""]), lambda t: F.lower("name").contains(t))
    share = F.when(F.lit(not terms), 1.0).when(named, 2.0).otherwise(0.1)
    j = r.join(nodes.select("id", "name"), "id").join(F.broadcast(r.agg(F.max("score").alias("_m"))))
    return j.select("id", (F.col("score") / F.col("_m") * share).alias("score")).orderBy(F.desc(F.round("score", 12)), "id").limit(k)


def activated(seeds: DataFrame, edges: DataFrame, per_seed: int = 5) -> DataFrame:
    """id, weight: of each seed (id) the ``per_seed`` neighbours outside the seeds with the best effective confidence; a neighbour of several sums up."""
    w = graph.effective("confidence")
    e = edges.filter(~F.col("synthetic") & ~F.isnan(w) & (w >= 0))
    both = e.select(F.col("src").alias("seed"), F.col("dst").alias("id"), w.alias("w"), F.col("id").alias("edge")).unionAll(e.select(F.col("dst"), F.col("src"), w, F.col("id")))
    near = both.join(seeds.select(F.col("id").alias("seed")), "seed", "left_semi").join(seeds.select("id"), "id", "left_anti")
    best = near.withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("w"), "id", "edge"))).filter(F.col("n") <= per_seed)
    return best.groupBy("id").agg(F.sum("w").alias("weight"))


def expanded(fused: DataFrame, edges: DataFrame, top: int = 5, per_seed: int = 5) -> DataFrame:
    """``fused`` (id, score) and the neighbours of its best: last score * 0.5 * summed effective confidence, 1 at most."""
    best = fused.orderBy(F.desc("score"), "id").limit(top)
    new = activated(F.broadcast(best), edges, per_seed).join(fused.select("id"), "id", "left_anti").join(F.broadcast(fused.agg(F.min("score").alias("_last"))))
    return fused.select("id", "score").unionByName(new.select("id", (F.col("_last") * 0.5 * F.least("weight", F.lit(1.0))).alias("score")))


def textually_expanded(queries: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """id, expanded: each query (id, text) with '[Context: name (relation, ...); ...]' of the entities it names and up to ``most`` relations of each.

    Names of three bytes or more, in any case, as a run of characters. A name is looked up where its first word begins in the query,
    or where it is a part of a longer word: by the three characters it begins with, so that no query meets every name.
    """
    named = nodes.select(F.col("id").alias("node"), "name", F.lower("name").alias("_low")).filter(F.octet_length("_low") >= 3)
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.length("_q") - 1, F.lit(1))), lambda i: F.substring("_q", i, 2))
    q = queries.select(F.col("id").alias("query"), F.lower("text").alias("_q")).withColumn("_gram", F.explode(F.array_distinct(at)))
    hits = q.join(named.withColumn("_gram", F.substring("_low", 1, 2)), "_gram").filter(F.contains("_q", F.col("_low"))).select("query", "node", "name").distinct()
    e = edges.filter(~F.col("synthetic"))
    out = e.select(F.col("src").alias("node"), F.col("dst").alias("other"), "rel_type", F.lit(0).alias("side"), F.col("id").alias("edge"))
    both = out.unionAll(e.select(F.col("dst"), F.col("src"), "rel_type", F.lit(1), F.col("id")))
    rel = both.join(hits.select("node").distinct(), "node", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("side", "edge"))).filter(F.col("n") <= most)
    said = rel.join(nodes.select(F.col("id").alias("other"), F.col("name").alias("_o")), "other")
    of_node = said.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", F.concat("rel_type", F.when(F.col("side") == 1, " of ").otherwise(" "), "_o").alias("t")))).alias("rels"))
    part = F.concat("name", F.lit(" ("), F.array_join(F.transform("rels", lambda x: x["t"]), ", "), F.lit(")"))
    parts = hits.join(of_node, "node").groupBy(F.col("query").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", part.alias("t")))), lambda x: x["t"]), "; ").alias("_c"))
    return queries.join(parts, "id", "left").select("id", F.concat("text", F.coalesce(F.concat(F.lit(" [Context: "), "_c", F.lit("]")), F.lit(""))).alias("expanded"))


def context_of(ids: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """id, context: up to ``most`` neighbours (name, relation, direction), outgoing ones first."""
    e = edges.filter(~F.col("synthetic"))
    both = e.select(F.col("src").alias("id"), F.col("dst").alias("o"), "rel_type", F.lit("out").alias("dir")).unionAll(e.select(F.col("dst"), F.col("src"), "rel_type", F.lit("in")))
    near = both.join(ids.select("id"), "id", "left_semi").distinct().withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("dir"), "o", "rel_type"))).filter(F.col("n") <= most)
    named = near.join(nodes.select(F.col("id").alias("o"), "name"), "o").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "name", "rel_type", "dir"))).alias("context"))
    return named


def low_quality(content: Column) -> Column:
    return T.any_of(T.metadata_only(content), T.boilerplate_heavy(content), T.author_block(content), T.bibliography_entry(content), T.reference_section(content), T.title_only(content))


def search(lists: DataFrame, items: DataFrame, edges: DataFrame | None = None, strategy: str | None = None, limit: int = 10, least_confidence: float | None = None, source_types: list[str] | None = None, rerank: Callable[[Column], Column] | None = None) -> DataFrame:
    """The whole search over ranked lists (dimension, id, score): choose a strategy by the skew of the vector list if none is given, gate, fuse,
    abstain, expand, enrich from ``items`` (id, name, content, uri, result_type, source_type, confidence, named and, if known, internal and
    entity_class), demote, lift internal ones, blend with ``rerank`` (a score of the content), drop poor texts, filter, diversify, boost, cut.

    The fused rows, 5 * limit at most or 50, come to the driver and go back as a filter on ids: it reaches the scan of the items, and texts are judged
    only where it holds. Without it the tests of texts would be pushed below the join, to all items.
    """
    lists = cut(lists)  # a few rows that took long to find, and are used several times
    if strategy is None:
        found = fusion.route(fusion.gini(lists.filter("dimension = 'vector'"), "dimension")).first()
        strategy = found["strategy"] if found else "balanced"
    gated = fusion.gate(lists, strategy)
    norm = fusion.normalised(lists).join(F.broadcast(gated.select("dimension", "weight")), "dimension")
    active = gated.agg(F.count_if(F.col("weight") > 0).alias("_active"))
    fused = norm.groupBy("id").agg(F.sum(F.col("weight") * F.col("norm")).alias("s"), F.countDistinct("dimension").alias("dims")).join(F.broadcast(active))
    fused = cut(fused.select("id", "dims", (F.col("s") * F.when(F.col("_active") > 1, 0.5 + 0.5 * F.col("dims") / F.col("_active")).otherwise(1.0)).alias("score")))
    abstain = fusion.abstains(fused).first()["abstain"]
    if edges is not None:
        fused = expanded(fused, edges).join(fused.select("id", "dims"), "id", "left").withColumn("dims", F.coalesce("dims", F.lit(1)))
    wanted = max(5 * limit, 50) if least_confidence is not None or source_types else max(limit * 3, 30)
    best = fused.orderBy(F.desc("score"), "id").limit(0 if abstain else wanted)
    rows = best.collect()
    r = items.filter(F.col("id").isin([x["id"] for x in rows])).join(F.broadcast(items.sparkSession.createDataFrame(rows, best.schema)), "id")
    s = fusion.demoted(F.col("score"), F.col("result_type"), F.col("dims"), F.col("named"))
    r = r.withColumn("score", s).withColumn("score", fusion.code_demoted(F.col("score"), F.col("result_type"), F.col("source_type")))
    if "internal" in items.columns:
        r = fusion.self_referential(r)
    if rerank is not None:
        r = r.withColumn("_r", rerank(F.col("content"))).withColumn("_best", F.max("_r").over(Window.partitionBy(F.lit(1))))  # as many rows as were wanted
        r = r.withColumn("score", fusion.blended(F.col("score"), F.col("_r"), F.col("_best"))).drop("_r", "_best")
    r = r.filter((F.col("result_type") == "node") | ~low_quality(F.col("content")))
    r = fusion.post_filters(r, least_confidence, None, None, source_types)
    r = fusion.diversified(r).withColumn("score", fusion.boosted(F.col("score"), F.col("confidence")))
    return r.orderBy(F.desc("score"), "id").limit(limit)


def searched(query: DataFrame, cache: DataFrame, results: DataFrame, now: Column, run: Callable[[], DataFrame], ttl: int = 3600, within: float = 0.05) -> tuple[DataFrame, bool]:
    """The results of one query (id, strategy, embedding) and whether they came from the cache (id, strategy, embedding, at), whose ``results`` are
    stored under cache_id; otherwise what ``run`` finds, for the caller to store."""
    hit = cached(query, cache, now, ttl, within).first()
    return (results.filter(F.col("cache_id") == hit["cache_id"]).drop("cache_id"), True) if hit else (run(), False)


def cached(queries: DataFrame, cache: DataFrame, now: Column, ttl: int = 3600, within: float = 0.05) -> DataFrame:
    """query_id, cache_id: the nearest cached query of the same strategy, near and young enough. The cache is bounded at 10,000 rows."""
    young = cache.filter(F.unix_micros(now) - F.unix_micros(F.col("at").cast("timestamp")) <= ttl * 1_000_000)
    # Distances are rounded before they are compared: what is a little farther than ``within`` may pass.
    near = blocks.best(queries, young, 1, 9, within=within + 1e-8, by="strategy").select("left_id", F.col("right_id").alias("cache_id"), F.round(F.greatest(1 - F.col("cosine"), F.lit(0.0)), 9).alias("d"))
    return near.filter(F.col("d") < within).groupBy(F.col("left_id").alias("query_id")).agg(F.min(F.struct("d", "cache_id")).alias("m")).select("query_id", F.col("m.cache_id").alias("cache_id"), F.col("m.d").alias("distance"))


def latest_kept(cache: DataFrame, most: int = 10_000) -> DataFrame:
    return cache.orderBy(F.desc("at"), F.desc("id")).limit(most)


def by_component(edges: DataFrame, code: DataFrame, near: DataFrame) -> DataFrame:
    """Code nodes (id) of the components (component, distance) that research is near: nearest first."""
    part = relational.valid(edges).filter(F.col("rel_type") == "PART_OF_COMPONENT").select(F.col("src").alias("id"), F.col("dst").alias("component"))
    first = near.groupBy("component").agg(F.min("distance").alias("distance"))  # one row for each component, before code meets research
    return code.join(part, "id").join(first, "component").groupBy("id").agg(F.min("distance").alias("distance")).orderBy("distance", "id")
