"""Analyses by joins and aggregates over the graph's frames."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..plans.lineage import cut, without
from . import blocks


def page(df: DataFrame, offset: int, limit: int, *order) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def by_ids(df: DataFrame, ids: list[int]) -> DataFrame:
    return df.filter(F.col("id").isin(*ids))


def unseen(new: DataFrame, known: DataFrame, key: str = "content_hash") -> DataFrame:
    """Rows of ``new`` whose hash isn't known."""
    return new.join(known.select(key).distinct(), key, "left_anti")


def valid(edges: DataFrame) -> DataFrame:
    return edges.filter(~F.col("invalid"))


def provenance(extractions: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """entity_id, uri, title of the sources that support an entity."""
    c = chunks.select(F.col("id").alias("chunk_id"), "source_id")
    s = sources.select(F.col("id").alias("source_id"), "uri", "title")
    return extractions.join(c, "chunk_id").join(s, "source_id").select("entity_id", "uri", "title").distinct()


def triples(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """subject, predicate, object, confidence of the valid edges."""
    s, o = (nodes.select(F.col("id").alias(k), F.col("name").alias(n)) for k, n in (("src", "subject"), ("dst", "object")))
    return valid(edges).join(s, "src").join(o, "dst").select("subject", F.col("rel_type").alias("predicate"), "object", "confidence")


def without_edge(nodes: DataFrame, edges: DataFrame, rel_type: str, end: str = "src") -> DataFrame:
    return without(nodes, valid(edges).filter(F.col("rel_type") == rel_type).select(F.col(end).alias("id")).distinct(), "id")


def with_edge(nodes: DataFrame, edges: DataFrame, rel_type: str, end: str = "src") -> DataFrame:
    return nodes.join(valid(edges).filter(F.col("rel_type") == rel_type).select(F.col(end).alias("id")).distinct(), "id", "left_semi")


def endpoints(edges: DataFrame) -> DataFrame:
    """id, other: each edge from both ends."""
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "invalid", "rel_type", "confidence").unionAll(edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), "invalid", "rel_type", "confidence"))


def ungrounded(nodes: DataFrame, extractions: DataFrame) -> DataFrame:
    return without(nodes, extractions.select(F.col("entity_id").alias("id")).distinct(), "id")


def degrees(edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree over valid edges: one union and one aggregate."""
    e = valid(edges)
    both = e.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(e.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def cooccurrence(extractions: DataFrame, least: int = 2, known: DataFrame | None = None, degree: DataFrame | None = None, max_degree: int | None = None) -> DataFrame:
    """a, b, n: pairs of entities that share ``least`` chunks or more, a < b, not yet linked, both of a degree below ``max_degree``."""
    one = extractions.select("chunk_id", "entity_id").distinct()
    # An entity of too large a degree, or in too few chunks, is in no pair: both go before the join.
    if degree is not None and max_degree is not None:
        one = one.join(degree.filter(F.col("out_degree") + F.col("in_degree") >= max_degree).select(F.col("id").alias("entity_id")), "entity_id", "left_anti")
    if least > 1:
        one = one.join(one.groupBy("entity_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("entity_id"), "entity_id", "left_semi")
    one = cut(one)  # both sides of the join come from here
    x, y = one.withColumnRenamed("entity_id", "a"), one.withColumnRenamed("entity_id", "b")
    pairs = x.join(y, "chunk_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    if known is not None:
        pairs = pairs.join(known.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")), ["a", "b"], "left_anti")
    return pairs.select("a", "b", "n")


def synthetic_edges(pairs: DataFrame, *also: str) -> DataFrame:
    """src, dst, rel_type, weight, confidence, synthetic of the pairs (a, b, n), and the columns of theirs in ``also``."""
    n = F.col("n")
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("co_occurs").alias("rel_type"), F.least(n / 5, F.lit(1.0)).alias("weight"), F.least(0.3 + 0.1 * n, F.lit(0.9)).alias("confidence"), F.lit(True).alias("synthetic"), *also)


def tables_for(similarity: float, recall: float, bits: int) -> int:
    p = 1 - math.acos(max(-1.0, min(1.0, similarity))) / math.pi
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p**bits)))


def sketched(df: DataFrame, similarity: float, recall: float, bits: int) -> DataFrame:
    """``df`` (id, embedding) with _cell: a row for each table of random hyperplanes, so many that vectors of ``similarity`` share a
    cell with probability ``recall``. A cell holds about 2^-bits of all vectors of one length; the planes come from a hash, not from data."""
    tables = tables_for(similarity, recall, bits)
    # One plane's numbers for a coordinate: normal deviates would do; signs from a hash are as good and need no table.
    side = lambda t, b: F.aggregate(F.transform("embedding", lambda x, k: F.when(F.xxhash64(F.lit(t), F.lit(b), k) % 2 == 0, x.cast("double")).otherwise(-x.cast("double"))), F.lit(0.0), lambda s, x: s + x) >= 0
    cell = lambda t: F.concat_ws(":", F.lit(str(t)), F.size("embedding"), *(F.when(side(t, b), "1").otherwise("0") for b in range(bits)))
    return df.withColumn("_cell", F.explode(F.array(*(cell(t) for t in range(tables)))))


def close_pairs(left: DataFrame, right: DataFrame, within: float, recall: float | None = None, bits: int = 8) -> DataFrame:
    """left_id, right_id, distance of vectors nearer than ``within``.

    Without ``recall``: all pairs are compared, exactly (``blocks``). With it: only pairs that share a cell of ``sketched``, which
    finds at least that share of them in the mean; ``bits`` should grow as the logarithm of the sets. Pairs are compared inside
    their cell, so that only near ones leave it; cells that would meet half of all pairs or more give way to the exact comparison.
    """
    d = F.greatest(1 - F.col("cosine"), F.lit(0.0)).alias("distance")
    if recall is None or tables_for(1 - within, recall, bits) * 2.0**-bits >= 0.5:
        return blocks.close(left, right, within).select("left_id", "right_id", d)
    cells = lambda df: sketched(df.select("id", "embedding"), 1 - within, recall, bits)
    return blocks.close(cells(left), cells(right), within, "_cell").distinct().select("left_id", "right_id", d)


def most_similar(left: DataFrame, right: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """left_id, right_id, cosine, rank: the ``k`` on the right of the largest cosine, ``digits`` of them counted, for each on the left but itself; ties by id."""
    top = blocks.best(left, right, k, digits, others=True).withColumn("cosine", F.round("cosine", digits))
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("cosine"), "right_id"))).filter(F.col("rank") <= k)


def nearest(left: DataFrame, right: DataFrame, within: float | None = None) -> DataFrame:
    """left_id, right_id, distance: the nearest on the right for each on the left, nearer than ``within`` if given; ties by id. Exact."""
    d = blocks.best(left, right, 1, 12, within=math.inf if within is None else within).select("left_id", "right_id", F.greatest(1 - F.col("cosine"), F.lit(0.0)).alias("distance"))
    return d.groupBy("left_id").agg(F.min(F.struct(F.round("distance", 12).alias("d"), F.col("right_id").alias("r"))).alias("m")).select("left_id", F.col("m.r").alias("right_id"), F.col("m.d").alias("distance"))


def top_vectors(df: DataFrame, query: list[float], k: int) -> DataFrame:
    """id, score of the k nearest: a bounded sort in each task, no shuffle of vectors."""
    d = V.distance(F.col("embedding"), F.lit(query))
    return df.select("id", F.greatest(1 - d, F.lit(0.0)).alias("score")).orderBy(F.desc(F.round("score", 12)), "id").limit(k)


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key (as of now): an aggregate, so that no key is sorted."""
    cols = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*cols), F.struct(F.col(order), *(F.col(c) for c in cols if c == "id"))).alias("r")
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, "r.*")


def overlapping(spans: DataFrame, keys: list[str]) -> DataFrame:
    """id, n: how many other spans (begin, end: half-open, null is open) with the same ``keys`` overlap each one.

    These are the ones that begin before its end, without those that end by its beginning. Both counts come from the sorted
    union of beginnings and ends: sums by day first, then inside a day, so that a key with very many spans is spread over days.
    """
    at = lambda column, kind: spans.filter(F.col(column).isNotNull()).select("id", *keys, F.col(column).alias("_t"), F.lit(kind).alias("_kind"))
    marks = at("end", 0).unionByName(at("begin", 1)).withColumn("_day", F.date_trunc("day", "_t"))
    ends, begins = F.sum((F.col("_kind") == 0).cast("long")), F.sum((F.col("_kind") == 1).cast("long"))
    days = marks.groupBy(*keys, "_day").agg(ends.alias("_ends"), begins.alias("_begins"))
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*keys, "_day", F.coalesce(F.sum("_ends").over(before), F.lit(0)).alias("_e0"), F.coalesce(F.sum("_begins").over(before), F.lit(0)).alias("_b0"))
    inside = Window.partitionBy(*keys, "_day").orderBy("_t", "_kind")
    run = marks.withColumns({"_e1": ends.over(inside), "_b1": begins.over(inside)}).join(days, [*keys, "_day"])
    # At an end: beginnings before it; at a beginning: ends up to it, taken off.
    known = run.groupBy("id").agg(F.sum(F.when(F.col("_kind") == 0, F.col("_b0") + F.col("_b1")).otherwise(-(F.col("_e0") + F.col("_e1")))).alias("_n"))
    totals = spans.groupBy(*keys).agg(F.count("*").alias("_all"), F.count_if(F.col("begin").isNull()).alias("_open"))
    one = spans.join(totals, keys).join(known, "id", "left")
    # Spans that are open at the beginning begin before any end; one with an open end ends after all have begun.
    return one.select("id", (F.coalesce("_n", F.lit(0)) + F.when(F.col("end").isNull(), F.col("_all")).otherwise(F.col("_open")) - 1).alias("n"))


def conflicts(edges: DataFrame, functional: list[str] | None = None) -> DataFrame:
    """Adds conflict: whether another edge has the same start and relation, another target, and an overlapping validity.

    Edges (id, src, dst, rel_type, valid_from, valid_until; null: open) that are ``invalid``, or valid at no time, have no part in
    this. An edge has a conflict if it overlaps more edges of its start and relation than of its target too; no pairs are made.
    """
    held = F.coalesce(F.col("valid_from") < F.col("valid_until"), F.lit(True))
    e = edges.filter(held & ~F.col("invalid")) if "invalid" in edges.columns else edges.filter(held)
    e = (e if functional is None else e.filter(F.col("rel_type").isin(*functional))).select("id", "src", "dst", "rel_type", F.col("valid_from").alias("begin"), F.col("valid_until").alias("end"))
    every, same = overlapping(e, ["src", "rel_type"]), overlapping(e, ["src", "rel_type", "dst"])
    hit = every.join(same.withColumnRenamed("n", "m"), "id").filter("n > m").select("id", F.lit(True).alias("conflict"))
    return edges.join(hit, "id", "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))


def overlap_in_time(from_a: Column, until_a: Column, from_b: Column, until_b: Column) -> Column:
    """Half-open intervals, null is open."""
    return F.coalesce(from_a < until_b, F.lit(True)) & F.coalesce(from_b < until_a, F.lit(True))


def projected(spans: DataFrame, ledger: DataFrame) -> DataFrame:
    """Spans of a mutated text back on the canonical one: an exact entry gives its own span; else each end moves by the lengths that entries before it
    have changed, and snaps to the entry's ends if it falls inside one. Entries of a source don't overlap.

    Each end looks up the entry that begins last before it: one sorted union of entries and ends for each source, with running
    sums, and no join of spans with entries."""
    delta = (F.col("canonical_end") - F.col("canonical_start")) - (F.col("mutated_end") - F.col("mutated_start"))
    entry = F.struct("mutated_start", "mutated_end", "canonical_start", "canonical_end", delta.alias("delta"))
    ends = spans.select("source_id", "start", "end").distinct()
    at = lambda column: ends.select("source_id", F.col(column).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(entry_type).alias("entry"), "start", "end", F.lit(column).alias("side"))
    rows = ledger.select("source_id", F.col("mutated_start").alias("at"), F.lit(1).alias("kind"), entry.alias("entry"))
    entry_type = rows.schema["entry"].dataType
    none = lambda df: df.withColumns({"start": F.lit(None).cast("long"), "end": F.lit(None).cast("long"), "side": F.lit(None).cast("string")})
    union = none(rows).unionByName(at("start")).unionByName(at("end"))
    # An end meets the entries that begin before it (kind 0 sorts before an entry at the same place).
    before = Window.partitionBy("source_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = union.withColumns({"last": F.last("entry", True).over(before), "sum": F.coalesce(F.sum("entry.delta").over(before), F.lit(0))}).filter("kind = 0")
    inside = F.col("at") < F.col("last.mutated_end")
    snapped = F.when(F.col("side") == "start", F.col("last.canonical_start")).otherwise(F.col("last.canonical_end"))
    moved = F.col("at") + F.col("sum") - F.when(inside, F.col("last.delta")).otherwise(0)
    found = met.select("source_id", "start", "end", "side", F.coalesce(F.when(inside, snapped), moved).alias("to"))
    both = found.groupBy("source_id", "start", "end").agg(F.max(F.when(F.col("side") == "start", F.col("to"))).alias("s"), F.max(F.when(F.col("side") == "end", F.col("to"))).alias("t"))
    exact = ledger.groupBy("source_id", F.col("mutated_start").alias("start"), F.col("mutated_end").alias("end")).agg(F.max(F.struct("canonical_start", "canonical_end")).alias("x"))
    return both.join(exact, ["source_id", "start", "end"], "left").select("source_id", "start", "end", F.coalesce("x.canonical_start", "s").alias("canonical_start"), F.coalesce("x.canonical_end", "t").alias("canonical_end"))


#: Rules up to this number become one expression.
MOST_RULES = 1_000


def rules_matched(sources: DataFrame, rules: DataFrame) -> DataFrame:
    """id, domains: the domains of the matching rules by priority, for sources that match any. Rules (priority, source_type, uri_prefix, uri_regex, domain) are
    a configuration table: up to MOST_RULES of them are read and become an expression, so that there is no join; more are joined."""
    read = rules.select("priority", "source_type", "uri_prefix", "uri_regex", "domain").limit(MOST_RULES + 1).collect()
    if len(read) > MOST_RULES:
        r = rules.withColumnRenamed("source_type", "_type")
        fits = (r["_type"].isNull() | (r["_type"] == sources["source_type"])) & (r["uri_prefix"].isNull() | sources["uri"].startswith(r["uri_prefix"])) & (r["uri_regex"].isNull() | F.regexp_like(sources["uri"], r["uri_regex"]))
        got = sources.join(r, fits).groupBy(sources["id"]).agg(F.array_sort(F.collect_list(F.struct("priority", "domain"))).alias("p"))
        return got.select("id", F.array_distinct(F.transform("p", lambda x: x["domain"])).alias("domains"))
    hits = []
    for r in sorted(read, key=lambda r: (r["priority"], r["domain"])):
        tests = [F.col("source_type") == r["source_type"]] * (r["source_type"] is not None) + [F.col("uri").startswith(r["uri_prefix"] or "")] * (r["uri_prefix"] is not None) + [F.col("uri").rlike(r["uri_regex"] or "")] * (r["uri_regex"] is not None)
        hits.append(F.when(reduce(and_, tests, F.lit(True)), F.lit(r["domain"])))
    found = F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull())) if hits else F.expr("cast(array() as array<string>)")
    return sources.select("id", found.alias("domains")).filter(F.size("domains") > 0)


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """x, y, s: Jaccard's coefficient of the words of texts (id, text) on the left and right that share a word; by an equi join on words."""
    of = lambda df, name: df.select(F.col("id").alias(name), F.explode(F.array_distinct(T.words(F.col("text")))).alias("w"))
    a, b = of(left, "x"), of(right, "y")
    n = lambda df, key, size: df.groupBy(key).agg(F.count("*").alias(size))
    j = a.join(b, "w").groupBy("x", "y").agg(F.count("*").alias("k")).join(n(a, "x", "nx"), "x").join(n(b, "y", "ny"), "y")
    return j.select("x", "y", (F.col("k") / (F.col("nx") + F.col("ny") - F.col("k"))).alias("s"))


def parent_prefix(chunks: DataFrame, size: int = 200) -> DataFrame:
    """Each chunk with the start of its parent's text."""
    parents = chunks.select(F.col("id").alias("parent_id"), F.substring("content", 1, size).alias("prefix"))
    return chunks.join(parents, "parent_id", "left")


def duplicate_sources(sources: DataFrame) -> DataFrame:
    return sources.groupBy("uri").count().filter("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("duplicate_sources"))


def health(nodes: DataFrame, edges: DataFrame, sources: DataFrame, extractions: DataFrame) -> DataFrame:
    """One row of counters."""
    orphans = ungrounded(nodes, extractions)
    linked = orphans.join(endpoints(edges).select("id").distinct(), "id", "left_semi")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = duplicate_sources(sources)
    for df in (one(nodes, "nodes"), edges.agg(F.count("*").alias("edges"), F.count_if("invalid").alias("invalid_edges"), F.count_if("synthetic").alias("synthetic_edges")), one(sources, "sources"), one(orphans, "orphan_nodes"), one(linked, "orphans_with_edges")):
        out = out.join(F.broadcast(df))
    return out


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    e = edges.agg(F.count("*").alias("edges"), F.count_if("synthetic").alias("synthetic"))
    return nodes.agg(F.count("*").alias("nodes")).join(F.broadcast(e)).withColumns({"semantic": F.col("edges") - F.col("synthetic"), "density": F.coalesce(F.try_divide(F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)), F.lit(0.0))})


def contentions(edges: DataFrame) -> DataFrame:
    c = edges.filter(F.lower("rel_type").isin("contradicts", "contends"))
    return c.groupBy("src", "rel_type").agg(F.array_sort(F.collect_set("dst")).alias("targets"))


def gaps(nodes: DataFrame, edges: DataFrame, least_in: int, least_name: int = 3, excluded: tuple[str, ...] = (), k: int = 20) -> DataFrame:
    """Nodes that much refers to and that explain little."""
    d = degrees(edges).filter((F.col("in_degree") >= least_in) & (F.col("in_degree") > F.col("out_degree")))
    n = nodes.filter((F.length("name") >= least_name) & ~F.col("node_type").isin(*(excluded or ("",))))
    return n.join(d, "id").withColumn("gap", F.col("in_degree") - F.col("out_degree")).orderBy(F.desc("gap"), "id").limit(k)


def canonical_rel(names: DataFrame, known: DataFrame, least: float = 0.4) -> DataFrame:
    """name, canonical: the known relation (rel_type, n) of the largest similarity * ln(n + 1); the name itself where none is similar. By an equi join on trigrams."""
    grams = lambda df, key: df.select(key, F.explode(T.trigrams(F.trim(F.lower(key)))).alias("g"))
    a, b = grams(names.select("name").distinct(), "name"), grams(known.select("rel_type").distinct(), "rel_type")
    size = lambda df, key, n: df.groupBy(key).agg(F.count("*").alias(n))
    j = a.join(b, "g").groupBy("name", "rel_type").agg(F.count("*").alias("s")).join(size(a, "name", "na"), "name").join(size(b, "rel_type", "nb"), "rel_type").join(known, "rel_type")
    sim = F.col("s") / (F.col("na") + F.col("nb") - F.col("s"))
    best = j.filter(sim >= least).groupBy("name").agg(F.max(F.struct((sim * F.ln(F.col("n") + 1)).alias("s"), "rel_type")).alias("b"))
    return names.select("name").distinct().join(best, "name", "left").select("name", F.coalesce("b.rel_type", F.trim(F.lower("name"))).alias("canonical"))


def seniority(alpha0: float, beta0: float, weight: Column, confidence: Column) -> tuple[Column, Column]:
    """Aggregates alpha, beta of a beta posterior."""
    return alpha0 + F.sum(weight * confidence), beta0 + F.sum(weight * (1 - confidence))


def delta(before: DataFrame, after: DataFrame, threshold: float = 0.1) -> DataFrame:
    """delta, changed: the summed change of confidence over all keys (id, p)."""
    j = before.select("id", F.col("p").alias("p0")).join(after.select("id", F.col("p").alias("p1")), "id", "full_outer")
    return j.agg(F.sum(F.abs(F.coalesce("p1", F.lit(0.0)) - F.coalesce("p0", F.lit(0.0)))).alias("delta")).withColumn("changed", F.col("delta") > threshold)
