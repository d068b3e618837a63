"""Entity resolution, deduplication and clustering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import text as T
from ..plans.lineage import cut
from . import blocks, relational
from .graph import components


def resolved(mentions: DataFrame, nodes: DataFrame, aliases: DataFrame, threshold: float = 0.4) -> DataFrame:
    """mention, node, match: exact name (any case), then alias, then the most similar name by trigrams, else new.

    Candidates of the fuzzy tier share a rare trigram (``similar_names``), so that it is an equi join, of mentions that the tiers before left over.
    """
    low = mentions.select("mention", F.lower(F.trim("mention")).alias("key")).distinct()
    pick = lambda df, name: df.groupBy("key").agg(F.min("node").alias(name))
    exact = pick(nodes.select(F.lower("name").alias("key"), F.col("id").alias("node")), "exact")
    alias = pick(aliases.select(F.lower("alias").alias("key"), F.col("node_id").alias("node")), "alias")
    first = low.join(exact, "key", "left").join(alias, "key", "left")
    rest = first.filter("exact IS NULL AND alias IS NULL").select("key").distinct()
    # Names are resolved, not nodes: equal names are one candidate.
    names = nodes.groupBy(F.lower("name").alias("name")).agg(F.min("id").alias("node"))
    best = similar_names(rest, names, threshold).join(names, "name").groupBy("key").agg(F.max(F.struct(F.round("sim", 9).alias("sim"), (-F.col("node")).alias("minus"))).alias("m"))
    fuzzy = best.select("key", (-F.col("m.minus")).alias("fuzzy"))
    node = F.coalesce("exact", "alias", "fuzzy")
    match = F.when(F.col("exact").isNotNull(), "exact").when(F.col("alias").isNotNull(), "alias").when(F.col("fuzzy").isNotNull(), "fuzzy").otherwise("new")
    return first.join(fuzzy, "key", "left").select("mention", node.alias("node"), match.alias("match"))


def similar_names(keys: DataFrame, names: DataFrame, threshold: float) -> DataFrame:
    """key, name, sim: names (name) whose trigrams are similar to those of a key (key), by Jaccard, at ``threshold`` or more.

    By prefixes: with trigrams ordered from the rarest on, two sets that are so similar share one of their first n - threshold * n + 1.
    Pairs that meet there are judged on the spot, so that trigrams that all names have make no pairs.
    """
    grams = lambda df, c: df.select(F.col(c), F.explode(T.trigrams(F.col(c))).alias("g"))
    a, b = grams(keys.select("key").distinct(), "key"), grams(names.select("name").distinct(), "name")
    count = a.select("g").unionAll(b.select("g")).groupBy("g").agg(F.count("*").alias("f"))

    def first(df, c, all_):
        x = df.join(count, "g").groupBy(c).agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("_x")).select(c, F.col("_x.g").alias(all_))
        n = F.size(all_)
        return x.withColumn("g", F.explode(F.slice(all_, F.lit(1), F.least(n, n - F.ceil(n * threshold - 1e-9).cast("int") + 1))))

    s = F.size(F.array_intersect("_a", "_b"))
    met = first(a, "key", "_a").join(first(b, "name", "_b"), "g").withColumn("_s", s)
    return met.withColumn("sim", F.col("_s") / (F.size("_a") + F.size("_b") - F.col("_s"))).filter(F.col("sim") >= threshold).select("key", "name", "sim").distinct()


def fuzzy_candidates(keys: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """key, node, node_type, sim: nodes whose names are similar to a key (lower case) by trigrams (``similar_names``)."""
    near = similar_names(keys, nodes.select(F.lower("name").alias("name")), threshold)
    return near.join(nodes.select(F.col("id").alias("node"), F.lower("name").alias("name"), "node_type"), "name").select("key", "node", "node_type", "sim")


def supported(pairs: DataFrame, nodes: DataFrame, edges: DataFrame | None) -> DataFrame:
    """Rows of ``pairs`` (node, candidate_type, node_type ...) that the graph doesn't speak against: the types are equal (any case), the
    candidate has no neighbours, or one of its neighbours is of the mention's type."""
    if edges is None:
        return pairs
    ends = edges.select(F.col("src").alias("node"), F.col("dst").alias("o")).unionAll(edges.select(F.col("dst"), F.col("src")))
    ends = ends.join(pairs.select("node").distinct(), "node", "left_semi").distinct()
    kinds = ends.join(nodes.select(F.col("id").alias("o"), F.lower("node_type").alias("t")), "o").groupBy("node").agg(F.collect_set("t").alias("_kinds"))
    fine = (F.lower("candidate_type") == F.lower("node_type")) | F.col("_kinds").isNull() | F.array_contains("_kinds", F.lower("node_type"))
    return pairs.join(kinds, "node", "left").filter(fine).drop("_kinds")


def tiered(mentions: DataFrame, nodes: DataFrame, aliases: DataFrame, edges: DataFrame | None = None, similarity: float = 0.85, threshold: float = 0.4, deferred: bool = False, recall: float | None = None) -> DataFrame:
    """mention_id, node, name, match of mentions (mention_id, name, node_type, from_code, embedding), tier by tier.

    Exact name in any case; alias; names from code end here, as new. Then the nearest node by cosine, if ``similarity`` or more,
    and the most similar name by trigrams, those of the mention's type first, if ``threshold`` or more; both only if the graph
    doesn't speak against them (``supported``). Else new, or ``deferred`` to the batch of pending names. Ties go to the smallest
    id. A tier sees only what the tiers before it left. ``recall``: see ``relational.close_pairs``.
    """
    low = mentions.withColumn("key", F.lower(F.trim("name")))
    exact = nodes.groupBy(F.lower("name").alias("key")).agg(F.min("id").alias("exact"))
    alias = aliases.groupBy(F.lower("alias").alias("key")).agg(F.min("node_id").alias("alias"))
    first = low.join(exact, "key", "left").join(alias, "key", "left")
    rest = cut(first.filter("exact IS NULL AND alias IS NULL AND NOT from_code").select("mention_id", "key", "node_type", "embedding"))
    of_type = nodes.select(F.col("id").alias("node"), F.col("node_type").alias("candidate_type"))
    said, named = rest.filter("embedding IS NOT NULL").select(F.col("mention_id").alias("id"), "embedding"), nodes.filter("embedding IS NOT NULL").select("id", "embedding")
    near = relational.nearest(said, named, 1 - similarity) if recall is None else relational.close_pairs(said, named, 1 - similarity, recall)
    closest = near.groupBy(F.col("left_id").alias("mention_id")).agg(F.min(F.struct(F.round("distance", 12).alias("d"), F.col("right_id").alias("n"))).alias("m")).select("mention_id", F.col("m.n").alias("node"))
    vector = cut(supported(cut(closest.join(of_type, "node").join(rest.select("mention_id", "node_type"), "mention_id")), nodes, edges).select("mention_id", F.col("node").alias("vector")))
    left = cut(rest.join(vector, "mention_id", "left_anti").drop("embedding"))
    likes = fuzzy_candidates(left.select("key").distinct(), nodes, threshold).withColumnRenamed("node_type", "candidate_type").join(left.select("mention_id", "key", "node_type"), "key")
    order = F.struct((F.lower("candidate_type") == F.lower("node_type")).cast("int").alias("same"), F.round("sim", 9).alias("sim"), (-F.col("node")).alias("minus"))
    best = likes.groupBy("mention_id", "node_type").agg(F.max(F.struct(order.alias("o"), "candidate_type")).alias("m")).select("mention_id", "node_type", (-F.col("m.o.minus")).alias("node"), F.col("m.candidate_type").alias("candidate_type"))
    fuzzy = supported(best, nodes, edges).select("mention_id", F.col("node").alias("fuzzy"))
    j = first.join(vector, "mention_id", "left").join(fuzzy, "mention_id", "left")
    last = F.when(F.lit(deferred) & ~F.col("from_code"), "deferred").otherwise("new")
    match = F.when(F.col("exact").isNotNull(), "exact").when(F.col("alias").isNotNull(), "alias").when(F.col("vector").isNotNull(), "vector").when(F.col("fuzzy").isNotNull(), "fuzzy").otherwise(last)
    j = j.select("mention_id", F.col("name").alias("_said"), F.coalesce("exact", "alias", "vector", "fuzzy").alias("node"), match.alias("match"))
    return j.join(nodes.select(F.col("id").alias("node"), "name"), "node", "left").select("mention_id", "node", F.coalesce("name", "_said").alias("name"), "match")


def upserted(mentions: DataFrame, found: DataFrame, nodes: DataFrame, aliases: DataFrame, first_id: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and aliases after mentions (mention_id, name, node_type, ast_hash) were resolved (``found``: mention_id, node, match).

    Each mention counts up its node; mentions that are new make one node for each lower-case name, with ids from ``first_id`` on in
    order of names. A vector match of three characters or more gives its node an alias, unless the alias is taken. A node whose
    code has another hash than before loses its summary. Set-based: mentions of one name meet in an aggregate, so no lock is needed.
    """
    m = cut(mentions.select("mention_id", "name", "node_type", "ast_hash").join(found.select("mention_id", "node", "match"), "mention_id"))
    hit = m.filter("node IS NOT NULL").groupBy(F.col("node").alias("id")).agg(F.count("*").alias("_n"), F.max_by("ast_hash", F.when(F.col("ast_hash").isNotNull(), F.col("mention_id"))).alias("_hash"))
    changed = F.col("_hash").isNotNull() & ~F.col("_hash").eqNullSafe(F.col("ast_hash"))
    old = nodes.join(hit, "id", "left").withColumns({"mention_count": F.col("mention_count") + F.coalesce("_n", F.lit(0)), "summary": F.when(~changed, F.col("summary")), "ast_hash": F.coalesce("_hash", "ast_hash")}).select(*nodes.columns)
    fresh = m.filter("match = 'new'").groupBy(F.lower(F.trim("name")).alias("key")).agg(F.min_by(F.struct(F.trim("name").alias("name"), "node_type", "ast_hash"), "mention_id").alias("r"), F.count("*").alias("n"))
    # Numbered without a window over all: a place inside its range of names, and what the ranges before it hold.
    ranges = fresh.repartitionByRange("key").sortWithinPartitions("key").withColumns({"_p": F.spark_partition_id(), "_k": F.monotonically_increasing_id()})
    ranges = cut(ranges.withColumn("_k", F.col("_k") - F.shiftleft(F.col("_p").cast("long"), 33)))
    sizes = ranges.groupBy("_p").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    new = ranges.join(F.broadcast(sizes), "_p").select((F.lit(first_id) + F.col("_before") + F.col("_k")).alias("id"), "r.name", "r.node_type", F.col("n").alias("mention_count"), F.lit(None).cast("string").alias("summary"), "r.ast_hash")
    known = aliases.select(F.lower("alias").alias("_a")).distinct()
    more = m.filter((F.col("match") == "vector") & (F.length(F.trim("name")) >= 3)).groupBy(F.lower(F.trim("name")).alias("_a")).agg(F.min_by(F.struct(F.trim("name").alias("alias"), F.col("node").alias("node_id")), "mention_id").alias("r"))
    added = more.join(known, "_a", "left_anti").select("r.alias", "r.node_id")
    return old.unionByName(new.select(*nodes.columns)), aliases.select("alias", "node_id").unionByName(added)


def pending_resolved(pending: DataFrame, similarity: float = 0.85, least: int = 2, recall: float | None = None) -> DataFrame:
    """id, canonical, noise of deferred names (id, confidence, embedding): groups connected by cosines of ``similarity`` or more; the
    most confident one, ties by id, is a group's canonical name; names in no group of ``least`` are promoted to nodes of their own."""
    pairs = blocks.links(pending, 1 - similarity) if recall is None else relational.close_pairs(pending, pending, 1 - similarity, recall)
    c = linked_clusters(pairs, pending).join(pending.select("id", "confidence"), "id")
    best = c.groupBy("cluster").agg(F.max(F.struct("confidence", (-F.col("id")).alias("minus"))).alias("m"), F.count("*").alias("n"))
    noise = F.col("n") < least
    return c.join(best, "cluster").select("id", F.when(noise, F.col("id")).otherwise(-F.col("m.minus")).alias("canonical"), noise.alias("noise"))


def statements_matched(new: DataFrame, old: DataFrame, similarity: float = 0.92, kept_words: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(added, evicted) ids for a source extracted anew. ``new``: source_id, id, hash, embedding; ``old``: source_id, id, hash, embedding, content, span.

    New statements are added unless their hash is there, or an old one of the source is nearer than ``similarity``. Old ones that are
    neither an exact nor the nearest match of a new one go if at most ``kept_words`` of their long words are still in the span of
    the new text that they came from.
    """
    o, n = old.select("source_id", F.col("id").alias("old_id"), "hash", "content", "span"), new.select("source_id", "id", "hash", "embedding")
    rest = n.join(o.select("source_id", "hash").distinct(), ["source_id", "hash"], "left_anti")
    near = blocks.best(rest.filter("embedding IS NOT NULL"), old.filter("embedding IS NOT NULL"), 1, 12, above=similarity, by="source_id")
    best = near.groupBy(F.col("left_id").alias("id")).agg(F.max(F.struct(F.round("cosine", 12).alias("sim"), (-F.col("right_id")).alias("minus"))).alias("m")).select("id", (-F.col("m.minus")).alias("old_id"))
    added = rest.join(best, "id", "left_anti").select("source_id", "id")
    unmatched = o.join(n.select("source_id", "hash").distinct(), ["source_id", "hash"], "left_anti").join(best.select("old_id").distinct(), "old_id", "left_anti")
    long = F.filter(F.split(F.lower("content"), r"\s+"), lambda w: F.octet_length(w) > 3)
    left = F.size(F.filter(long, lambda w: F.contains(F.lower("span"), w)))
    evicted = unmatched.filter(F.coalesce(F.try_divide(left, F.size(long)), F.lit(0.0)) <= kept_words).select("source_id", F.col("old_id").alias("id"))
    return added, evicted


def exact_dedup(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key. An aggregate: a hot key costs one partial row from each task."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("r")).select(key, "r.*").select(*df.columns)


def entity_dedup(mentions: DataFrame) -> DataFrame:
    """key, name, confidence, n: mentions (name, confidence, statement_id) by lower-case name; the most confident one's spelling."""
    best = F.max(F.struct("confidence", "name")).alias("m")
    return mentions.groupBy(F.lower("name").alias("key")).agg(best, F.countDistinct("statement_id").alias("n")).select("key", "m.name", "m.confidence", "n")


def novel(statements: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Statements (source_id, ordinal, embedding) of each source that no earlier kept one resembles; those without a vector stay. Greedy in order, so by source."""
    import numpy as np

    def keep(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ordinal", kind="stable")
        held, n, rows = np.empty((16, 0)), 0, []
        for k, e in enumerate(g["embedding"]):
            if e is None:
                rows.append(k)
                continue
            v = np.asarray(e, float)
            v = v / (np.linalg.norm(v) or 1.0)
            if not n:
                held = np.empty((16, len(v)))
            if not n or (held[:n] @ v).max() < threshold:
                if n == len(held):
                    held = np.concatenate([held, np.empty_like(held)])
                held[n] = v
                n += 1
                rows.append(k)
        return g.iloc[rows]

    return statements.groupBy("source_id").applyInPandas(keep, statements.schema)


def complete_linkage() -> Callable[..., list[list[int]]]:
    """The function below, made inside another so that it travels to the executors by value."""

    def run(x, threshold: float, room: int = 4_000_000) -> list[list[int]]:
        """Clusters of the rows of ``x`` (of length one, or zero) by complete linkage of their products at ``threshold``.

        Chains of nearest neighbours: a pair that is nearest to each other merges. Complete linkage only falls by merging, so that a cluster
        whose nearest is below the threshold is done, and a nearest neighbour stays it until it merges itself. No matrix of all pairs is held:
        a cluster's row, its least product with each row of ``x``, is computed when asked for, and up to ``room`` numbers of rows are kept.
        """
        import numpy as np

        members = {k: [k] for k in range(len(x))}
        at = np.arange(len(x))  # the rows that still count, of which ``live`` are the vectors
        live, lead = x, np.arange(len(x))  # lead: each such row's cluster, -1 when done
        step = max(1, room // max(len(x), 1))
        near, rows, found, chain = {}, {}, [], []
        for k in range(0, len(x), step):
            s = x[k : k + step] @ x.T
            s[np.arange(len(s)), np.arange(k, k + len(s))] = -2
            b = s.argmax(axis=1)
            near.update((k + i, (int(j), float(s[i, j]))) for i, j in enumerate(b))

        def row(a: int):
            if a not in rows:
                m, least = members[a], None
                for k in range(0, len(m), step):
                    s = (x[m[k : k + step]] @ live.T).min(axis=0)
                    least = s if least is None else np.minimum(least, s)
                rows[a] = least
            while len(rows) > max(step, 3):
                rows.pop(next(iter(rows)))
            return rows[a]

        def nearest(a: int) -> tuple[int, float]:
            if a not in near:
                link = np.full(len(x), 2.0)
                r = row(a)
                on = lead >= 0
                np.minimum.at(link, lead[on], r[on])
                link[link > 1.5] = -2
                link[a] = -2
                b = int(link.argmax())
                near[a] = b, float(link[b])
            return near[a]

        of: dict[int, set[int]] = {}  # who has it as nearest
        for a, (b, _) in near.items():
            of.setdefault(b, set()).add(a)

        def stale(b: int) -> None:
            for a in of.pop(b, ()):
                if a in near and near[a][0] == b:
                    del near[a]

        first, done = 0, 0
        while members:
            if not chain:
                while first not in members:
                    first += 1
                chain = [first]
                if done > len(at) // 2:
                    keep = lead >= 0
                    at, lead, done = at[keep], lead[keep], 0
                    live, rows = x[at], {a: r[keep] for a, r in rows.items()}
            a = chain[-1]
            known = a in near
            b, s = nearest(a)
            if not known:
                of.setdefault(b, set()).add(a)
            # Equal products may differ in their last bits by the side they are computed from: no cluster comes into a chain twice.
            if len(chain) > 1 and (near[chain[-2]][1] >= s or b in chain):
                b, s = chain[-2], near[chain[-2]][1]
            if s < threshold:
                mine = np.searchsorted(at, members[a])
                found.append(members.pop(a))
                lead[mine] = -1
                done += len(mine)
                rows.pop(a, None)
                stale(a)
                chain = []
            elif len(chain) > 1 and b == chain[-2]:
                a, b = min(a, b), max(a, b)
                r = np.minimum(row(a), row(b))
                lead[np.searchsorted(at, members[b])] = a
                members[a] += members.pop(b)
                rows.pop(b, None)
                rows.pop(a, None)
                rows[a] = r
                stale(a)
                stale(b)
                near.pop(a, None)
                near.pop(b, None)
                chain = chain[:-2]
            else:
                chain.append(b)
        return found

    return run


def clustered(statements: DataFrame, threshold: float = 0.75, least: int = 2) -> DataFrame:
    """Adds cluster: complete linkage by cosine at ``threshold`` inside each source; clusters below ``least`` join the one of the largest mean similarity.

    Squares of the source's statements in time, not in memory.
    """
    import numpy as np

    schema = T_.StructType([*statements.schema.fields, T_.StructField("cluster", T_.LongType())])
    linked = complete_linkage()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id", kind="stable")
        x = np.array([np.asarray(e, float) for e in g["embedding"]])
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        # Copies are at the largest cosine, so that they merge first; vectors of zeros are like nothing, themselves included.
        same: dict[object, list[int]] = {}
        for k, v in enumerate(x):
            same.setdefault(v.tobytes() if v.any() else k, []).append(k)
        copies = list(same.values()) if threshold <= 1 - 1e-9 else [[k] for k in range(len(x))]
        found = [sum((copies[k] for k in c), []) for c in linked(x[[c[0] for c in copies]], threshold)]
        found.sort(key=min)
        large = [c for c in found if len(c) >= least] or found
        if len(large) < len(found):
            # The mean of all products of two clusters is the product of their means.
            sums, sizes = np.array([x[c].sum(axis=0) for c in large]), np.array([len(c) for c in large], float)
            for c in found:
                if len(c) < least:
                    own = x[c].sum(axis=0)
                    k = int(np.argmax(sums @ own / sizes))
                    large[k] += c
                    sums[k] += own
                    sizes[k] += len(c)
        ids = g["id"].to_numpy()
        name = {m: first for c in large for first in [int(min(ids[c]))] for m in c}
        return g.assign(cluster=[name[k] for k in range(len(g))])

    return statements.groupBy("source_id").applyInPandas(run, schema)


def linked_clusters(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """id, cluster: single linkage over pairs (left_id, right_id), the deterministic stand-in for density clustering; lone items are their own."""
    e = pairs.filter("left_id <> right_id").select(F.greatest("left_id", "right_id").alias("u"), F.least("left_id", "right_id").alias("v")).distinct()
    r = components(e)
    return items.select("id").join(r, F.col("id") == r["node"], "left").select("id", F.coalesce("root", "id").alias("cluster"))


def canonical(items: DataFrame, by: str = "n") -> DataFrame:
    """id, canonical: of each cluster the item with the largest ``by``, ties by id."""
    best = items.groupBy("cluster").agg(F.max(F.struct(by, (-F.col("id")).alias("minus"))).alias("m")).select("cluster", (-F.col("m.minus")).alias("canonical"))
    return items.join(best, "cluster").select("id", "canonical")


def abbreviations(docs: DataFrame) -> DataFrame:
    """doc_id, term, short: capitalised terms of several words whose initials stand in the document as a word. An article before a term is no part of it."""
    term = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b((?:\p{Lu}[\p{L}]+ ){1,5}\p{Lu}[\p{L}]+)\b"), 1))).alias("term")
    t = docs.select("doc_id", "text", term).withColumn("term", F.regexp_replace("term", r"^(The|A|An) ", "")).filter(F.contains("term", F.lit(" ")))
    short = F.array_join(F.transform(F.split("term", " "), lambda w: F.substring(w, 1, 1)), "")
    return t.withColumn("short", short).filter(F.array_contains(F.split("text", r"[^\p{L}\p{N}]+"), F.col("short"))).select("doc_id", "term", "short").distinct()


def statement_diff(new: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``new`` whose hash isn't in ``old``, and rows of ``old`` to evict."""
    return new.join(old.select("hash").distinct(), "hash", "left_anti"), old.join(new.select("hash").distinct(), "hash", "left_anti")


def fingerprints(df: DataFrame, stages: dict[str, list[str]]) -> DataFrame:
    """A hash for each stage of a pipeline, to tell what has to run anew."""
    return df.select("id", *(F.xxhash64(*cols).alias(name) for name, cols in stages.items()))


def batches(items: DataFrame, by: str, order: str, most: int = 4000, least: int = 1) -> DataFrame:
    """Adds batch: items in order, packed one after the other up to ``most`` tokens; items below ``least`` go. Sequential in a group; groups
    stream through a task one after the other, so that neither their number nor their size is held in memory."""
    by_at, tokens_at = items.columns.index(by), items.columns.index("tokens")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used, batch, begun = None, 0, 0, False
        for part in parts:
            out = []
            for group, n in zip(part.column(by_at).to_pylist(), part.column(tokens_at).to_pylist(), strict=True):
                if not begun or group != last:
                    last, used, batch, begun = group, 0, 0, True
                if used and used + n > most:
                    batch, used = batch + 1, 0
                used += n
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.int64())], names=[*part.schema.names, "batch"])

    rows = items.filter(F.col("tokens") >= least).repartition(by).sortWithinPartitions(by, F.asc_nulls_last(order))
    return rows.mapInArrow(run, T_.StructType([*items.schema.fields, T_.StructField("batch", T_.LongType())]))


def majority(df: DataFrame, by: str, label: str) -> DataFrame:
    """The most frequent label of each group; ties to the smallest."""
    n = df.groupBy(by, label).agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), label))).filter("r = 1").select(by, label, "n")
