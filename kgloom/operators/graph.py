"""Graph operators over frames: nodes (id, ...), edges (src, dst, ...).

Iterations keep the frames at one row for a node or edge, aggregate before they shuffle, and cut their lineage into the
shared checkpoint folder; only counts come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.lineage import cut, kept

#: Iterations between two cuts of a plan's lineage.
EVERY = 4


def view(edges: DataFrame, name: str = "all", rel_types: list[str] | None = None) -> DataFrame:
    """Without synthetic and bibliographic edges; temporal: only those with a start of validity; others: of the relations given."""
    e = edges.filter(~F.col("synthetic") & ~F.lower("rel_type").isin(*T.DENIED))
    if name == "temporal":
        return e.filter(F.col("valid_from").isNotNull())
    return e.filter(F.lower("rel_type").isin(*(r.lower() for r in rel_types))) if rel_types else e


def effective(column: str) -> Column:
    """A weight or confidence, damped for synthetic and bibliographic edges."""
    return F.col(column) * F.when(F.col("synthetic"), 0.1).when(F.col("rel_type").isin(*T.BIBLIOGRAPHIC), 0.2).otherwise(1.0)


def neighbours(edges: DataFrame) -> DataFrame:
    """a, b: each edge both ways, once."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionAll(edges.select(F.col("dst"), F.col("src"))).filter("a <> b").distinct()


def bfs(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """start, id, hops: what each start (column id) reaches, over edges both ways; starts themselves are left out."""
    near = neighbours(edges)
    seen = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hops"))
    front = seen
    for h in range(1, hops + 1):
        met = front.join(near, front["id"] == near["a"]).select("start", F.col("b").alias("id")).distinct()
        front = cut(met.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("hops", F.lit(h)))
        seen = seen.unionByName(front)
    return seen.filter("hops > 0")


def shortest_path(edges: DataFrame, start: int, end: int, most: int | None = None) -> DataFrame:
    """One row with the path (array of ids), the smallest one of those of least length; none if there is none (in ``most`` hops, if given)."""
    near = cut(neighbours(edges))
    spark = edges.sparkSession
    front = spark.range(start, start + 1).select("id", F.array("id").alias("path"))
    before = front.select("id").limit(0)
    k = 0
    while start != end and (most is None or k < most) and not front.isEmpty() and front.filter(F.col("id") == end).isEmpty():
        met = front.join(near, front["id"] == near["a"]).select(F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"))
        # Edges go both ways, so that the next nodes are no older ones than those of the last two rounds.
        seen = before.unionByName(front.select("id"))
        before, front = front.select("id"), cut(met.join(seen, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")))
        k += 1
    return front.filter(F.col("id") == end).select("path")


def components(edges: DataFrame) -> DataFrame:
    """node, root for the nodes of ``edges`` (u, v; u > v) but the roots; root: the smallest node it is connected to.

    Alternates large-star and small-star steps until the links stay as they are. Each step takes its minimum by a
    grouped aggregate, so that a node of very many links costs one partial row from each task.
    """
    edges, was = cut(edges), None
    while (now := edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()) != was and now[0]:
        was = now
        least = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))  # of nodes with smaller neighbours
        large = edges.join(least, edges["v"] == least["node"], "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        best = large.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
        moved = large.join(best, large["u"] == best["node"]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = cut(moved.unionByName(best.select(F.col("node").alias("u"), F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def membership(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: weak components, each named by its smallest id."""
    e = edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    r = components(e)
    return nodes.select("id").join(r, F.col("id") == r["node"], "left").select("id", F.coalesce("root", "id").alias("component"))


def rank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 20, seeds: DataFrame | None = None, weight: Column | None = None, lose_unweighted: bool = False) -> DataFrame:
    """id, score. PageRank; with ``seeds`` (id, weight) personalised; with an edge ``weight`` by shares of it.

    Teleport and the mass of nodes without edges go to the seeds by weight, or to all alike; parallel edges count each.
    ``lose_unweighted``: nodes whose edges have no weight at all lose their mass instead.
    """
    n = nodes.count()
    w = weight if weight is not None else F.lit(1.0)
    raw = edges.select("src", "dst", w.alias("w"))
    out = raw.groupBy("src").agg(F.sum("w").alias("total"))
    shares = cut(raw.groupBy("src", "dst").agg(F.sum("w").alias("w")).join(out.filter("total > 0"), "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")))
    if seeds is None:
        base = nodes.select("id", F.lit(1.0 / max(n, 1)).alias("teleport"))
    else:
        s = seeds.join(F.broadcast(seeds.agg(F.sum("weight").alias("_w")))).select("id", (F.col("weight") / F.col("_w")).alias("t"))
        base = nodes.select("id").join(s, "id", "left").select("id", F.coalesce("t", F.lit(0.0)).alias("teleport"))
    has = out if lose_unweighted else out.filter("total > 0")
    base = cut(base.join(has.select(F.col("src").alias("id"), F.lit(False).alias("_d")), "id", "left").select("id", "teleport", F.coalesce("_d", F.lit(True)).alias("dangling")))
    # Only nodes that pass something on are kept up round by round; of the others the dangling ones count together, as mass. All come in the last round.
    live = shares.select(F.col("src").alias("id")).distinct()
    lost = base.join(live, "id", "left_anti").filter("dangling")
    ends = lost.agg(F.count("*").alias("n"), F.coalesce(F.sum("teleport"), F.lit(0.0)).alias("t")).first()
    to_lost = shares.join(lost.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.sum("share").alias("q"))
    inner = cut(shares.join(live.select(F.col("id").alias("dst")), "dst", "left_semi"))
    own = cut(base.join(live, "id", "left_semi").join(to_lost, "id", "left").select("id", "teleport", F.coalesce("q", F.lit(0.0)).alias("q")))
    scores, mass = own.withColumn("score", F.lit(1.0 / max(n, 1))), ends["n"] / max(n, 1)
    value = lambda m: F.col("teleport") * (1 - damping + damping * m) + damping * F.coalesce("flow", F.lit(0.0))
    flows = lambda over: scores.select(F.col("id").alias("src"), "score").join(over, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("share")).alias("flow"))
    for _ in range(iterations - 1):
        given = scores.agg(F.sum(F.col("score") * F.col("q"))).first()[0] or 0.0
        # Cut in each round: the scores are used twice, so that uncut plans would double.
        scores = cut(own.join(flows(inner), "id", "left").select("id", "q", value(mass).alias("score")))
        mass = ends["t"] * (1 - damping + damping * mass) + damping * given
    if iterations < 1:
        return base.select("id", F.lit(1.0 / max(n, 1)).alias("score"))
    return base.join(flows(shares), "id", "left").select("id", value(mass).alias("score"))


def spreading(edges: DataFrame, seeds: DataFrame, decay: float = 0.7, threshold: float = 0.05, most: int = 10) -> DataFrame:
    """id, energy: the best energy over all paths from the seeds (id, energy), times decay and effective weight a hop, above the threshold."""
    w = edges.select("src", "dst", effective("weight").alias("w")).groupBy("src", "dst").agg(F.max("w").alias("w"))
    best = front = cut(seeds.select("id", "energy"))
    for _ in range(most):
        met = front.join(w, front["id"] == w["src"]).select(F.col("dst").alias("id"), (F.col("energy") * decay * F.col("w")).alias("energy")).filter(F.col("energy") > threshold)
        met = met.groupBy("id").agg(F.max("energy").alias("energy"))
        front = cut(met.join(best.withColumnRenamed("energy", "_was"), "id", "left").filter("_was IS NULL OR energy > _was").select("id", "energy"))
        if front.isEmpty():
            break
        best = cut(best.unionByName(front).groupBy("id").agg(F.max("energy").alias("energy")))
    return best


def betweenness(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """id, score: shortest paths through a node over directed edges, parallel ones each, of ``most`` hops if given; normalised by (n-1)(n-2).

    All sources at once, level by level: path counts forward, dependencies back. Rows are pairs that reach each other, but for those that
    no path through a node has part in: only nodes with edges in and out lie between others. What a source's own edges reach is
    ``e`` itself, of which only the edges to such nodes, and to the ends of theirs, are kept.
    """
    n = nodes.count()
    own = edges.filter("src <> dst").select("src", "dst")
    mid = cut(own.select(F.col("src").alias("id")).distinct().join(own.select(F.col("dst").alias("id")).distinct(), "id", "left_semi"))
    between = lambda c: mid.select(F.col("id").alias(c))
    m = own.groupBy("src", "dst").agg(F.count("*").alias("m"))
    e = cut(m.join(between("src"), "src", "left_semi"))  # from the nodes that lie between others
    to = cut(m.join(between("dst"), "dst", "left_semi").join(nodes.select(F.col("id").alias("src")), "src", "left_semi"))  # to them: the first level
    far = own.join(e.select("dst").distinct(), "dst", "left_semi").distinct()
    front = to.select(F.col("src").alias("s"), F.col("dst").alias("id"), F.col("m").cast("double").alias("sigma"))
    # A source is at no distance from itself.
    seen = cut(far.select(F.col("src").alias("s"), F.col("dst").alias("id")).unionAll(e.select(F.col("dst").alias("s"), F.col("dst").alias("id")).distinct()))
    levels = [None, front]
    if front.isEmpty():
        levels = [None]
    while len(levels) > 1 and (most is None or len(levels) <= most):
        met = front.join(e, front["id"] == e["src"]).groupBy("s", F.col("dst").alias("id")).agg(F.sum(F.col("sigma") * F.col("m")).alias("sigma"))
        front = cut(met.join(seen, ["s", "id"], "left_anti"))
        if front.isEmpty():
            break
        levels.append(front)
        seen = seen.unionByName(front.select("s", "id"))
        if len(levels) % EVERY == 0:
            seen = cut(seen)
    total = deps = None
    for k in range(len(levels) - 1, 0, -1):
        lower = levels[k].withColumn("dep", F.lit(0.0)) if deps is None else levels[k].join(deps, ["s", "id"], "left").withColumn("dep", F.coalesce("dep", F.lit(0.0)))
        own = lower.filter("dep > 0").groupBy("id").agg(F.sum("dep").alias("dep"))
        total = own if total is None else total.unionByName(own)
        if k % EVERY == 0:
            total = cut(total.groupBy("id").agg(F.sum("dep").alias("dep")))
        if k == 1:
            break  # what goes back to the sources isn't counted
        down = lower.select("s", F.col("id").alias("dst"), F.col("sigma").alias("t"), "dep").join(e, "dst")
        up = down.join(levels[k - 1].withColumnRenamed("id", "src"), ["s", "src"])
        deps = cut(up.groupBy("s", F.col("src").alias("id")).agg(F.sum(F.col("sigma") * F.col("m") / F.col("t") * (1 + F.col("dep"))).alias("dep")))
    norm = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    if total is None:
        return nodes.select("id", F.lit(0.0).alias("score"))
    t = total.groupBy("id").agg(F.sum("dep").alias("dep"))
    return nodes.select("id").join(t, "id", "left").select("id", (F.coalesce("dep", F.lit(0.0)) * norm).alias("score"))


def cores(nodes: DataFrame, edges: DataFrame, weight: str | None = None) -> DataFrame:
    """id, core: the largest k such that the node is in a part of the graph where each weighted degree (in and out, without loops;
    without ``weight``: degree) is k or more.

    From the degrees down, each round gives a node the largest k for which its neighbours with k or more weigh k or more; it
    ends at the core numbers when nothing changes, in far fewer rounds than there are layers to peel. A node's neighbours are weighed
    once, at each of their numbers (``level``; above its own degree they are all alike). Then only nodes that fell tell it, if it
    matters there, and only nodes that were told are looked at again; edges stay where they are, as lists by the node that tells.
    """
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    e = edges.filter("src <> dst").select("src", "dst", w.alias("w"))
    parts = max(1, -(-e.count() // 250_000))
    both = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "w").unionAll(e.select(F.col("dst"), F.col("src"), "w"))
    whole = lambda x: F.floor(F.round(x, 9)).cast("long")
    start = kept(both.groupBy("a").agg(whole(F.sum("w")).alias("core"), F.count("*").alias("_n")).repartition(parts, "a"))
    far = start.select(F.col("a").alias("b"), F.col("core").alias("most")).hint("shuffle_hash")
    near = both.repartition(parts, "b").join(far, "b").repartition(parts, "a").join(start.hint("shuffle_hash"), "a")
    piece = F.pmod(F.monotonically_increasing_id(), F.floor(1 + F.col("_n") / 10_000))  # a hub has several lists
    near = kept(near.groupBy("a", piece.alias("piece")).agg(F.collect_list(F.struct("b", "w", "most")).alias("to")))
    level = F.least("most", "core").alias("level")
    first = kept(near.join(start.hint("shuffle_hash"), "a").select("a", "core", F.inline("to")).groupBy("a", level).agg(F.sum("w").alias("w")))
    down = Window.partitionBy("a").orderBy(F.desc_nulls_last("level")).rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("level").isNull()

    def settled(levels: DataFrame, cores: DataFrame) -> DataFrame:
        """a, core, was: the nodes that fall; ``cores`` has a node's numbers so far. Their rows have no level and come last."""
        x = levels.withColumn("core", F.lit(None).cast("long")).unionByName(cores.select("a", F.lit(None).cast("long").alias("level"), F.lit(0.0).alias("w"), "core"))
        x = x.repartition(parts, "a").groupBy("a", "level").agg(F.sum("w").alias("w"), F.min("core").alias("was"))
        x = x.withColumn("k", F.when(~own, F.least("level", whole(F.sum("w").over(down))))).withColumn("core", F.least("was", F.max("k").over(down)))
        return cut(x.filter(own & (F.col("core") < F.col("was"))).select("a", "core", "was"))

    fell, falls, moves, k = settled(first, start), start.select("a", "core"), None, 0
    while not fell.isEmpty():
        falls = falls.unionByName(fell.select("a", "core"))
        told = near.join(fell.repartition(parts, "a").hint("shuffle_hash"), "a").select("core", "was", F.inline("to"))
        told = told.select(F.col("b").alias("a"), "w", F.least("was", "most").alias("was"), level).filter("level < was")
        told = cut(told.select("a", F.inline(F.array(F.struct(F.col("was").alias("level"), (-F.col("w")).alias("w")), F.struct("level", "w")))))
        moves, k = told if moves is None else moves.unionByName(told), k + 1
        if k % EVERY == 0:
            moves, falls = cut(moves.groupBy("a", "level").agg(F.sum("w").alias("w"))), cut(falls.groupBy("a").agg(F.min("core").alias("core")))
        again = told.select("a").distinct().repartition(parts, "a").hint("shuffle_hash")
        fell = settled(first.join(again, "a").unionByName(moves.join(again, "a")), falls.join(again, "a"))
    now = falls.groupBy(F.col("a").alias("id")).agg(F.min("core").alias("core"))
    return nodes.select("id").join(now, "id", "left").select("id", F.coalesce("core", F.lit(0).cast("long")).alias("core"))


def communities(nodes: DataFrame, edges: DataFrame, core: DataFrame, least: int = 2) -> DataFrame:
    """id, community, core: nodes of one core number that are connected among themselves, of ``least`` or more."""
    k = cut(core.select("id", "core"))
    same = edges.filter("src <> dst").select("src", "dst")
    parts = max(1, -(-same.count() // 500_000))
    for end, at in (("src", "_a"), ("dst", "_b")):  # nodes are few beside the edges: no edge is sorted
        same = same.repartition(parts, end).join(k.select(F.col("id").alias(end), F.col("core").alias(at)).repartition(parts, end).hint("shuffle_hash"), end)
    same = same.filter("_a = _b")
    m = membership(nodes, same.select("src", "dst")).join(k, "id")
    sizes = m.groupBy("component").count().filter(F.col("count") >= least).select("component")
    return m.join(sizes, "component", "left_semi").select("id", F.col("component").alias("community"), "core")


def _both_ends(edges: DataFrame, members: DataFrame) -> DataFrame:
    m = members.select("id", "community")
    return edges.join(m.withColumnsRenamed({"id": "src", "community": "c_src"}), "src").join(m.withColumnsRenamed({"id": "dst", "community": "c_dst"}), "dst", "left")


def coherence(edges: DataFrame, members: DataFrame) -> DataFrame:
    """community, coherence: the share of out-edge weight that stays inside."""
    e = _both_ends(edges, members)
    inside = F.sum(F.when(F.col("c_src") == F.col("c_dst"), F.col("weight")).otherwise(0.0))
    return e.groupBy(F.col("c_src").alias("community")).agg(F.coalesce(F.try_divide(inside, F.sum("weight")), F.lit(0.0)).alias("coherence"))


def bridges(edges: DataFrame, members: DataFrame, between: DataFrame | None = None) -> DataFrame:
    """id, foreign, cross, score: foreign communities * share of cross edges * (1 + 10 * betweenness)."""
    m = members.select("id", "community")
    ends = edges.select(F.col("src").alias("id"), F.col("dst").alias("o")).unionAll(edges.select(F.col("dst"), F.col("src")))
    j = ends.join(m, "id").join(m.withColumnsRenamed({"id": "o", "community": "c"}), "o")
    cross = F.col("community") != F.col("c")
    g = j.groupBy("id").agg(F.countDistinct(F.when(cross, F.col("c"))).alias("foreign"), (F.count_if(cross) / F.count("*")).alias("cross")).filter("foreign > 0")
    b = F.lit(0.0) if between is None else F.coalesce("b", F.lit(0.0))
    if between is not None:
        g = g.join(between.select("id", F.col("score").alias("b")), "id", "left")
    return g.select("id", "foreign", "cross", (F.col("foreign") * F.col("cross") * (1 + 10 * b)).alias("score"))


def topology(edges: DataFrame, members: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Communities with their size and mean rank; and links between two of them with edge count and strongest bridge."""
    m = members.select("id", "community")
    of = m.join(scores, "id").groupBy("community").agg(F.count("*").alias("size"), F.avg("score").alias("mean_rank"))
    x = _both_ends(edges, members).filter("c_src <> c_dst")
    links = x.groupBy(F.least("c_src", "c_dst").alias("a"), F.greatest("c_src", "c_dst").alias("b")).agg(F.count("*").alias("edges"), F.max(F.struct("weight", "src", "dst")).alias("m"))
    return of, links.select("a", "b", "edges", F.col("m.src").alias("strongest"))


def topological_confidence(ranks: DataFrame, paths: DataFrame) -> DataFrame:
    """id, topo: 0.6 * rank / max + 0.4 * path diversity / max."""
    j = ranks.select("id", F.col("score").alias("r")).join(paths.select("id", F.col("score").alias("p")), "id", "full_outer")
    top = j.agg(F.max("r").alias("_r"), F.max("p").alias("_p"))
    part = lambda x, m: F.coalesce(F.try_divide(F.col(x), F.col(m)), F.lit(0.0))
    return j.join(F.broadcast(top)).select("id", (0.6 * part("r", "_r") + 0.4 * part("p", "_p")).alias("topo"))


def landmarks(members: DataFrame, nodes: DataFrame, scores: DataFrame, k: int = 3) -> DataFrame:
    """community, label: the names of its k best nodes."""
    w = Window.partitionBy("community").orderBy(F.desc(F.round("score", 12)), "id")
    t = members.select("id", "community").join(scores, "id").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k)
    named = t.join(nodes.select("id", "name"), "id").groupBy("community").agg(F.array_sort(F.collect_list(F.struct("n", "name"))).alias("x"))
    return named.select("community", F.array_join(F.transform("x", lambda x: x["name"]), ", ").alias("label"))


def resolve_name(nodes: DataFrame, name: str) -> DataFrame:
    """The node of that name, any case; else that with most mentions whose name holds it."""
    low, want = F.lower("name"), name.lower()
    return nodes.filter(low.contains(want)).withColumn("_p", (low != want).cast("int")).orderBy("_p", F.desc("mention_count"), "id").limit(1).drop("_p")


def blast_radius(nodes: DataFrame, edges: DataFrame, name: str, hops: int = 2, cap: int = 50) -> DataFrame:
    """id, hops of what is near a node, nearest first, ``cap`` at most (the report's length)."""
    found = bfs(edges, resolve_name(nodes, name).select("id"), hops)
    return found.select("id", "hops").orderBy("hops", "id").limit(cap)


def merged(nodes: DataFrame, edges: DataFrame, into: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with each ``old`` node of ``into`` (old, new) folded into its ``new`` one: mentions added, edges moved, loops gone."""
    to = lambda c: into.select(F.col("old").alias(c), F.col("new").alias(f"_{c}"))
    n = nodes.join(to("id"), "id", "left").withColumn("_to", F.coalesce("_id", "id"))
    others = [c for c in nodes.columns if c not in ("id", "mention_count")]
    first = [F.min_by(c, F.struct((F.col("id") != F.col("_to")).cast("int"), "id")).alias(c) for c in others]
    n = n.groupBy(F.col("_to").alias("id")).agg(*first, F.sum("mention_count").alias("mention_count")).select(*nodes.columns)
    e = edges.join(to("src"), "src", "left").join(to("dst"), "dst", "left").withColumns({"src": F.coalesce("_src", "src"), "dst": F.coalesce("_dst", "dst")})
    return n, e.filter("src <> dst").select(*edges.columns)
