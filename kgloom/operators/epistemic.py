"""Confidence over the graph: opinions from extractions, attacks to a fixed point, decay and forgetting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import opinion as O
from ..plans.lineage import cut, dealt


def seeded(extractions: DataFrame, by: str = "entity_id") -> DataFrame:
    """by, n, b, d, u, p: cumulative fusion of the opinions of all extractions.

    In the form of sums (b/u, d/u, 1/u), which fuses in any order and combines in each task first: no list of a hot entity's
    extractions is ever built. u is 0.7 * (1 - b) with b at most 0.99, so never 0.
    """
    o = O.of_confidence(F.col("confidence"))
    x = extractions.select(by, o.alias("o"))
    g = x.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.col("o.b") / F.col("o.u")).alias("sb"), F.sum(F.col("o.d") / F.col("o.u")).alias("sd"), F.sum(1 / F.col("o.u")).alias("su"))
    k = F.col("su") - (F.col("n") - 1)
    out = g.select(by, "n", (F.col("sb") / k).alias("b"), (F.col("sd") / k).alias("d"), (1 / k).alias("u"))
    return out.withColumn("p", F.col("b") + 0.5 * F.col("u"))


def factor(kind: Column, attacker: Column, weight: Column) -> Column:
    """What an attack leaves of its target."""
    return F.when(kind == "corrects", 0.0).when(kind == "contends", 1 - attacker * O.CONTENDS * weight).otherwise(1 - attacker * weight)


def closure(claims: DataFrame, attacks: DataFrame, damping: float = 0.8, epsilon: float = 1e-6, most: int = 500) -> DataFrame:
    """id, p: claims (id, p) under attacks (attacker, target, kind, weight), to a fixed point.

    Each round, all attacks read the round before; those on one target multiply. The sum of logarithms of factors is the
    product, and is combined in each task first; a factor of 0 is counted apart. The joins are merges, as a broadcast in each
    round would send all claims to the driver again and again.
    """
    base = cut(claims.select("id", F.col("p").alias("p0")))
    now = cut(base.withColumn("p", F.col("p0")))
    a = cut(attacks.select("attacker", "target", F.lower("kind").alias("kind"), "weight"))
    for _ in range(most):
        f = F.greatest(factor(F.col("kind"), F.col("p"), F.col("weight")), F.lit(0.0))
        hit = a.join(now.select(F.col("id").alias("attacker"), "p").hint("merge"), "attacker").select("target", f.alias("f"))
        left = hit.groupBy(F.col("target").alias("id")).agg(F.when(F.count_if(F.col("f") <= 0) > 0, 0.0).otherwise(F.exp(F.sum(F.when(F.col("f") > 0, F.ln("f"))))).alias("f"))
        new = now.join(left.hint("merge"), "id", "left").withColumn("n", F.col("p0") * F.coalesce("f", F.lit(1.0)))
        new = cut(new.select("id", "p0", (F.col("p") + damping * (F.col("n") - F.col("p"))).alias("p"), F.abs(damping * (F.col("n") - F.col("p"))).alias("change")))
        now = new.drop("change")
        if (new.agg(F.max("change")).first()[0] or 0.0) < epsilon:
            break
    return now.select("id", "p")


def propagated(extractions: DataFrame, attacks: DataFrame, topology: DataFrame, gamma: float = 0.4) -> DataFrame:
    """id, p, confidence: opinions of extractions, attacks, then the composite with the topology (id, topo)."""
    claims = seeded(extractions).select(F.col("entity_id").alias("id"), "p")
    done = closure(claims, attacks)
    return done.join(topology, "id", "left").select("id", "p", O.composite(F.col("p"), F.coalesce("topo", F.lit(0.5)), gamma).alias("confidence"))


def evicted(signals: DataFrame, least: float = 0.1) -> DataFrame:
    """Adds score, decision: protected, keep or evict. Signals: structural, activation, accommodations, contradiction_days."""
    s = signals.withColumn("score", O.keep_score(F.col("structural"), F.col("activation"), F.col("accommodations"), F.col("contradiction_days")))
    safe = (F.col("structural") > 0.5) | (F.col("accommodations") >= 3)
    return s.withColumn("decision", F.when(safe, "protected").when(F.col("score") < least, "evict").otherwise("keep"))


def without_sources(extractions: DataFrame, nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The extractions, nodes and edges that are left when the chunks of ``gone`` (chunk_id) go: nodes without support go with their edges,
    the others have their mentions counted anew."""
    x, g = dealt(extractions.count(), (extractions, ["chunk_id"]), (gone.select("chunk_id"), ["chunk_id"]))
    left = x.join(g, "chunk_id", "left_anti").select(*extractions.columns)
    # One pass for each entity: how many of its extractions stay, how many go.
    marked = x.select("chunk_id", "entity_id").join(g.distinct().withColumn("_g", F.lit(True)), "chunk_id", "left")
    per = marked.groupBy(F.col("entity_id").alias("id")).agg(F.count_if(F.col("_g").isNull()).alias("_stay"), F.count("_g").alias("_go"))
    lost = per.filter("_stay = 0").select("id")
    n = nodes.join(per, "id", "left").filter("_stay IS NULL OR _stay > 0").withColumn("mention_count", F.coalesce("_stay", "mention_count"))
    e = edges.join(lost.withColumnRenamed("id", "src"), "src", "left_anti").join(lost.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return left, n.select(*nodes.columns), e.select(*edges.columns)
