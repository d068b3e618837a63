"""Ranked lists: ranking, fusion, gating, demotion, diversification. Lists are rows (dimension, id, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values, as results must be the same: dimensions and the weights of each strategy in their order.
DIMENSIONS = ("vector", "lexical", "temporal", "graph", "structural", "global")
STRATEGIES = {
    "balanced": (0.28, 0.22, 0.13, 0.18, 0.09, 0.10), "precise": (0.38, 0.33, 0.05, 0.14, 0.05, 0.05), "exploratory": (0.18, 0.09, 0.09, 0.32, 0.22, 0.10),
    "recent": (0.23, 0.18, 0.33, 0.14, 0.05, 0.07), "graph_first": (0.14, 0.09, 0.05, 0.42, 0.22, 0.08), "global": (0.10, 0.05, 0.05, 0.10, 0.10, 0.60),
}


def weight_of(dimension: Column, strategy: str | dict[str, float]) -> Column:
    """The normalised weight of a dimension, as an expression: six constants need no join."""
    given = strategy if isinstance(strategy, dict) else dict(zip(DIMENSIONS, STRATEGIES[strategy], strict=True))
    total, out = sum(given.values()), F.lit(0.0)
    for name, w in given.items():
        out = F.when(dimension == name, w / total).otherwise(out)
    return out


def ranked(lists: DataFrame) -> DataFrame:
    """Adds rank, from 1, by score; ties by id."""
    return lists.withColumn("rank", F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("score"), "id")))


def top(df: DataFrame, k: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(k)


def limits(limit: int) -> dict[str, int]:
    """The share of each table in a vector search, by whole division, 2 at least."""
    shares = {"chunk": 35, "node": 20, "statement": 20, "section": 10, "article": 8, "source": 7}
    return {k: max(2, limit * v // 100) for k, v in shares.items()}


def rrf(lists: DataFrame, strategy="balanced", k: int = 60) -> DataFrame:
    """id, score: weights over k + rank, summed over the lists. ``lists`` has ranks."""
    return lists.groupBy("id").agg(F.sum(weight_of(F.col("dimension"), strategy) / (k + F.col("rank"))).alias("score"))


def normalised(lists: DataFrame) -> DataFrame:
    """Adds norm: min-max by dimension; 1 where all scores are equal; 0 for what isn't a number."""
    w = Window.partitionBy("dimension")
    score = F.when(F.isnan("score") | F.col("score").isNull() | (F.abs("score") == float("inf")), 0.0).otherwise(F.col("score"))
    s = lists.withColumn("score", score).withColumns({"_lo": F.min("score").over(w), "_hi": F.max("score").over(w)})
    span = F.col("_hi") - F.col("_lo")
    return s.withColumn("norm", F.when(span <= 1e-12, 1.0).otherwise((F.col("score") - F.col("_lo")) / span)).drop("_lo", "_hi")


def convex(lists: DataFrame, strategy="balanced") -> DataFrame:
    """id, score: weighted normalised scores, times 0.5 + 0.5 * dimensions / active dimensions if several are active."""
    active = lists.select("dimension").distinct().agg(F.count("*").alias("active"))
    s = normalised(lists).groupBy("id").agg(F.sum(weight_of(F.col("dimension"), strategy) * F.col("norm")).alias("s"), F.countDistinct("dimension").alias("dims"))
    return s.join(F.broadcast(active)).select("id", (F.col("s") * F.when(F.col("active") > 1, 0.5 + 0.5 * F.col("dims") / F.col("active")).otherwise(1.0)).alias("score"))


def gini(scores: DataFrame, by: str) -> DataFrame:
    """The Gini coefficient of the scores of each group; 0 for fewer than two, or a total of 0.

    The Lorenz sum needs ranks inside a group, whose window Spark spills; groups are rankings of a query.
    """
    r = scores.withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy("score")))
    n, total = F.count("*"), F.sum("score")
    value = 2 * F.sum(F.col("_i") * F.col("score")) / (n * F.nullif(total, F.lit(0.0))) - (n + 1) / n
    return r.groupBy(by).agg(F.when((n < 2) | (total == 0), 0.0).otherwise(value).alias("gini"), n.alias("n"))


def route(ginis: DataFrame) -> DataFrame:
    """Skewed scores ask for precision, flat ones for a global search."""
    return ginis.withColumn("strategy", F.when(F.col("n") < 5, "balanced").when(F.col("gini") > 0.5, "precise").when(F.col("gini") < 0.15, "global").otherwise("balanced"))


def gate(lists: DataFrame, strategy="balanced", least_spread: float = 0.05) -> DataFrame:
    """dimension, weight: lists of little spread lose weight, which the others get in proportion to theirs."""
    top_, low = F.max("score"), F.min("score")
    spread = F.when(F.count("*") < 2, 1.0).when(top_ <= 0, 0.0).otherwise((top_ - low) / F.nullif(top_, F.lit(0.0)))
    s = lists.groupBy("dimension").agg(spread.alias("spread")).withColumn("full", weight_of(F.col("dimension"), strategy))
    s = s.withColumn("kept", F.col("full") * F.least(F.col("spread") / least_spread, F.lit(1.0)))
    s = s.withColumn("kept", F.when(F.col("kept") < 1e-12, 0.0).otherwise(F.col("kept")))
    total = s.agg(F.sum("kept").alias("_sum"))
    return s.join(F.broadcast(total)).select("dimension", "spread", F.when(F.col("_sum") > 0, F.col("kept") / F.col("_sum")).otherwise(0.0).alias("weight"))


def abstains(results: DataFrame, least_results: int = 1, least_score: float = 0.001) -> DataFrame:
    n, best = F.count("*"), F.coalesce(F.max("score"), F.lit(0.0))
    return results.agg(((n == 0) | (n < least_results) | (best < least_score)).alias("abstain"), n.alias("n_results"))


def demoted(score: Column, result_type: Column, dims: Column, named: Column) -> Column:
    """Bare nodes found in few dimensions count less, unless the query names them."""
    bare = (result_type == "node") & ~named
    return score * F.when(bare & (dims <= 1), 0.3).when(bare & (dims == 2), 0.5).when(bare, 0.7).otherwise(1.0)


def code_demoted(score: Column, result_type: Column, source_type: Column) -> Column:
    return score * F.when((result_type != "node") & (F.coalesce(source_type, F.lit("")) == "code"), 0.5).otherwise(1.0)


def boosted(score: Column, confidence: Column) -> Column:
    return F.when(confidence.isNull(), score).otherwise(score * (1 + 0.3 * (confidence - 0.5)))


def blended(fused: Column, rerank: Column, best: Column) -> Column:
    return 0.6 * fused + 0.4 * F.coalesce(rerank / F.nullif(best, F.lit(0.0)), F.lit(0.0))


def self_referential(results: DataFrame) -> DataFrame:
    """Internal results (column ``internal``) get 1.5 times their score if they rival external ones, or code fills the top 10."""
    best = lambda flag: F.coalesce(F.max(F.when(F.col("internal") == flag, F.col("score"))), F.lit(0.0))
    tops = results.agg(best(True).alias("_in"), best(False).alias("_ex"))
    code = top(results, 10, F.desc("score"), "id").agg(F.count_if(F.col("entity_class") == "code").alias("_code"))
    on = (F.col("_ex") > 1e-9) & ((F.col("_in") / F.nullif(F.col("_ex"), F.lit(0.0)) >= 0.7) | (F.col("_code") >= 3))
    both = results.join(F.broadcast(tops)).join(F.broadcast(code))
    return both.withColumn("score", F.when(F.coalesce(on, F.lit(False)) & F.col("internal"), F.col("score") * 1.5).otherwise(F.col("score"))).drop("_in", "_ex", "_code")


def post_filters(results: DataFrame, least_confidence=None, node_types=None, entity_classes=None, source_types=None, domains=None) -> DataFrame:
    """Null confidence and node type fail their filter; null class and source type, and no domains, pass."""
    out = results
    if least_confidence is not None:
        out = out.filter(F.coalesce(F.col("confidence") >= least_confidence, F.lit(False)))
    if node_types:
        out = out.filter(F.coalesce(F.col("node_type").isin(*node_types), F.lit(False)))
    for name, allowed in (("entity_class", entity_classes), ("source_type", source_types)):
        if allowed:
            out = out.filter(F.col(name).isNull() | F.col(name).isin(*allowed))
    if domains:
        out = out.filter(F.col("domains").isNull() | (F.size("domains") == 0) | F.arrays_overlap("domains", F.lit(list(domains))))
    return out


def diversified(results: DataFrame, per_uri: int = 2, prefix: int = 100) -> DataFrame:
    """Passes in order: the first of each (uri, prefix), the first of each prefix, at most ``per_uri`` of a uri. Results have id, uri, content, score."""
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    out = results.withColumn("_p", F.substring("content", 1, prefix))
    for by, most in ((("uri", "_p"), 1), (("_p",), 1), (("uri",), per_uri)):
        out = out.withColumn("_n", nth(*by)).filter(F.col("_n") <= most).drop("_n")
    return out.drop("_p")


def per_source(results: DataFrame, most: int = 3) -> DataFrame:
    """At most ``most`` of a source; those without one share a bucket."""
    w = Window.partitionBy(F.coalesce(F.col("source").cast("string"), F.lit("__no_source__"))).orderBy(F.desc("score"), "id")
    return results.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def within_budget(results: DataFrame, by: str, budget: int = 8000) -> DataFrame:
    """The results of each query (column ``by``) up to the first that passes the token budget."""
    return results.withColumn("used", F.sum("tokens").over(Window.partitionBy(by).orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("used") <= budget)


def nodes_last(results: DataFrame) -> DataFrame:
    """Ranks anew: what isn't a node first."""
    return results.withColumn("rank", F.row_number().over(Window.partitionBy("dimension").orderBy((F.col("result_type") == "node").cast("int"), F.desc("score"), "id")))


def token_count(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4).cast("long")


def snippet(content: Column, term: Column, window: int = 200) -> Column:
    """Around the first place of ``term``, cut at blanks, with ellipses; counted in characters."""
    at = F.instr(F.lower(content), F.lower(term))
    begin = F.greatest(at - window // 2, F.lit(1))
    part = F.substring(content, begin, F.lit(window))
    part = F.when(begin > 1, F.concat(F.lit("..."), F.regexp_replace(part, r"^\S{0,29}\s+", ""))).otherwise(part)
    return F.when(begin + window <= F.length(content), F.concat(F.regexp_replace(part, r"\s+\S{0,29}\z", ""), F.lit("..."))).otherwise(part)
