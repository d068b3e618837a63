"""Retrieval quality: results are (query, id, rank), judgments (query, id, grade)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(results: DataFrame, judged: DataFrame, k: int = 5) -> DataFrame:
    """query, precision, recall, ndcg, mrr. Precision is over what was returned, the ideal order over all grades."""
    top = results.join(judged, ["query", "id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    return scored(top, judged.filter("grade > 0").groupBy("query", "grade").agg(F.count("*").alias("n")), k)


def scored(top: DataFrame, totals: DataFrame, k: int = 5) -> DataFrame:
    """As ``metrics``, of graded results (query, rank, grade) and the number ``n`` of rows judged with each grade above 0 (query, grade, n)."""
    cutoff = F.col("rank") <= k
    gain = lambda g, r: g / F.log2(r + 1)
    a = top.groupBy("query").agg(
        F.count_if(cutoff & (F.col("grade") > 0)).alias("hits"), F.count_if(cutoff).alias("shown"), F.sum(F.when(cutoff, gain(F.col("grade"), F.col("rank")))).alias("dcg"),
        F.coalesce(1 / F.min(F.when(F.col("grade") > 0, F.col("rank"))), F.lit(0.0)).alias("mrr"),
    )
    ideal = F.expr(f"transform(slice(flatten(transform(sort_array(collect_list(struct(grade, n)), false), x -> array_repeat(x.grade, cast(least(x.n, {k}) AS int)))), 1, {k}), (g, i) -> g / log2(i + 2))")
    i = totals.groupBy("query").agg(F.sum("n").alias("relevant"), F.aggregate(ideal, F.lit(0.0), lambda s, x: s + x).alias("ideal"))
    share = lambda x, y: F.coalesce(F.try_divide(F.col(x), F.col(y)), F.lit(0.0))
    return a.join(i, "query", "left").select("query", share("hits", "shown").alias("precision"), share("hits", "relevant").alias("recall"), share("dcg", "ideal").alias("ndcg"), "mrr")


def extraction(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """One row: precision, recall, f1 of the sets of (lower-case) keys."""
    norm = lambda df: df.select(*(F.lower(k).alias(k) for k in keys)).distinct()
    p, g = norm(predicted).withColumn("_p", F.lit(1)), norm(gold).withColumn("_g", F.lit(1))
    n = p.join(g, keys, "full_outer").agg(F.count(F.when(F.col("_p").isNotNull() & F.col("_g").isNotNull(), 1)).alias("both"), F.count("_p").alias("np"), F.count("_g").alias("ng"))
    share = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    return n.select(share(F.col("both"), F.col("np")).alias("precision"), share(F.col("both"), F.col("ng")).alias("recall"), share(2.0 * F.col("both"), F.col("np") + F.col("ng")).alias("f1"))


def regression(current: DataFrame, baseline: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """metric, value, passed: a value may be below its baseline by the tolerance; a missing one is 0."""
    j = baseline.select("metric", F.col("value").alias("b")).join(current.select("metric", "value"), "metric", "left")
    v = F.coalesce("value", F.lit(0.0))
    return j.select("metric", v.alias("value"), (v >= F.col("b") * (1 - tolerance)).alias("passed"))


def search_regression(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """query, regressed: no results, or more than one fewer than before."""
    j = baseline.select("query", F.col("n").alias("b")).join(current.select("query", "n"), "query", "left")
    n = F.coalesce("n", F.lit(0))
    return j.select("query", n.alias("n"), ((n == 0) | (F.col("b") - n > 1)).alias("regressed"))


def chunk_coverage(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """source_id, coverage, n, mean: bytes of chunks over bytes of the source, 1 at most."""
    c = chunks.groupBy("source_id").agg(F.sum(F.octet_length("content")).alias("bytes"), F.count("*").alias("n"), F.avg(F.octet_length("content")).alias("mean"))
    s = sources.select(F.col("id").alias("source_id"), F.octet_length("content").alias("whole"))
    return s.join(c, "source_id", "left").select("source_id", F.least(F.coalesce(F.try_divide("bytes", "whole"), F.lit(0.0)), F.lit(1.0)).alias("coverage"), F.coalesce("n", F.lit(0)).alias("n"), "mean")
