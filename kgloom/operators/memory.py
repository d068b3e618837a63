"""Memories, sessions, context and answers. What a language model would write comes from deterministic stand-ins."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import vector as V
from . import fusion


def recalled(memories: DataFrame, scores: DataFrame, now: Column, agent: str | None = None, topic: str | None = None, k: int = 10) -> DataFrame:
    """Memories that aren't expired, of an agent and topic, by score."""
    m = memories.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    if agent is not None:
        m = m.filter(F.col("agent") == agent)
    if topic is not None:
        m = m.filter(F.col("topic") == topic)
    return m.join(scores, "id").orderBy(F.desc("score"), "id").limit(k)


def accessed(memories: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    hit = ids.select("id", F.lit(True).alias("_hit")).distinct()
    j = memories.join(hit, "id", "left")
    return j.withColumns({"access_count": F.col("access_count") + F.when(F.col("_hit"), 1).otherwise(0), "last_access": F.when(F.col("_hit"), now).otherwise(F.col("last_access"))}).drop("_hit")


def forgotten(memories: DataFrame, now: Column, oldest_days: int = 90) -> DataFrame:
    """Expired by their own date, or by age where they have none."""
    own = memories.filter(F.col("expires_at").isNotNull() & (F.col("expires_at") <= now))
    old = memories.filter(F.col("expires_at").isNull() & (F.col("created_at") < now - F.make_dt_interval(F.lit(oldest_days))))
    return own.unionByName(old)


def consolidated(memories: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Adds group: greedy, in order of id inside a topic: the first memory at least ``threshold`` similar (cosine of ``embedding``) leads. Sequential, so by topic."""
    import numpy as np

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id", kind="stable")
        x = np.array([np.asarray(e, float) for e in g["embedding"]])
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        ids, out, lead, n = g["id"].to_numpy(), [], [], 0
        held = np.empty((16, x.shape[1] if len(g) else 0))
        for k in range(len(g)):
            near = np.flatnonzero(held[:n] @ x[k] >= threshold)
            if not len(near):
                if n == len(held):
                    held = np.concatenate([held, np.empty_like(held)])
                held[n] = x[k]
                n += 1
                lead.append(k)
            out.append(int(ids[lead[near[0]] if len(near) else k]))
        return g.assign(group=out)

    return memories.groupBy("topic").applyInPandas(run, T_.StructType([*memories.schema.fields, T_.StructField("group", T_.LongType())]))


def ordinals(turns: DataFrame, existing: DataFrame) -> DataFrame:
    """New turns numbered on from the last of their session."""
    last = existing.groupBy("session").agg(F.max("ordinal").alias("_last"))
    n = F.expr("row_number() OVER (PARTITION BY session ORDER BY id)")
    return turns.withColumn("_n", n).join(last, "session", "left").withColumn("ordinal", F.coalesce("_last", F.lit(0)) + F.col("_n")).drop("_n", "_last")


def reflected(turns: DataFrame, reflect: Callable[[Column], Column] | None = None) -> DataFrame:
    """session, memory: a row for each line that ``reflect`` makes of the transcript; by default, the assistant's lines."""
    said = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    t = turns.groupBy(F.col("conv_id").alias("session")).agg(said.alias("x"))
    default = lambda x: F.flatten(F.transform(F.filter(x, lambda s: s["role"] == "assistant"), lambda s: F.split(s["text"], "\n")))
    lines = (reflect or default)(F.col("x"))
    return t.select("session", F.explode(F.filter(lines, lambda s: F.trim(s) != "")).alias("memory"))


def context(results: DataFrame, by: str, budget: int = 8000, per_source: int = 3) -> DataFrame:
    """Results (by, id, source, content, snippet, name, score) assembled: content, else snippet, else name; at most some of a source; within the budget; numbered."""
    r = results.withColumn("content", F.coalesce("content", "snippet", "name")).withColumn("tokens", fusion.token_count(F.col("content")))
    r = r.withColumn("_k", F.expr(f"row_number() OVER (PARTITION BY {by}, coalesce(cast(source AS string), '__no_source__') ORDER BY score DESC, id)")).filter(F.col("_k") <= per_source).drop("_k")
    kept = fusion.within_budget(r, by, budget)
    return kept.withColumn("n", F.expr(f"row_number() OVER (PARTITION BY {by} ORDER BY score DESC, id)"))


def deduplicated(items: DataFrame, by: str, threshold: float = 0.95) -> DataFrame:
    """``items`` (by, id, score, embedding) without those that a kept one with a better score, or as good a one and a smaller id,
    resembles: cosine above ``threshold``, for vectors of one length. Items without a vector stay. ``items`` are the results of
    a query, so that a group is small; it is folded in one expression."""
    kind = dict(items.dtypes)["id"]
    seen = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id", "embedding")))
    zero = F.expr(f"cast(array() as array<struct<minus:double,id:{kind},embedding:{dict(items.dtypes)['embedding']}>>)")
    same = lambda k, x: F.when(F.size(k["embedding"]) == F.size(x["embedding"]), V.cosine(k["embedding"], x["embedding"]) > threshold).otherwise(False)
    step = lambda kept, x: F.when(x["embedding"].isNotNull() & F.exists(kept, lambda k: same(k, x)), kept).otherwise(F.concat(kept, F.array(x)))
    kept = items.filter(F.col("id").isNotNull()).groupBy(by).agg(F.aggregate(seen, zero, step).alias("x")).select(by, F.explode(F.transform("x", lambda k: k["id"])).alias("id"))
    return items.join(kept, [by, "id"], "left_semi").select(*items.columns)


def prompt(items: DataFrame, by: str) -> DataFrame:
    """by, blocks: '[n] (type, confidence: c, domain, source)' and up to 2,000 characters of each item, in order."""
    head = F.format_string("[%d] (%s, confidence: %.2f, %s, %s)\n%s", "n", "node_type", "confidence", "domain", "source", F.substring("content", 1, 2000))
    g = items.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("n", head.alias("t")))).alias("x"))
    return g.select(by, F.array_join(F.transform("x", lambda x: x["t"]), "\n\n").alias("blocks"))


def community_summary(members: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """community, summary: its key entities and up to ``most`` relations inside it."""
    n = members.join(nodes.select("id", "name", "mention_count"), "id")
    key = n.withColumn("r", F.expr("row_number() OVER (PARTITION BY community ORDER BY mention_count DESC, id)")).filter(F.col("r") <= most)
    names = key.groupBy("community").agg(F.sort_array(F.collect_list(F.struct("r", "name"))).alias("x"))
    a, b = (n.select(F.col("id").alias(k), F.col("name").alias(f"{k}_name"), F.col("community").alias(f"{k}_c")) for k in ("src", "dst"))
    rel = edges.select("src", "dst", "rel_type").distinct().join(a, "src").join(b, "dst").filter("src_c = dst_c")
    rel = rel.withColumn("r", F.expr("row_number() OVER (PARTITION BY src_c ORDER BY src, dst, rel_type)")).filter(F.col("r") <= most)
    said = rel.groupBy(F.col("src_c").alias("community")).agg(F.sort_array(F.collect_list(F.struct("r", F.concat("src_name", F.lit(" --["), "rel_type", F.lit("]--> "), "dst_name").alias("t")))).alias("y"))
    text = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), ", " if f == "name" else "; ")
    j = names.join(said, "community", "left")
    return j.select("community", F.concat(F.lit("Key entities: "), text("x", "name"), F.lit("."), F.coalesce(F.concat(F.lit(" Relationships: "), text("y", "t"), F.lit(".")), F.lit(""))).alias("summary"))
