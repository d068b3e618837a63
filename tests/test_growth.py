"""Work and memory that must not grow faster than the input: plans and peaks of operators, beside their results."""

import random
import re

from pyspark.sql import functions as F

from kgloom.functions import text as T
from kgloom.operators import epistemic, graph, resolve, retrieve, services
from kgloom.plans import catalog


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_research_is_folded_before_it_meets_code(spark):
    edges = spark.createDataFrame([(k, 1000 + k % 2, "PART_OF_COMPONENT", False) for k in range(40)], "src long, dst long, rel_type string, invalid boolean")
    near = spark.createDataFrame([(1000 + k % 2, 1.0 + k) for k in range(60)], "component long, distance double")
    out = retrieve.by_component(edges, edges.select(F.col("src").alias("id")), near)
    assert {tuple(r) for r in out.collect()} == {(k, 1.0 + k % 2) for k in range(40)}
    assert plan(out).count("Aggregate") == 2


def test_linkage_holds_no_matrix(spark):
    import tracemalloc

    import numpy as np

    x = np.random.default_rng(5).normal(size=(3_000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tracemalloc.start()
    found = resolve.complete_linkage()(x, 0.3, 60_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3_000 * 3_000 * 8 / 4
    assert sorted(k for c in found for k in c) == list(range(3_000))
    sim = x @ x.T
    assert all(sim[np.ix_(c, c)].min() > 0.3 - 1e-9 for c in found)
    # Nothing is left to merge.
    lows = np.array([np.minimum.reduce([sim[k] for k in c]) for c in found])
    link = np.array([[lows[a][c].min() for c in found] for a in range(len(found))])
    np.fill_diagonal(link, -2)
    assert link.max() < 0.3 + 1e-9


def test_words_and_windows_in_one_pass(spark):
    texts = ["", None, "tion", "xtiontionx", "é" * 30 + "tion" + "😀" * 40 + "tiontio", "a\nb\r\ntion" * 50, "y" * 190, "y" * 191, "tio"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r["at"] for r in df.select("id", services.occurrences(F.col("text"), "tion").alias("at")).collect()}
    assert got == {k: None if t is None else [i for i in range(len(t)) if t.startswith("tion", i)] for k, t in enumerate(texts)}
    w = services.coref_windows(df, 100, 10)
    want = {(k, n, n * 90): None if t is None else t[n * 90 : n * 90 + 100] for k, t in enumerate(texts) for n in range(max(-(-(len(t or "") - 10) // 90), 1))}
    assert {tuple(r)[:3]: r["text"] for r in w.collect()} == want
    assert "substring" not in plan(w)


def test_health_joins_the_orphans_once(spark):
    n = spark.range(0, 5).unionAll(spark.range(5, 9)).select("id", F.lit("x").alias("entity_class"), F.lit(None).cast("array<double>").alias("embedding"), F.lit("").alias("summary"))
    s = spark.createDataFrame([(1, "a", None, ""), (2, "a", None, "x"), (3, "b", 2, "x"), (4, None, 2, None)], "id long, uri string, superseded_by long, summary string")
    c = spark.createDataFrame([(1,), (3,), (3,), (4,), (9,), (None,)], "source_id long")
    x = spark.createDataFrame([(0,), (0,), (6,)], "entity_id long")
    e = spark.createDataFrame([(1, 2), (0, 7), (1, 7)], "src long, dst long")
    out = services.data_health(n, e, s, c, x)
    assert out.first().asDict() == {"superseded_sources": 2, "unsummarized_sources": 1, "superseded_chunks": 3, "orphan_nodes": 7, "orphan_nodes_with_edges": 3, "duplicate_sources": 2, "unembedded_nodes": 9, "unsummarized_code": 0}
    assert services.data_health(n, e, s, c.limit(0), x).first()["superseded_chunks"] == 0
    assert "LeftAnti" not in plan(out)


def test_closure_broadcasts_no_claims(spark, monkeypatch):
    seen, cut = [], epistemic.cut
    monkeypatch.setattr(epistemic, "cut", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    claims = spark.createDataFrame([(1, 0.8), (2, 0.6), (3, 0.5)], "id long, p double")
    attacks = spark.createDataFrame([(1, 2, "contradicts", 0.5), (2, 3, "contends", 1.0)], "attacker long, target long, kind string, weight double")
    got = {r["id"]: r["p"] for r in epistemic.closure(claims, attacks, epsilon=1e-10).collect()}
    assert abs(got[2] - 0.6 * (1 - 0.8 * 0.5)) < 1e-8 and got[1] == 0.8
    assert not any("BroadcastExchange" in p for p in seen) and any("SortMergeJoin" in p for p in seen)


def test_cores_send_only_what_moves(spark, monkeypatch):
    sent, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: sent.append(df.count()) or cut(df))
    es = [(0, k) for k in range(1, 301)] + [(a, b) for a in range(400, 405) for b in range(400, a)] + [(0, 400), (7, 7)]
    ns = spark.range(0, 301).unionAll(spark.range(400, 406))
    got = {r["id"]: r["core"] for r in graph.cores(ns, spark.createDataFrame(es, "src long, dst long")).collect()}
    assert got == {k: 1 for k in range(301)} | {k: 4 for k in range(400, 405)} | {405: 0}
    assert sent and max(sent) < 50


def test_cooccurrence_makes_its_pairs_once(spark):
    out = catalog.QUERIES["cooccurrence_edges"](spark, "/root/testdata/sf0.001")
    assert plan(out).count("Join ") == 2
    assert out.columns == ["src", "dst", "n", "weight", "confidence"]


def test_plain_names_meet_few_rules(spark):
    def noise(name):
        n, low = name.strip(" "), name.strip(" ").lower()
        found = lambda *rules: any(re.search(r, x, re.A) for r, x in rules)
        return n == "" or "\n" in n or (len(n) <= 2 and n not in T.SHORT_NAMES) or low in T.PRIMITIVES or low in T.GENERIC or len(n) > 120 or found(
            (r"</?[a-z]+[^>]*>", n), (r"^\W+$", n), (r"^(https?|ftp)://|^www\.", low), (T.MAIL, n), (r"^[+-]?[0-9][0-9.,%]*$", n), (r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", n),
            (r"^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* [0-9]{1,4}$", low), (r"[{};=]|->|=>|::<|\(\)$", n), (r"^\$.*\$$|\\[a-z]+\{", n), (r"^(how|what|when|where|which|who|why) .*\?$", low),
            (r"^(the|this|that|these|those|our|their) \w+$", low), (r"^(section|figure|table|chapter|eq\.?) [0-9]", n), (r"^[._/]|/.*/.*\.[a-z]{1,4}$", n),
        )

    rng = random.Random(7)
    bits = ["the", "The", "May", "june", "int", "Paper", "section", "Section", "eq", "eq.", "AI", "x", "ab", "12", "2024", "1", " ", " ", " ", "_", "-", ".", "@", "/", "?", "()", "<b>", "$", "=", "é", "\n", "www.", "who", "a" * 119]
    names = sorted({"".join(rng.choice(bits) for _ in range(rng.randint(0, 4))) for _ in range(3_000)})
    out = spark.createDataFrame([(n,) for n in names], "name string").select("name", T.noise_name(F.col("name")).alias("noise"))
    assert {r["name"]: r["noise"] for r in out.collect()} == {n: noise(n) for n in names}
    assert "CASE WHEN" in plan(out)
