"""Blocked comparisons of vectors against plain loops: copies, odd vectors, several blocks."""

import math

import numpy as np
import pytest

from kgloom.operators import blocks, curate, evaluate, relational, resolve


def cosine(a, b):
    if not a or not b or len(a) != len(b) or None in a or None in b:
        return 0.0
    dot = na = nb = 0.0
    for x, y in zip(a, b):
        dot, na, nb = dot + x * y, na + x * x, nb + y * y
    return dot / (math.sqrt(na) * math.sqrt(nb)) if math.sqrt(na) >= 1e-12 and math.sqrt(nb) >= 1e-12 else 0.0


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=5)], k % 3) for k in range(60)]
    rows += [(60 + k, rows[k % 2][1], k % 3) for k in range(20)]  # copies
    rows += [(80, None, 0), (81, [], 1), (82, [0.0] * 5, 2), (83, [1.0, 2.0], 0), (84, [1.0, None, 1.0, 1.0, 1.0], 1)]
    return rows, spark.createDataFrame(rows, "id long, embedding array<double>, g long")


@pytest.fixture(params=["one block", "small blocks"])
def small(request, monkeypatch):
    if request.param == "small blocks":
        monkeypatch.setattr(blocks, "ROWS", 7)


def test_all_pairs(items, small):
    rows, df = items
    want = {(a[0], b[0]): max(1 - cosine(a[1], b[1]), 0.0) for a in rows for b in rows}
    for within in (0.4, 1.5):
        assert {r[:2]: r[2] for r in map(tuple, relational.close_pairs(df, df, within).collect())} == {k: d for k, d in want.items() if d < within}


def test_nearest_and_most_similar(items, small):
    rows, df = items
    got = {r[0]: r[1] for r in relational.nearest(df, df.filter("id > 9")).collect()}
    assert got == {a[0]: min((round(max(1 - cosine(a[1], b[1]), 0.0), 12), b[0]) for b in rows if b[0] > 9)[1] for a in rows}
    got = {(r["left_id"], r["rank"]): r["right_id"] for r in relational.most_similar(df, df, 4).collect()}
    assert got == {(a[0], n + 1): x[1] for a in rows for n, x in enumerate(sorted((-round(cosine(a[1], b[1]), 9), b[0]) for b in rows if b[0] != a[0])[:4])}


def test_best_by_key(items, small):
    rows, df = items
    got = {}
    for r in blocks.best(df, df.filter("id >= 30"), 1, 12, above=0.3, by="g").collect():
        got[r[0]] = min(got.get(r[0], (9, 9)), (-round(r[2], 12), r[1]))
    want = {a[0]: min(x) for a in rows if (x := [(-round(cosine(a[1], b[1]), 12), b[0]) for b in rows if b[0] >= 30 and a[2] == b[2] and cosine(a[1], b[1]) > 0.3])}
    assert got == want


def test_links_connect_what_pairs_connect(spark, items, small):
    rows, df = items
    near = {(a[0], b[0]) for a in rows for b in rows if max(1 - cosine(a[1], b[1]), 0.0) < 0.15}
    root = {a[0]: a[0] for a in rows}
    for _ in rows:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["id"]: r["cluster"] for r in resolve.linked_clusters(blocks.links(df, 0.15), df).collect()}
    assert got == root
    copies = spark.range(300).selectExpr("id", "array(1.0D, 2.0D) AS embedding")
    assert blocks.links(copies, 0.1).count() < 300 * 44  # not 300 squared


def test_recall_where_cells_would_meet_all(items):
    _, df = items
    pairs = lambda **k: {tuple(r) for r in relational.close_pairs(df, df, 0.6, **k).collect()}
    assert pairs(recall=0.95, bits=4) == pairs()


def test_rounding():
    x = np.array([0.1234565, 0.1234575, -0.5, 2.5e-7, 0.9999995, float("nan")])
    assert blocks.rounded(x, 6)[:5].tolist() == [123457.0, 123458.0, -500000.0, 0.0, 1000000.0]


def test_known_pairs_as_a_test(items):
    _, df = items
    from pyspark.sql import functions as F

    known = df.select(F.col("id").alias("src")).join(df.select(F.col("id").alias("dst")), (F.col("src") + F.col("dst")) % 2 == 0)
    rows = lambda k: {tuple(r) for r in curate.nearest_k(df, df, 2, 0.3, k).collect()}
    assert rows((F.col("src") + F.col("dst")) % 2 == 0) == rows(known)


def test_metrics_from_counts(spark):
    results = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "query long, id long, rank int")
    judged = spark.createDataFrame([(1, 11, 2), (1, 12, 1), (1, 13, 1), (1, 14, 0)], "query long, id long, grade int")
    ideal = 2 + 1 / math.log2(3) + 1 / 2
    got = {r["query"]: r for r in evaluate.metrics(results, judged).collect()}
    assert (got[1]["precision"], got[1]["recall"], got[1]["mrr"]) == (2 / 3, 2 / 3, 0.5) and got[1]["ndcg"] == pytest.approx((2 / math.log2(3) + 1 / 2) / ideal)
    assert tuple(got[2])[1:] == (0, 0, 0, 0)


def test_similar_names_by_rare_trigrams(spark):
    """Names that share only frequent trigrams make no pairs; what is similar is found."""
    from kgloom.functions import text as T

    names = [f"entity {k}" for k in range(150)] + ["entit 7", "fresh 31", "", "x"]
    df = spark.createDataFrame([(n,) for n in names], "key string")
    from pyspark.sql import functions as F

    g = {r[0]: set(r[1]) for r in df.select("key", T.trigrams(F.col("key"))).collect()}
    for t in (0.3, 0.5, 1.0):
        want = {(a, b): len(g[a] & g[b]) / len(g[a] | g[b]) for a in names for b in names if g[a] & g[b] and len(g[a] & g[b]) / len(g[a] | g[b]) >= t}
        assert {r[:2]: r[2] for r in map(tuple, resolve.similar_names(df, df.withColumnRenamed("key", "name"), t).collect())} == want


def test_rank_of_sinks_and_nodes_without_weight(spark):
    """Sinks, lone nodes, nodes whose edges weigh nothing, ends outside the nodes: as the plain rounds have it."""
    from pyspark.sql import functions as F

    from kgloom.operators import graph

    es = [(1, 2, 1.0), (1, 3, 3.0), (2, 1, 1.0), (2, 2, 0.5), (2, 9, 2.0), (3, 4, 1.0), (5, 1, 0.0), (6, 99, 1.0), (98, 1, 1.0)]
    ids = [1, 2, 3, 4, 5, 6, 7, 9]
    nodes, edges = spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(es, "src long, dst long, w double")
    for lose in (False, True):
        for rounds in (0, 1, 2, 7):
            total, has = {}, set()
            for s, _, w in es:
                total[s] = total.get(s, 0) + w
            has = {s for s in total if lose or total[s] > 0}
            tele = {i: {1: 0.75, 4: 0.25}.get(i, 0.0) for i in ids}
            now = dict.fromkeys(ids, 1 / len(ids))
            for _ in range(rounds):
                mass = sum(now[i] for i in ids if i not in has)
                flow = dict.fromkeys(ids, 0.0)
                for s, d, w in es:
                    if s in now and d in now and total[s] > 0:
                        flow[d] += now[s] * w / total[s]
                now = {i: tele[i] * (0.15 + 0.85 * mass) + 0.85 * flow[i] for i in ids}
            seeds = spark.createDataFrame([(1, 3.0), (4, 1.0)], "id long, weight double")
            got = graph.rank(nodes, edges, iterations=rounds, seeds=seeds, weight=F.col("w"), lose_unweighted=lose)
            assert {r["id"]: r["score"] for r in got.collect()} == pytest.approx(now)
