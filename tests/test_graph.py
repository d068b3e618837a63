"""Graph and epistemic operators against plain versions on random graphs: cycles, parallel edges, loops, lone nodes."""

import random
from collections import defaultdict, deque
from math import prod

import pytest
from pyspark.sql import functions as F

from kgloom.operators import epistemic, graph, relational

EDGE = "src long, dst long, weight double, confidence double, rel_type string, synthetic boolean, invalid boolean"


def make(seed, n=14, m=26):
    rng = random.Random(seed)
    return list(range(n)), [(rng.randrange(n - 1), rng.randrange(n - 1), rng.randint(1, 8) / 8, rng.randint(1, 8) / 8, rng.choice(["a", "authored"]), rng.random() < 0.2, False) for _ in range(m)]


@pytest.fixture(params=[1, 2])
def g(request, spark):
    ns, es = make(request.param)
    return ns, es, spark.createDataFrame([(i,) for i in ns], "id long"), spark.createDataFrame(es, EDGE)


def pairs(df):
    return {r[0]: r[1] for r in df.collect()}


def near(es):
    out = defaultdict(set)
    for s, d, *_ in es:
        if s != d:
            out[s].add(d)
            out[d].add(s)
    return out


def distances(adj, start):
    seen, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        for y in adj[x]:
            if y not in seen:
                seen[y] = seen[x] + 1
                queue.append(y)
    return seen


def test_bfs_and_path(spark, g):
    ns, es, _, edges = g
    adj = near(es)
    got = {(r[0], r[1]): r[2] for r in graph.bfs(edges, spark.createDataFrame([(0,), (3,)], "id long"), 3).collect()}
    assert got == {(s, x): d for s in (0, 3) for x, d in distances(adj, s).items() if 0 < d <= 3}
    for end in ns:
        path = [r[0] for r in graph.shortest_path(edges, 0, end).collect()]
        d = distances(adj, 0)
        assert bool(path) == (end in d)
        if path:
            assert len(path[0]) == d[end] + 1 and all(b in adj[a] for a, b in zip(path[0], path[0][1:]))


def rank(ns, es, damping, rounds, tele, weight, lose):
    out = defaultdict(float)
    for e in es:
        out[e[0]] += weight(e)
    has = {e[0] for e in es} if lose else {k for k, v in out.items() if v > 0}
    s = {i: 1 / len(ns) for i in ns}
    for _ in range(rounds):
        mass = sum(s[i] for i in ns if i not in has)
        new = {i: tele[i] * (1 - damping + damping * mass) for i in ns}
        for e in es:
            if out[e[0]] > 0:
                new[e[1]] += damping * s[e[0]] * weight(e) / out[e[0]]
        s = new
    return s


def test_ranks(spark, g):
    ns, es, nodes, edges = g
    flat = {i: 1 / len(ns) for i in ns}
    got = pairs(graph.rank(nodes, edges, iterations=7))
    assert got == pytest.approx(rank(ns, es, 0.85, 7, flat, lambda e: 1, False)) and sum(got.values()) == pytest.approx(1)
    seeds = spark.createDataFrame([(2, 3.0), (5, 1.0)], "id long, weight double")
    tele = {i: {2: 0.75, 5: 0.25}.get(i, 0.0) for i in ns}
    trust = lambda e: e[3] * (0.1 if e[5] else 0.2 if e[4] == "authored" else 1)
    assert pairs(graph.rank(nodes, edges, 0.85, 5, seeds, graph.effective("confidence"), True)) == pytest.approx(rank(ns, es, 0.85, 5, tele, trust, True))


def test_spreading(spark, g):
    _, es, _, edges = g
    best, front = {0: 1.0}, [0]
    while front:
        x = front.pop()
        for s, d, w, _, rel, syn, _ in es:
            v = best[x] * 0.7 * w * (0.1 if syn else 0.2 if rel == "authored" else 1)
            if s == x and v > 0.01 and v > best.get(d, 0):
                best[d] = v
                front.append(d)
    assert pairs(graph.spreading(edges, spark.createDataFrame([(0, 1.0)], "id long, energy double"), 0.7, 0.01, 20)) == pytest.approx(best)


def test_components_and_cores(g):
    ns, es, nodes, edges = g
    adj = near(es)
    assert pairs(graph.membership(nodes, edges)) == {i: min(distances(adj, i)) for i in ns}
    deg = lambda left: {i: sum((s == i and d in left) + (d == i and s in left) for s, d, *_ in es if s != d) for i in left}
    left, core, k = set(ns), {}, 0
    while left:
        d = deg(left)
        k = max(k, min(d.values()))
        for i in [i for i in left if d[i] <= k]:
            core[i] = k
            left.discard(i)
    assert pairs(graph.cores(nodes, edges)) == core
    got = graph.communities(nodes, edges, graph.cores(nodes, edges)).collect()
    same = defaultdict(set)
    for s, d, *_ in es:
        if s != d and core[s] == core[d]:
            same[s].add(d)
            same[d].add(s)
    groups = {i: set(distances(same, i)) for i in ns}
    assert {r[0]: r[1] for r in got} == {i: min(x) for i, x in groups.items() if len(x) > 1}


def test_betweenness(g):
    ns, es, nodes, edges = g
    out, score = defaultdict(lambda: defaultdict(int)), dict.fromkeys(ns, 0.0)
    for s, d, *_ in es:
        if s != d:
            out[s][d] += 1
    for s in ns:
        sigma, dist, order, queue = defaultdict(float, {s: 1.0}), {s: 0}, [], deque([s])
        while queue:
            x = queue.popleft()
            order.append(x)
            for y, m in out[x].items():
                if y not in dist:
                    dist[y] = dist[x] + 1
                    queue.append(y)
                if dist[y] == dist[x] + 1:
                    sigma[y] += sigma[x] * m
        dep = defaultdict(float)
        for x in reversed(order):
            for y, m in out[x].items():
                if dist[y] == dist[x] + 1:
                    dep[x] += sigma[x] * m / sigma[y] * (1 + dep[y])
            if x != s:
                score[x] += dep[x]
    n = len(ns)
    assert pairs(graph.betweenness(nodes, edges)) == pytest.approx({i: v / ((n - 1) * (n - 2)) for i, v in score.items()})


def test_closure(spark):
    rng = random.Random(4)
    p = {i: rng.random() for i in range(12)}
    attacks = [(rng.randrange(12), rng.randrange(12), rng.choice(["contradicts", "contends", "corrects"] if k % 9 == 0 else ["contradicts", "contends"]), rng.random()) for k in range(20)]
    now = dict(p)
    for _ in range(200):
        f = {i: prod(max(0.0 if k == "corrects" else 1 - now[a] * w * (0.3 if k == "contends" else 1), 0) for a, t, k, w in attacks if t == i) for i in p}
        now = {i: now[i] + 0.8 * (p[i] * f[i] - now[i]) for i in p}
    got = pairs(epistemic.closure(spark.createDataFrame(list(p.items()), "id long, p double"), spark.createDataFrame(attacks, "attacker long, target long, kind string, weight double"), epsilon=1e-5))
    assert got == pytest.approx(now, abs=1e-3)


def test_empty_graph(spark):
    nodes, edges = spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([], EDGE)
    assert pairs(graph.rank(nodes, edges, iterations=3)) == pytest.approx({1: 1.0})
    assert pairs(graph.membership(nodes, edges)) == {1: 1} and pairs(graph.cores(nodes, edges)) == {1: 0} and pairs(graph.betweenness(nodes, edges)) == {1: 0.0}
    assert not graph.bfs(edges, nodes, 2).collect()


def test_conflicts_against_all_pairs(spark):
    """Both edges of a pair with one start and relation, other targets and a common time; invalid edges and those of no time are left out."""
    rng = random.Random(2)
    day = lambda k: f"2020-01-{k:02d}"
    es = []
    for k in range(80):
        b = None if rng.random() < 0.1 else rng.randint(1, 20)
        u = None if rng.random() < 0.3 else rng.randint(1, 28)
        es.append((k, rng.randrange(20), rng.randrange(3), rng.choice(["owns", "uses"]), b and day(b), u and day(u), rng.random() < 0.2))
    df = spark.createDataFrame(es, "id long, src long, dst long, rel_type string, b string, u string, invalid boolean")
    df = df.select("id", "src", "dst", "rel_type", "invalid", F.col("b").cast("timestamp_ntz").alias("valid_from"), F.col("u").cast("timestamp_ntz").alias("valid_until"))
    live = [e for e in es if not e[6] and (e[4] is None or e[5] is None or e[4] < e[5])]
    hit = {x[0] for x in live for y in live if x[1] == y[1] and x[3] == y[3] and x[2] != y[2] and (x[4] or "0") < (y[5] or "9") and (y[4] or "0") < (x[5] or "9")}
    assert {r["id"]: r["conflict"] for r in relational.conflicts(df).collect()} == {e[0]: e[0] in hit for e in es} and 0 < len(hit) < len(live)

