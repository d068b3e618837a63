"""Queries without SQL over the whole of the smallest tables, against plain versions."""

import hashlib
from collections import Counter, defaultdict

import pytest
from test_graph import distances, near, pairs, rank

from kgloom.operators import graph
from kgloom.plans import catalog
from kgloom.plans.knowledge import valid
from kgloom.sources import kgview as kg

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole(spark):
    ns = [r["id"] for r in kg.nodes(spark, SF).select("id").collect()]
    return ns, [tuple(r) for r in valid(spark, SF).select("src", "dst", "confidence").collect()]


def plain_cores(ns, es):
    w = defaultdict(Counter)
    for s, d, _ in es:
        if s != d:
            w[s][d] += 1
            w[d][s] += 1
    deg, left, core, k = {i: sum(w[i].values()) for i in ns}, set(ns), {}, 0
    while left:
        i = min(left, key=lambda x: (deg[x], x))
        k = max(k, deg[i])
        core[i] = k
        left.discard(i)
        for j, m in w[i].items():
            deg[j] -= m
    return core


def plain_betweenness(ns, es):
    out, score = defaultdict(Counter), dict.fromkeys(ns, 0.0)
    for s, d, _ in es:
        if s != d:
            out[s][d] += 1
    for s in ns:
        sigma, dist, order = defaultdict(float, {s: 1.0}), {s: 0}, [s]
        for x in order:
            for y, m in out[x].items():
                if y not in dist:
                    dist[y] = dist[x] + 1
                    order.append(y)
                if dist[y] == dist[x] + 1:
                    sigma[y] += sigma[x] * m
        dep = defaultdict(float)
        for x in reversed(order):
            for y, m in out[x].items():
                if dist[y] == dist[x] + 1:
                    dep[x] += sigma[x] * m / sigma[y] * (1 + dep[y])
            if x != s:
                score[x] += dep[x]
    return {i: v / ((len(ns) - 1) * (len(ns) - 2)) for i, v in score.items()}


def plain_communities(ns, es, core):
    same = near([e for e in es if core[e[0]] == core[e[1]]])
    groups = {i: set(distances(same, i)) for i in ns}
    return {i: min(g) for i, g in groups.items() if len(g) > 1}


def test_whole_graph(spark, whole):
    ns, es = whole
    assert any(s % 10 == 2 and d % 10 == 1 for s, d, _ in es)
    run = lambda name: pairs(catalog.QUERIES[name](spark, SF))
    adj, core = near(es), plain_cores(ns, es)
    assert run("weak_components") == {i: min(distances(adj, i)) for i in ns}
    assert run("core_numbers") == core and len(set(core.values())) > 1
    assert run("communities") == plain_communities(ns, es, core)
    assert run("betweenness") == pytest.approx(plain_betweenness(ns, es), abs=1e-11)


def test_weighted_cores(spark):
    """Peeling one by one by the whole part of the weighted degree."""
    import random

    rng = random.Random(4)
    for n in (2, 6, 25):
        es = [(rng.randrange(n), rng.randrange(n), rng.choice([0.2, 0.5, 1.0, 1.7])) for _ in range(4 * n)]
        left, w, core, level = set(range(n)), defaultdict(float), {}, 0
        for a, b, x in es:
            if a != b:
                w[a, b] += x
                w[b, a] += x
        while left:
            d = {v: int(sum(w[v, u] for u in left if u != v) + 1e-9) for v in left}
            v = min(left, key=lambda v: (d[v], v))
            level = max(level, d[v])
            core[v] = level
            left.remove(v)
        frame = spark.createDataFrame(es, "src long, dst long, weight double")
        assert pairs(graph.cores(spark.range(n), frame, "weight")) == core


def test_consolidation_and_graph_dimension_see_the_whole_graph(spark, whole):
    ns, es = whole
    got = {r["id"]: r["community"] for r in catalog.QUERIES["deep_consolidation"](spark, SF).collect()}
    assert got == dict.fromkeys(ns) | plain_communities(ns, es, plain_cores(ns, es))
    assert any(i % 10 == 1 for i in pairs(catalog.QUERIES["graph_dimension"](spark, SF)))


def test_articles_and_paths_of_all_sources(spark):
    s = {r["id"]: r for r in kg.sources(spark, SF).collect()}
    lines = kg.table(spark, SF, "lineitem").select("l_orderkey", "l_partkey").collect()
    votes, of = defaultdict(Counter), defaultdict(set)
    for order, part in lines:
        votes[order % len(s)][part] += 1
        of[part * 10 + 1].add(order % len(s))
    groups = defaultdict(list)
    for i in sorted(votes):
        groups[min(votes[i], key=lambda c: (-votes[i][c], c))].append(s[i]["content"])
    want = {(c, len(t), hashlib.sha256("\n\n---\n\n".join(t).encode()).hexdigest()) for c, t in groups.items()}
    got = catalog.QUERIES["community_articles"](spark, SF).collect()
    assert {(r["community"], r["sources"], r["digest"]) for r in got} == want and sum(r["sources"] for r in got) == len(s)
    first = lambda i: min((("code" not in s[x]["domains"], s[x]["uri"]) for x in of[i]), default=(0, None))[1]
    names = {r["id"]: r["name"] for r in kg.nodes(spark, SF).collect() if r["id"] % 10 == 1}
    assert pairs(catalog.QUERIES["code_paths"](spark, SF)) == {i: f"src/{n}" if i % 7 == 0 else first(i) for i, n in names.items()}


def test_ranks_of_all_rounds(spark, whole):
    ns, es = whole
    flat, own = dict.fromkeys(ns, 1 / len(ns)), lambda **of: {i: of.get(f"n{i}", 0.0) for i in ns}
    run = lambda name: pairs(catalog.QUERIES[name](spark, SF))
    plain = rank(ns, es, 0.85, 20, flat, lambda e: 1, False)
    assert run("pagerank") == pytest.approx(plain, abs=1e-8)
    assert run("personalised_pagerank") == pytest.approx(rank(ns, es, 0.85, 20, own(n12=1 / 3, n22=1 / 3, n32=1 / 3), lambda e: 1, False), abs=1e-8)
    assert run("trust_rank") == pytest.approx(rank(ns, es, 0.85, 50, own(n12=0.75, n22=0.25), lambda e: e[2], True), abs=1e-8)
    names = {r["id"]: r["name"].lower() for r in kg.nodes(spark, SF).collect()}
    most = max(plain.values())
    got = run("structural_dimension")
    assert got == pytest.approx({i: plain[i] / most * (2 if "red" in names[i] or "widget" in names[i] else 0.1) for i in got}, abs=1e-7)
    roots = [i for i in ns if i % 10 == 5]
    trust = {r["id"]: r["trust"] for r in catalog.QUERIES["deep_consolidation"](spark, SF).collect()}
    assert trust == pytest.approx(rank(ns, es, 0.85, 50, own(**{f"n{i}": 1 / len(roots) for i in roots}), lambda e: e[2], True), abs=1e-8)


def test_closure_at_the_fixed_point(spark):
    rows = kg.table(spark, SF, "part").select("p_partkey", "p_size").collect()
    size, n = {r[0]: r[1] for r in rows}, len(rows)
    p0, on = {i: 0.5 + s / 200 for i, s in size.items()}, defaultdict(list)
    for i in size:
        on[(i * 7 + 3) % n].append(i)
    now = p0
    for _ in range(500):
        left = dict.fromkeys(size, 1.0)
        for t in left:
            for a in on[t]:
                left[t] *= 0.0 if a % 10 == 0 else max(0.0, 1 - now[a] * (1 if a % 10 == 1 else 0.3) * size[a] / 50)
        now = {i: now[i] + 0.8 * (p0[i] * left[i] - now[i]) for i in now}
    assert pairs(catalog.QUERIES["epistemic_closure"](spark, SF)) == pytest.approx(now, abs=1e-5)


def test_long_paths(spark):
    n = 24
    nodes = spark.createDataFrame([(i,) for i in range(n + 2)], "id long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "src long, dst long")
    path = lambda *a: [r[0] for r in graph.shortest_path(edges, *a).collect()]
    assert path(11, 0) == [list(range(11, -1, -1))] and not path(0, n) and not path(0, 11, 6) and path(3, 3) == [[3]]
    got = pairs(graph.betweenness(nodes, edges))
    assert got == pytest.approx({i: i * (n - 1 - i) / ((n + 1) * n) if i < n else 0 for i in range(n + 2)})
