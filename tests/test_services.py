"""Transforms, hooks, sinks, code, the kept change table, blocked vector pairs, context: beside plain versions on small rows."""

import json
import random
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom import api
from kgloom.operators import memory, relational, resolve, services
from kgloom.sources import code, sinks
from kgloom.streaming import services as outside
from kgloom.streaming import sync


def test_piped(spark):
    program = "import json,sys,time; x=json.load(sys.stdin); time.sleep(9*x.get('wait',0)); print('no') if x.get('bad') else print(json.dumps({'twice': 2*x['n']})); sys.exit(x.get('code', 0))"
    rows = [(1, '{"n": 4}'), (2, '{"n": 1, "bad": 1}'), (3, '{"n": 1, "code": 3}'), (4, '{"n": 1, "wait": 1}'), (5, None)]
    out = {r["id"]: (r["output"], r["error"]) for r in outside.piped(spark.createDataFrame(rows, "id long, body string"), [sys.executable, "-c", program], "id", "body", 3).collect()}
    assert json.loads(out[1][0]) == {"twice": 8} and out[1][1] is None
    assert out[2] == (None, "no JSON") and out[3][1].startswith("exit code 3") and out[4][1].startswith("timed out") and out[5][1].startswith("exit code 1")
    assert outside.piped(spark.createDataFrame(rows[:1], "id long, body string"), ["/no/such/program"], "id", "body").first()["error"].startswith("not started")


def test_hooks():
    def fails(payload):
        raise ValueError("down")

    h = outside.Hooks([
        outside.Hook("a", "pre_search", lambda p: {"boost_terms": [p["query"]], "filter": 1}), outside.Hook("b", "pre_search", lambda p: {"boost_terms": ["b"], "filter": 2}, adapter="x"),
        outside.Hook("c", "pre_search", fails), outside.Hook("d", "post_search", fails, fail_open=False),
    ])
    assert h.fire("pre_search", {"query": "q"}) == {"boost_terms": ["q"], "filter": 1}
    assert h.fire("pre_search", {"query": "q"}, "x") == {"boost_terms": ["q", "b"], "filter": 2}
    assert [n for n, _ in h.failed] == ["c", "c"] and h.fire("pre_ingest", {}) == {}
    with pytest.raises(RuntimeError, match="hook d failed"):
        h.fire("post_search", {})
    with pytest.raises(ValueError):
        outside.Hook("e", "sometime", fails)
    ask = outside.first_that_answers([("one", fails), ("two", str.upper)])
    assert ask("x") == ("two", "X")
    with pytest.raises(RuntimeError, match="one: down"):
        outside.first_that_answers([("one", fails)])("x")


def test_embedded_and_prompts(spark):
    seen = lambda texts: [[float(len(t)), float(len(texts)), 9.0] for t in texts]
    rows = spark.createDataFrame([(1, 10, "a"), (2, 10, None), (3, 20, "ccc")], "id long, doc long, text string").coalesce(1)
    assert {r["id"]: r["embedding"] for r in outside.embedded(rows, seen, 2, most=2).collect()} == {1: [1.0, 2.0], 2: [0.0, 2.0], 3: [3.0, 1.0]}
    assert {r["id"]: r["embedding"] for r in outside.embedded(rows, seen, 2, together="doc").collect()} == {1: [1.0, 2.0], 2: [0.0, 2.0], 3: [3.0, 1.0]}
    items = spark.createDataFrame([(1, "f", None, "x" * 20)], "id long, name string, path string, code string")
    assert outside.prompts(items, "{name} in {path}: {code}", 5).first()["prompt"] == "f in unknown: xxxxx\n... (truncated)"


def test_sync_goes_on_after_a_restart(spark, tmp_path):
    rng, log, base = random.Random(1), [], str(tmp_path / "base")
    kind = "entity_id long, seq_id long, op string, payload string"
    stream = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    for run in range(3):
        for _ in range(3):
            rows = [(rng.randrange(9), len(log) + k, rng.choice(["upsert", "upsert", "delete"]), f"p{rng.random()}") for k in range(7)]
            log += rows
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        sync.sync(spark, stream(), base, merge_every=4)
        last = {}
        for e, s, op, p in log:
            last[e] = (s, op, p)
        got = {r["entity_id"]: (r["seq_id"], r["op"], r["payload"]) for r in sync.live(sync.synced(spark, base)).collect()}
        assert got == {e: x for e, x in last.items() if x[1] != "delete"}, run
    assert sync._versions(spark, f"{base}/merged")


def test_triggered_over_hours(spark):
    rng, rows, t = random.Random(2), [], 1_704_067_200
    for k in range(300):
        t += rng.choice([1, 60, 900, 4_000])
        rows.append((rng.choice("ab"), k, t, float(rng.randrange(60))))
    df = spark.createDataFrame(rows, "topic string, id long, s long, delta double").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    got = {r["id"]: r["fires"] for r in sync.triggered(df, 3_600, 55.0, 2_000.0).collect()}
    total, last = Counter(), {}
    for topic, k, s, d in rows:
        total[topic] += d
        assert got[k] == (s - last.get(topic, s) >= 3_600 or d > 55 or total[topic] > 2_000), k
        last[topic] = s


def test_sinks(spark, tmp_path):
    df = lambda *rows: spark.createDataFrame(rows, "id long, part string, x long")
    at, other = str(tmp_path / "t"), str(tmp_path / "p")
    sinks.appended(df((1, "a", 1), (2, "a", 2), (2, "a", 2)), at, "id")
    sinks.appended(df((2, "a", 9), (3, "b", 3)), at, "id")
    assert sorted((r["id"], r["x"]) for r in spark.read.parquet(at).collect()) == [(1, 1), (2, 2), (3, 3)]
    sinks.replaced(df((1, "a", 1), (2, "b", 2)), other, "part")
    sinks.replaced(df((3, "b", 3)), other, "part")
    assert sorted((r["id"], r["part"]) for r in spark.read.parquet(other).collect()) == [(1, "a"), (3, "b")]
    counted, seen = sinks.counted(df((1, "a", None), (2, "b", 2)), "run", ["x"])
    assert counted.count() == 2 and seen.get == {"rows": 2, "x_null": 1}
    assert sinks.exposition("kg", {"rows": 2}) == "# TYPE kg_rows gauge\nkg_rows 2\n"
    m = spark.createDataFrame([("b", '{"entity_types": [{"name": "person", "label": "B"}]}'), ("a", '{"entity_types": [{"name": "person", "label": "A"}, {"name": "place"}], "views": [{"name": "v"}]}'), ("c", "{}")], "path string, text string")
    got = {(r["kind"], r["name"]): json.loads(r["properties"]).get("label") for r in sinks.ontology(spark, m).collect()}
    assert got == {("entity_types", "person"): "B", ("entity_types", "place"): None, ("views", "v"): None}
    stored = spark.createDataFrame([("limit", "20"), ("odd", "1")], "key string, value string")
    assert sinks.settings({"limit": 10, "mode": "results"}, stored) == {"limit": 20, "mode": "results"}


def test_code_of_other_languages():
    java = "import java.util.List;\npublic class A extends B implements C {\n  enum E { X }\n}\n"
    assert [x[:3] for x in code.extract(java, "java", "f")[0]] == [("A", "class", 2), ("E", "enum", 3)]
    assert set(code.extract(java, "java", "f")[1]) == {("f", "java.util.List", "imports"), ("A", "B", "extends"), ("A", "C", "implements")}
    ts = "import x from './y'\nexport interface I { a: string }\nexport async function go() { stop() }\nfunction stop() {}\nexport type T = string\n"
    assert [x[:2] for x in code.extract(ts, "typescript", "f")[0]] == [("I", "interface"), ("go", "function"), ("stop", "function"), ("T", "type")]
    assert ("go", "stop", "calls") in code.extract(ts, "typescript", "f")[1] and ("f", "./y", "imports") in code.extract(ts, "typescript", "f")[1]
    c = "#include <stdio.h>\n#define N 3\nstatic int add(int a, int b) {\n  return a + b;\n}\nstruct P {\n};\n"
    assert [x[:2] for x in code.extract(c, "c", "f")[0]] == [("N", "macro"), ("add", "function"), ("P", "struct")]
    assert code.extract("def f(", "python") == ([], []) and code.extract("x", "cobol") == ([], []) and code.extract("", "go") == ([], [])
    one, two = (code.extract(f"def f():\n{pad}return 1\n", "python")[0][0][3] for pad in ("  ", "        "))
    assert one == two  # the hash is of the syntax, not of blanks


def test_blocked_pairs_find_nearly_all(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))
    x[150:] = x[:150] + rng.normal(scale=0.35, size=(150, 16))
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)] + [(1000, None), (1001, [])], "id long, embedding array<double>")
    exact = {(r[0], r[1]) for r in relational.close_pairs(df, df, 0.15).collect()}
    blocked = {(r[0], r[1]) for r in relational.close_pairs(df, df, 0.15, recall=0.95, bits=6).collect()}
    assert blocked <= exact and len(exact) > 400 and len(blocked) >= 0.9 * len(exact)


def test_context_dedup_in_order(spark):
    rng = np.random.default_rng(6)
    rows = []
    for q in range(4):
        for k in range(20):
            v = [float(v) for v in rng.normal(size=3)]
            rows.append((q, k, float(rng.integers(5)), None if k % 7 == 0 else v[:2] if k % 5 == 0 else v))
    got = Counter((r["q"], r["id"]) for r in memory.deduplicated(spark.createDataFrame(rows, "q long, id long, score double, embedding array<double>"), "q", 0.7).collect())
    want = Counter()
    for q in range(4):
        kept = []
        for _, i, s, e in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1])):
            if e is None or not any(o is not None and len(o) == len(e) and np.dot(o, e) / np.linalg.norm(o) / np.linalg.norm(e) > 0.7 for o in kept):
                kept.append(e)
                want[q, i] += 1
    assert got == want


def test_complete_linkage_by_chains(spark):
    rng = np.random.default_rng(7)
    for n in (1, 5, 24):
        x = rng.normal(size=(n, 3))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        sim = x @ x.T
        groups = [[k] for k in range(n)]
        while len(groups) > 1:
            s, a, b = max((min(sim[i, j] for i in groups[a] for j in groups[b]), a, b) for a in range(len(groups)) for b in range(a))
            if s < 0.4:
                break
            groups[b] += groups.pop(a)
        df = spark.createDataFrame([(1, k, [float(v) for v in row]) for k, row in enumerate(x)], "source_id long, id long, embedding array<double>")
        got = {}
        for r in resolve.clustered(df, 0.4, least=1).collect():
            got.setdefault(r["cluster"], set()).add(r["id"])
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups))


def test_overlapping_spans(spark):
    rng, day = random.Random(8), 86_400
    rows = []
    for k in range(120):
        b = rng.choice([None, rng.randrange(6 * day)])
        e = rng.choice([None, (b or 0) + 1 + rng.randrange(2 * day)])
        rows.append((k, rng.choice("ab"), b, e))
    df = spark.createDataFrame(rows, "id long, k string, b long, e long").select("id", "k", F.timestamp_seconds("b").cast("timestamp_ntz").alias("begin"), F.timestamp_seconds("e").cast("timestamp_ntz").alias("end"))
    inf = float("inf")
    span = {k: (g, -inf if b is None else b, inf if e is None else e) for k, g, b, e in rows}
    want = {k: sum(j != k and span[j][0] == g and span[j][1] < e and b < span[j][2] for j in span) for k, (g, b, e) in span.items()}
    assert {r["id"]: r["n"] for r in relational.overlapping(df, ["k"]).collect()} == want


def test_projection_beside_a_plain_version(spark):
    rng, ledger, spans = random.Random(9), [], []
    for s in range(5):
        at = canon = 0
        for _ in range(12):
            skip, m, c = rng.randrange(0, 9), rng.randrange(1, 9), rng.randrange(1, 9)
            at, canon = at + skip, canon + skip
            ledger.append((s, canon, canon + c, at, at + m))
            at, canon = at + m, canon + c
        spans += [(s, a := rng.randrange(at), a + rng.randrange(1, 12)) for _ in range(30)] + [(s, e[3], e[4]) for e in ledger if e[0] == s]
    e = spark.createDataFrame(ledger, "source_id long, canonical_start long, canonical_end long, mutated_start long, mutated_end long")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in relational.projected(spark.createDataFrame(spans, "source_id long, start long, end long"), e).collect()}
    for s, a, b in spans:
        own = [x[1:] for x in ledger if x[0] == s]
        exact = [x[:2] for x in own if x[2:] == (a, b)]

        def moved(p, side, own=own):
            inside = [x for x in own if x[2] < p < x[3]]
            return inside[0][side] if inside else p + sum((x[1] - x[0]) - (x[3] - x[2]) for x in own if x[3] <= p)

        assert got[s, a, b] == (exact[0] if exact else (moved(a, 0), moved(b, 1))), (s, a, b)


def test_windows_and_tools(spark):
    docs = spark.createDataFrame([(1, ""), (2, "x" * 95), (3, "".join(chr(97 + k % 26) for k in range(437)))], "id long, text string")
    rows = services.coref_windows(docs, 100, 10).collect()
    assert all(len(r["text"]) <= 100 for r in rows)
    whole = {}
    for r in sorted(rows, key=lambda r: (r["id"], r["window"])):
        whole[r["id"]] = whole.get(r["id"], "")[: r["start"]] + r["text"]
    assert whole == {r["id"]: r["text"] for r in docs.collect()}
    assert api.call("get_node", docs, [2]).count() == 1
    with pytest.raises(KeyError):
        api.call("nothing")
    results = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query string, id long, rank int")
    golden = spark.createDataFrame([("q", 2, 1)], "query string, id long, grade int")
    assert {r["metric"]: r["value"] for r in api.evaluated(results, golden).collect()}["mrr"] == 0.5
