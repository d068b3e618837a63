"""Chunking, conversion, predicates, opinions, resolution and the change log on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from kgloom.functions import opinion as O
from kgloom.functions import text as T
from kgloom.operators import chunking, memory, resolve
from kgloom.sources import convert
from kgloom.streaming import sync


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_chunk_spans_and_paths():
    md = "intro é\n\n# A\n\nfirst\n\n## B\n\n" + "word é " * 40 + "\n\nsecond para\n\n### C\n\ntiny\n\n### D\n\nsmall"
    out = chunking.chunk(md, 100, 20)
    raw = md.encode()
    assert [c["heading_path"] for c in out if c["level"] == "section"] == [[], ["A"], ["A", "B"], ["A", "B", "C"], ["A", "B", "D"]]
    for c in out:
        body = c["text"].encode()[c["prefix_len"] :]
        assert raw[c["byte_end"] - len(body) : c["byte_end"]] == body
    paras = [c for c in out if c["level"] == "paragraph"]
    assert len(paras) == 2 and paras[1]["prefix_len"] > 2 and all(out[c["parent"]]["heading_path"] == ["A", "B"] for c in paras)
    assert chunking.chunk("  \n") == [] == chunking.chunk(None)
    merged = chunking.chunk(md, 100, 0, 50)
    assert [c["text"] for c in merged if c["heading_path"] == ["A", "B"] and c["level"] == "section"][-1] == "tiny\n\nsmall"


def test_html(spark):
    page = '<!DOCTYPE html><html><head><title> T &amp; U </title><script>x<y</script></head><body><nav>menu</nav><h1>Head</h1><p>One<br>two</p><div class="cookie-box">accept</div><ul><li>a</li></ul><footer>f</footer></body></html>'
    r = one(spark, convert.strip_html(F.lit(page)), convert.html_title(F.lit(page)), convert.is_html(F.lit(page)), convert.converted(F.lit(page), F.lit("TEXT/HTML; charset=x")), convert.converted(F.lit("x"), F.lit("image/png")))
    assert r[0] == "# Head\n\nOne\ntwo\n\n- a" and r[1] == "T &amp; U" and r[2] and r[3] == r[0] and r[4] is None


def test_tables_and_code():
    assert convert.linearised("a\n| x | y |\n|---|---|\n| 1 | 2 |\n| 3 | |\nb") == "a\nx: 1, y: 2.\nx: 3.\nb"
    assert convert.linearised("| 1 | 2 |") == "Column 1: 1, Column 2: 2." and convert.linearised("a | b") == "a | b"
    md = convert.code_to_markdown("import os\n\ndef f():\n    return 1\n\nclass C:\n    pass\n", "python")
    assert md.startswith("```python\nimport os\n```") and "# function f" in md and "# class C" in md
    assert convert.code_to_markdown("x +", "python").startswith("# Source")
    html = "<div>" + "a" * 50 + "</div><section>" + "b" * 50 + "</section>"
    assert "".join(convert.html_windows(html, 70)) == html and convert.html_windows(html, 70)[1].startswith("<section>")


@pytest.mark.parametrize(("name", "noise"), [("", True), ("x", True), ("AI", False), ("a\nb", True), ("int", True), ("https://x.y", True), ("a@b.co", True), ("1,000", True), ("2024-01-02", True), ("What is it?", True), ("the system", True), ("foo()", True), ("Graph Neural Network", False), ("PageRank", False)])
def test_noise(spark, name, noise):
    assert one(spark, T.noise_name(F.lit(name)))[0] is noise


def test_chunk_predicates(spark):
    c = lambda f, x: one(spark, f(F.lit(x)))[0]
    assert c(T.metadata_only, "**A:** b") and not c(T.metadata_only, "a real sentence with quite enough letters in it to count")
    assert c(T.boilerplate_heavy, "View PDF of it\nBibTeX\nthe rest of the page") and not c(T.boilerplate_heavy, "plain prose")
    assert c(T.author_block, "Authors: A, B") and c(T.author_block, "A a@b.co\nB c@d.co") and not c(T.author_block, "prose")
    assert c(T.bibliography_entry, "[12] A. Author, Title") and c(T.reference_section, "\n".join(["[1] A. Author. A title that is long enough to fill the line of a list of references."] * 6))
    assert c(T.title_only, "# T") and c(T.title_only, "# Title\nshort") and not c(T.title_only, "a line\nanother line that is surely long enough to stand")


def test_opinions_keep_their_sum(spark):
    rng = random.Random(1)
    def op():
        b, d = sorted((rng.random(), rng.random()))
        return (b, d - b, 1 - d, 0.5)
    rows = [(*op(), *op()) for _ in range(50)] + [(1.0, 0.0, 0.0, 0.5, 0.0, 1.0, 0.0, 0.5), (0.0, 0.0, 1.0, 0.5, 0.0, 0.0, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double, g double, h double")
    x, y = O.opinion(*(F.col(c) for c in "abcd")), O.opinion(*(F.col(c) for c in "efgh"))
    df = df.select(x.alias("x"), y.alias("y"))
    x, y = F.col("x"), F.col("y")
    for r in df.select(O.cumulative(x, y), O.cumulative(y, x), O.averaging(x, y), O.discounted(x, F.lit(0.4)), O.dempster_shafer(x, y)).collect():
        for o in r:
            assert o is None or sum(o[:3]) == pytest.approx(1)
        assert tuple(r[0]) == pytest.approx(tuple(r[1]))
    assert df.select(O.dempster_shafer(x, y)).collect()[50][0] is None
    assert tuple(one(spark, O.fused(F.array(O.opinion(1, 0, 0), O.opinion(0, 1, 0))))[0]) == pytest.approx((0.5, 0.5, 0, 0.5))
    assert one(spark, O.checked(0.5, 0.5, 0.5))[0] is None


def test_novelty_and_clusters(spark):
    e = {1: [1.0, 0.0], 2: [0.99, 0.1], 3: [0.0, 1.0], 4: None}
    s = spark.createDataFrame([(7, k, v) for k, v in e.items()], "source_id long, ordinal long, embedding array<double>")
    assert {r["ordinal"] for r in resolve.novel(s, 0.92).collect()} == {1, 3, 4}
    c = spark.createDataFrame([(7, 1, [1.0, 0.0]), (7, 2, [0.99, 0.1]), (7, 3, [0.0, 1.0]), (7, 4, [0.1, 0.99]), (8, 5, [1.0, 1.0])], "source_id long, id long, embedding array<double>")
    assert {r["id"]: r["cluster"] for r in resolve.clustered(c, 0.75).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    m = spark.createDataFrame([(1, "t", [1.0, 0.0]), (2, "t", [0.99, 0.1]), (3, "t", [0.0, 1.0])], "id long, topic string, embedding array<double>")
    assert {r["id"]: r["group"] for r in memory.consolidated(m, 0.85).collect()} == {1: 1, 2: 1, 3: 3}


def test_batches_and_abbreviations(spark):
    b = spark.createDataFrame([(1, k, n) for k, n in enumerate([3, 4, 5, 1, 0, 9])], "g long, o long, tokens long")
    assert {r["o"]: r["batch"] for r in resolve.batches(b, "g", "o", 8, 1).collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 5: 2}
    d = spark.createDataFrame([(1, "Graph Neural Network is GNN here"), (2, "Graph Neural Network alone")], "doc_id long, text string")
    assert [tuple(r) for r in resolve.abbreviations(d).collect()] == [(1, "Graph Neural Network", "GNN")]


def test_changes_apply_in_any_order(spark):
    rng = random.Random(3)
    log = [(k, rng.randrange(6), rng.choice(["upsert", "delete"]), f"v{k}") for k in range(40)]
    want = {e: (s, op, p) for s, e, op, p in log}
    schema = "seq_id long, entity_id long, op string, payload string"
    rng.shuffle(log)
    state = spark.createDataFrame([], schema)
    for k in range(0, 40, 10):
        for _ in range(2):  # a repeated batch changes nothing
            state = sync.applied(state, spark.createDataFrame(log[k : k + 10], schema))
    assert {r["entity_id"]: (r["seq_id"], r["op"], r["payload"]) for r in state.collect()} == want


def test_coref_spans(spark):
    text = "Ada Lovelace wrote. She and she left."
    m = spark.createDataFrame([(1, 1, 0, 12, "Ada Lovelace"), (1, 1, 20, 23, "She"), (1, 1, 28, 31, "she"), (1, 2, 32, 36, "left")], "doc_id long, cluster long, start long, end long, text string")
    out = sorted(tuple(r) for r in chunking.coref_spans(m).collect())
    new = text[:20] + "Ada Lovelace" + text[23:28] + "Ada Lovelace" + text[31:]
    assert [(s, e) for _, s, e, *_ in out] == [(20, 23), (28, 31)] and all(new[a:b] == "Ada Lovelace" for *_, a, b, _ in out)


def test_group_texts_cut_inside_a_separator(spark):
    """The separator shows as far as it fits, though nothing of the chunk after it does."""
    from kgloom.operators import chunking

    texts = ["a" * 6, "b" * 5, "c" * 4]
    df = spark.createDataFrame([(1, k, k, t) for k, t in enumerate(texts)], "source_id long, id long, ordinal long, content string")
    whole = "\n\n---\n\n".join(texts)
    for most in range(1, len(whole) + 2):
        assert [tuple(r) for r in chunking.group_texts(df, "source_id", most).collect()] == [(1, 3, whole[:most])]
