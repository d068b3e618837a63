"""Adapters, spans of private data, mended JSON, names and flags on awkward rows."""

import json

import pytest
from pyspark.sql import functions as F

from kgloom.operators import curate


def test_adapter_tiers(spark):
    adapters = [{"name": "rx", "uri_regex": "[.]md$"}, {"name": "mime", "mime": "text/html"}, {"name": "host", "host": "a.b"}, {"name": "both", "host": "a.b", "mime": "text/html"}]
    rows = [("https://a.b/x", "Text/HTML; charset=x", "both"), ("https://A.b/x", "text/plain", "host"), ("https://c.d/x", "text/html", "mime"), ("https://c.d/x.md", None, "rx"), ("https://c.d/x", None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "uri string, mime string, want string")
    assert all(r[0] == r[1] for r in df.select(curate.adapter_of(F.col("uri"), F.col("mime"), adapters), "want").collect())
    assert df.select(curate.adapter_of(F.col("uri"), F.col("mime"), []).alias("a")).filter("a IS NOT NULL").count() == 0


def test_profiles(spark):
    df = spark.createDataFrame([("code", "x"), ("odd", "m/1"), (None, None)], "t string, u string")
    got = [tuple(r[0]) for r in df.select(curate.profile_of(F.col("t"), F.col("u"), {"m/": "manual"})).collect()]
    assert got == [("code", 2000, 100), ("manual", 1000, 100), ("document", 1500, 200)]


def test_private_spans(spark):
    t = "é a@b.co, 555-123-4567 and 123-45-6789; 4111 1111 1111 1111 a@b.co"
    got = spark.createDataFrame([(t,), (None,), ("",)], "t string").select(curate.private_spans(F.col("t"))).collect()
    spans = [(t[s["start"] : s["end"]], s["kind"], s["confidence"]) for s in got[0][0]]
    assert spans == [("a@b.co", "email", 0.95), ("555-123-4567", "phone", 0.85), ("123-45-6789", "ssn", 0.9), ("4111 1111 1111 1111", "credit_card", 0.8), ("a@b.co", "email", 0.95)]
    assert got[1][0] == got[2][0] == []


@pytest.mark.parametrize("text", ['{"a": [1, {"b": "x\\"y"}], "c": "d\\\\"}', "[]", '{"a": {"b": []}}'])
def test_closed_mends_every_cut_it_can(text):
    assert curate.closed(text) == text
    for k in range(1, len(text)):
        done = curate.closed(text[:k])
        if done is not None:
            json.loads(done)
    assert curate.closed(text[:-1]) is not None
    assert curate.closed(None) is None and curate.closed("}") is None


def test_names_and_flags(spark):
    rows = [("## Overview\nx", "T — Overview"), ("# A b\nx", "A b"), ("One two. Three", "One two."), ("", ""), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [r[0] for r in df.select(curate.named_chunk(F.col("t"), F.lit("T"))).collect()] == [w for _, w in rows]
    flags = spark.createDataFrame([("```\n| a |\n- x\n```",), ("| a |\n1. x e.g. y",)], "t string").select(curate.content_types(F.col("t")).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in flags] == [(True, False, False, False), (False, True, True, True)]


def test_split_moves_only_its_edges(spark):
    nodes = spark.createDataFrame([(1, "a", "t", 5)], "id long, name string, node_type string, mention_count long")
    edges = spark.createDataFrame([(10, 1, 2), (11, 1, 3), (12, 2, 1)], "id long, src long, dst long")
    parts = spark.createDataFrame([(11, 1, 9, "b"), (12, 1, 9, "b")], "edge_id long, old long, new long, name string")
    n, e = curate.split_node(nodes, edges, parts)
    assert sorted(map(tuple, n.collect())) == [(1, "a", "t", 5), (9, "b", "t", 2)]
    assert sorted(map(tuple, e.collect())) == [(10, 1, 2), (11, 9, 3), (12, 2, 9)]


def test_edits_with_nothing_to_do(spark):
    nodes = spark.createDataFrame([(1, "a", "d", 0)], "id long, name string, description string, clearance int")
    none = spark.createDataFrame([], "id long, ord long, note string, name string")
    assert [tuple(r) for r in curate.tombstoned(curate.annotated(curate.corrected(nodes, none.select("id", "name")), none), none).collect()] == [(1, "a", "d", 0)]
