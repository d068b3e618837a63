"""Cutting documents: sections and paragraphs with byte spans, windows, statements, summaries of groups."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADING = re.compile(r"^(#{1,4})\s+(.*)$")


def sections(markdown: str) -> list[tuple[list[str], str]]:
    """(heading path, body), in order; what stands before the first heading has no path."""
    out, path, body = [], [], []
    for line in markdown.split("\n"):
        if m := HEADING.match(line):
            out.append(([h for _, h in path], "\n".join(body)))
            path = [(n, h) for n, h in path if n < len(m[1])] + [(len(m[1]), m[2].strip())]
            body = []
        else:
            body.append(line)
    out.append(([h for _, h in path], "\n".join(body)))
    return [s for s in out if s[1].strip()]


def _joined(parts: list[tuple[list[str], str]], least: int, most: int) -> list[tuple[list[str], str]]:
    """Runs of small sections under one parent as one section of the parent."""
    size, out = (lambda s: len(s.strip().encode())), []
    for path, body in parts:
        small = 0 < size(body) < least and len(path) > 1
        if small and out and out[-1][2] == path[:-1] and size(out[-1][1]) + 2 + size(body) <= most:
            out[-1] = (path[:-1], out[-1][1].strip() + "\n\n" + body.strip(), path[:-1])
        else:
            out.append((path, body, path[:-1] if small else None))
    return [(p, b) for p, b, _ in out]


def _tail(prev: bytes, overlap: int) -> bytes:
    """The end of a paragraph, from a word's start, ``overlap`` bytes at most."""
    at = max(0, len(prev) - overlap)
    while 0 < at < len(prev) and prev[at] & 0xC0 == 0x80:
        at -= 1
    if at:
        m = re.search(rb"\s", prev[at:])
        at += m.end() if m else 0
    return prev[at:]


def chunk(markdown: str | None, most: int = 1500, overlap: int = 200, least: int = 0) -> list[dict]:
    """A chunk for each section, and for each paragraph of sections of more than ``most`` bytes; spans are bytes of the document."""
    if not markdown or not markdown.strip():
        return []
    whole, out, at = markdown.encode(), [], 0
    parts = sections(markdown)
    for path, body in _joined(parts, least, most) if least else parts:
        text = body.strip().encode()
        found = whole.find(text, at)
        begin = found if found >= 0 else at
        at = begin + len(text)
        parent = len(out)
        row = lambda level, text, up, prefix, b, e, path=path: {"ord": len(out), "parent": up, "level": level, "heading_path": path, "text": text.decode(errors="replace"), "prefix_len": prefix, "byte_start": b, "byte_end": e}
        out.append(row("section", text, None, 0, begin, at))
        paras = [p.strip() for p in text.split(b"\n\n") if p.strip()]
        if len(text) <= most or len(paras) < 2:
            continue
        place, prev = begin, b""
        for p in paras:
            hit = whole.find(p, place)
            start = hit if hit >= 0 else place
            tail = _tail(prev, overlap) if prev and overlap else b""
            prefix = len(tail) + 2 if prev and overlap else 0
            out.append(row("paragraph", tail + b"\n\n" + p if prefix else p, parent, prefix, place - len(tail) if prefix else start, start + len(p)))
            place, prev = start + len(p), p
    return out


SCHEMA = "doc_id long, ord int, parent int, level string, heading_path array<string>, text string, prefix_len int, byte_start long, byte_end long"


def chunk_documents(docs: DataFrame, most: int = 1500, overlap: int = 200, least: int = 0) -> DataFrame:
    """Chunks of documents (doc_id, text); the table stays in batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for f in frames:
            yield pd.DataFrame([{"doc_id": i, **c} for i, t in zip(f["doc_id"], f["text"], strict=True) for c in chunk(t, most, overlap, least)], columns=names)

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)


def windows(text: Column, size: int = 8000, overlap: int = 1000) -> Column:
    """Array of (start, text): windows of ``size`` characters, each ``size - overlap`` after the one before, until the end is covered."""
    step = size - overlap
    last = F.greatest(F.length(text) - overlap - 1, F.lit(0))
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("text"))))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.length(s) > 0)


def group_texts(chunks: DataFrame, by: str, most: int = 12_000, least: int = 2) -> DataFrame:
    """by, children, summary: texts of each group of ``least`` chunks or more, joined and cut at ``most`` characters.

    Only as many chunks as can show are gathered: a running length decides which, so that a group of any size is one bounded row.
    """
    sep = "\n\n---\n\n"
    before = F.expr(f"coalesce(sum(length(content) + {len(sep)}) OVER (PARTITION BY {by} ORDER BY ordinal, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    n = chunks.groupBy(by).agg(F.count("*").alias("children")).filter(F.col("children") >= least)
    # Part of the separator before a chunk may show where nothing of the chunk does.
    shown = chunks.withColumn("_b", before).filter(F.col("_b") - len(sep) < most)
    text = shown.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("ordinal", "id", "content"))).alias("x"))
    return n.join(text, by).select(by, "children", F.substring(F.array_join(F.transform("x", lambda c: c["content"]), sep), 1, most).alias("summary"))


def article(texts: Column, number: Column) -> Column:
    """Title, body, summary of a compiled community article."""
    body = F.array_join(texts, "\n\n---\n\n")
    return F.struct(F.concat(F.lit("Community "), number.cast("string"), F.lit(" — Compiled Summary")).alias("title"), body.alias("body"), F.substring(body, 1, 200).alias("summary"))


def statement_context(statements: DataFrame, sources: DataFrame, margin: int = 500) -> DataFrame:
    """source_id, context: the source's text around a group of statements (start, end)."""
    g = statements.groupBy("source_id").agg(F.greatest(F.min("start") - margin, F.lit(0)).alias("b"), (F.max("end") + margin).alias("e"))
    return g.join(sources.select(F.col("id").alias("source_id"), "content"), "source_id").select("source_id", F.substring("content", F.col("b") + 1, F.col("e") - F.col("b")).alias("context"))


def coref_spans(mentions: DataFrame) -> DataFrame:
    """Mentions (doc_id, cluster, start, end, text) of clusters of two or more, each but the first replaced by the first's text, with the spans after replacement."""
    first = mentions.groupBy("doc_id", "cluster").agg(F.min_by("text", "start").alias("new"), F.min("start").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    m = mentions.join(first, ["doc_id", "cluster"]).filter(F.col("start") > F.col("_first"))
    shift = F.expr("coalesce(sum(length(new) - (end - start)) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    return m.withColumn("mutated_start", F.col("start") + shift).withColumn("mutated_end", F.col("mutated_start") + F.length("new")).select("doc_id", "start", "end", "mutated_start", "mutated_end", "new")
