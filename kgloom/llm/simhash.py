"""Operator 10: near-duplicates by SimHash fingerprints at a Hamming distance of ``MOST_BITS`` or less.

Linking goes over an inverted index of byte positions. Two fingerprints that differ in at most 4 bits share at least
``LEAST_SHARED`` = 4 of their 8 positional bytes. The index lists fingerprints under *triples* of positional bytes, not
under single ones, as a list for one byte would hold 1/256 of the corpus: the 20 triples of ``TRIPLES`` are a Turán
system, so that any 4 shared positions contain one of them, and no pair that reaches the guaranteed minimum is missed.
Within a list the shared positional bytes of each pair are tallied, pairs with fewer than 4 are dropped, the others
verified by their differing bits. Of the links in a list only a spanning forest leaves the task: it has the same
components, and at most as many rows as the list has.

Exact copies meet in a pre-aggregation on the fingerprint, so that the index holds distinct fingerprints only. A list
of more than ``MOST_LISTED`` fingerprints is split: two of its members that link share, of the other five bytes, at least
one, so that each is listed anew under the triple and each of these (five rows, lists 256 times shorter). A list that is
still too long is split in the same way by five blocks of the bits not yet fixed. It ends, as a list of distinct
fingerprints with m free bits has 2^m members at most; no link is lost.

Components come from alternating star contraction over checkpointed links; nothing is collected to the driver but
counts.

Defined results: a text without words (null too) has the fingerprint zero and links like any other; equal rows share
fingerprint and component; a row without doc_id has a fingerprint and the component of what it is linked to, null if
no linked row has an id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, on_batches, table

SHINGLE, MOST_BITS, LEAST_SHARED, MOST_LISTED = 4, 4, 4, 4096
#: A key of more rows than this, and than a thousandth of all, is looked up by a broadcast of such keys: at most 1,000.
HOT = 1 << 20
#: Shingles hashed at once, which bounds the memory that a very long text takes.
BLOCK = 1 << 16


def _triples() -> list[tuple[int, int, int]]:
    """Turán's system for 8 positions: classes 0-2, 3-5, 6-7; triples inside a class, or two of a class and one of the next."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    own = [t for g in groups for t in combinations(g, 3)]
    return own + [(a, b, c) for k, g in enumerate(groups) for a, b in combinations(g, 2) for c in groups[(k + 1) % 3]]


TRIPLES = _triples()


def fingerprint(text: str | None) -> int:
    """As an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    n, digest, total = len(words) - SHINGLE + 1, xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        m = min(n, k + BLOCK)
        hashes = np.array([digest(line[a : b - 1], 42) for a, b in zip(ends[k:m], ends[k + SHINGLE : m + SHINGLE], strict=True)], ">u8")
        total += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long), and long columns that are ``carried`` along."""
    names = ("doc_id", "fp", *carried)

    def make(cols: list[list]) -> list[list]:
        ids, texts, *rest = cols
        return [ids, np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64), *rest]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried)
    return on_batches(rows, make, ", ".join(f"{n} long" for n in names), pa.schema([(n, pa.int64()) for n in names]))


def _shared(x: np.ndarray) -> np.ndarray:
    """The tally of equal positional bytes, from the XOR of fingerprints."""
    return (np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def _linked(x: np.ndarray) -> np.ndarray:
    """Positions in ``x`` (XORs of fingerprints) that reach the guaranteed minimum of shared bytes, and verify."""
    at = np.flatnonzero(_shared(x) >= LEAST_SHARED)
    return at[np.bitwise_count(x[at]) <= MOST_BITS]


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the distinct fingerprints ``fps`` of one list as all their links would."""
    out, rest = [], fps
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            f = front.pop()
            if len(got := _linked(rest ^ f)):
                new = rest[got]
                out += [(int(f), int(x)) for x in new]
                front += list(new)
                rest = np.delete(rest, got)
    return out


def _list_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, value, fp), sorted -> links (u, v). A list may go on in the next batch."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    held = np.empty((3, 0), np.int64)

    def links(rows: np.ndarray) -> pa.RecordBatch:
        fps = rows[2].view(np.uint64)
        new = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
        starts = np.flatnonzero(np.r_[True, new]) if len(fps) else np.empty(0, int)
        sizes = np.diff(np.r_[starts, len(fps)])
        u, v = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        at = starts[sizes == 2]  # nearly all lists with a pair; all at once
        got = at[_linked(fps[at] ^ fps[at + 1])]
        u.append(fps[got])
        v.append(fps[got + 1])
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            if pairs := forest(fps[s : s + n]):
                a = np.array(pairs, np.uint64)
                u.append(a[:, 0])
                v.append(a[:, 1])
        u, v = np.concatenate(u).view(np.int64), np.concatenate(v).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], schema=schema)

    for b in batches:
        if not b.num_rows:
            continue
        rows = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns])], axis=1)
        last = np.flatnonzero((rows[:2] == rows[:2, -1:]).all(axis=0))[0]
        held = rows[:, last:]
        yield links(rows[:, :last])
    yield links(held)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(positions: tuple[int, ...]) -> int:
    """The bits of some positional bytes; the first byte is the highest."""
    return sum(255 << (56 - 8 * p) for p in positions)


@cache
def splits(mask: int) -> tuple[int, ...]:
    """``mask`` with each of five blocks of the bits it leaves free: fingerprints within four bits share one. Whole bytes first."""
    free = [1 << k for k in range(64) if not mask >> k & 1]
    cuts = [len(free) * k // (MOST_BITS + 1) for k in range(MOST_BITS + 2)]
    return tuple(mask | sum(free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))


def index(fps: DataFrame) -> DataFrame:
    """(mask, value, fp): the inverted index, 20 rows for each distinct fingerprint. A list: the fingerprints with one value under one mask."""
    masks = F.explode(F.array(*(F.lit(_signed(_mask(t))) for t in TRIPLES)))
    return fps.select(masks.alias("mask"), "fp").select("mask", F.expr("mask & fp").alias("value"), "fp")


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("mask", pa.int64()), ("value", pa.int64()), ("fp", pa.int64())])
    for b in batches:
        masks, fps = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
        for m in np.unique(masks):
            f = fps[masks == m]
            for to in splits(int(m) % (1 << 64)):
                to = np.int64(_signed(to))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), to)), pa.array(f & to), pa.array(f)], schema=schema)


def links(fps: DataFrame, n: int, most_listed: int = MOST_LISTED) -> DataFrame:
    """Links (u, v), u > v, with the components that all pairs of the ``n`` distinct ``fps`` within MOST_BITS have."""
    rows, found, free = index(fps), None, 64 - 8 * 3
    while True:
        hot = None
        if 2 ** min(free, 62) > most_listed and free > MOST_BITS:
            hot = cut(rows.groupBy("mask", "value").count().filter(F.col("count") > most_listed).select("mask", "value"), len(TRIPLES) * n // most_listed)
        more = hot is not None and not hot.isEmpty()
        short = rows.join(hot, ["mask", "value"], "left_anti").select(*rows.columns) if more else rows
        part = short.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp").mapInArrow(_list_links, "u long, v long")
        found = part if found is None else found.unionByName(part)
        if not more:
            return found.distinct()
        # Different triples lead to the same bytes, so that a row may come more than once.
        long = rows.join(hot, ["mask", "value"], "left_semi").select(*rows.columns)
        rows = cut(long.mapInArrow(_split, "mask long, value long, fp long").distinct())
        free -= free // (MOST_BITS + 1)


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (u, v; u > v) but the roots; root: the smallest node it is connected to.

    Alternates large-star and small-star steps until the links stay as they are. Each step takes its minimum by a
    grouped aggregate, so that a node of very many links costs one partial row from each task. ``most``: the links' number at most, if known.
    """
    edges, was = cut(edges, most), None
    while (now := edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()) != was and now[0]:
        was = now
        low = edges.select(F.col("u").alias("node"), F.col("v").alias("m"))
        least = low.groupBy("node").agg(F.min("m").alias("m"))  # of nodes with smaller neighbours
        large = edges.join(least, edges["v"] == least["node"], "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        best = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "node")
        small = large.join(best, large["u"] == best["node"])
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = cut(moved.unionByName(best.select(F.col("node").alias("u"), F.col("m").alias("v"))).distinct(), now[0])
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def looked_up(rows: DataFrame, found: DataFrame, key: str, hot: int = HOT) -> DataFrame:
    """``rows`` with the other columns of ``found``, which has each ``key`` once, with the count ``n`` of its rows.

    Rows of keys with more than ``hot`` rows (and a thousandth of all) aren't brought together: these keys, at most
    1,000, are broadcast.
    """
    total, most = found.agg(F.sum("n"), F.max("n")).first()
    limit = max(hot, (total or 0) // 1000)
    if (most or 0) <= limit:
        return rows.join(found.drop("n"), key)
    few = F.broadcast(found.filter(F.col("n") > limit).drop("n"))
    rest = rows.join(F.broadcast(found.filter(F.col("n") > limit).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(found.filter(F.col("n") <= limit).drop("n"), key))


def _grouped(prints: DataFrame, least: Column, most_listed: int, hot: int) -> DataFrame:
    """fp, n, root, least: each distinct fingerprint with its rows' count, its component and the component's ``least``."""
    distinct = cut(prints.groupBy("fp").agg(F.min(least).alias("least"), F.count("*").alias("n")), prints.count())
    n = distinct.count()
    # A list gives fewer links than it has rows, and there are 20 rows for each fingerprint.
    roots = components(links(distinct.select("fp"), n, most_listed), len(TRIPLES) * n)
    rooted = cut(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.col("n").alias("rows"), F.coalesce("root", "fp").alias("root")), n)
    best = cut(rooted.groupBy("root").agg(F.min("least").alias("least"), F.count("*").alias("n")), n)
    return looked_up(rooted.drop("least"), best, "root", hot).withColumnRenamed("rows", "n")


def near_duplicates(docs: DataFrame, most_listed: int = MOST_LISTED, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row for each row of ``docs``."""
    n = docs.count()
    prints = cut(fingerprints(docs), n, dealt=True)
    of_fp = _grouped(prints, F.col("doc_id"), most_listed, hot)
    of_fp = cut(of_fp.select("fp", "n", F.col("least").alias("component_id")), n)
    return looked_up(prints, of_fp, "fp", hot).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, most_listed: int = MOST_LISTED) -> DataFrame:
    """``docs`` without near-duplicates: of each component one row stays, whatever its id.

    It is the one with the smallest doc_id, rows without one last, and of these the one with the smallest checksum (of all
    columns, 128 bits); so the choice doesn't hang on the order of rows. Of rows equal in all columns one stays.
    """
    names = docs.columns
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in names if c != "text")))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.xxhash64("text", row).alias("_a"), F.xxhash64(F.lit("b"), row, "text").alias("_b"))
    n = docs.count()
    prints = cut(fingerprints(keyed.select("_row.doc_id", "_row.text", "_a", "_b"), "_a", "_b"), n, dealt=True)
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_a", "_b")
    best = _grouped(prints, least, most_listed, HOT).groupBy("root").agg(F.min("least").alias("least"))
    kept = cut(best.select(F.col("least._a").alias("_a"), F.col("least._b").alias("_b")), n)
    again = prints.join(kept, ["_a", "_b"]).groupBy("_a", "_b").agg(F.count("*").alias("n")).filter("n > 1")
    if not again.isEmpty():  # equal rows: each task keeps one of its own before they meet
        keyed = keyed.dropDuplicates(["_a", "_b"])
    return keyed.join(kept, ["_a", "_b"], "left_semi").select(*(F.col("_row").getField(c).alias(c) for c in names))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
