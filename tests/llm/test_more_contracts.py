"""The other operators against plain versions: streams, pieces, the ring, chats, licences."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.llm import chat, licenses, ring, transport, unigram, wordpiece
from kgloom.llm.packing import vocabulary

from .test_contracts import ODD, SF, frame

TEXTS = [t for _, t in ODD]


@pytest.fixture(scope="module", params=["small", "odd", "empty"])
def rows(request):
    return {"small": [tuple(r) for r in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()], "odd": ODD, "empty": []}[request.param]


def test_transport(spark, rows):
    def want(i, t):
        data = (t or "").encode()
        p = data + b"\0" * (-len(data) % 64 or 64 * (not data))
        return i, len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])

    media = transport.store(frame(spark, rows))
    out = transport.read(media).collect()
    assert Counter(tuple(r)[:5] for r in out) == Counter(want(i, t) for i, t in rows)
    stored = Counter((r["doc_id"], len(r["media"]), hashlib.sha256(r["media"]).hexdigest()) for r in media.collect())
    assert stored == Counter((r["doc_id"], r["media_bytes"], r["media_sha256"]) for r in out)
    for r in out:
        assert not r["errors"] and r["program"] == 1 and r["media_bytes"] == 188 * r["packets"]
        assert [u["pts"] for u in r["units"]] == [k * 4096 * 90000 // 8000 for k in range(len(r["units"]))]
        assert [u["random_access"] for u in r["units"]] == [k % 4 == 0 for k in range(len(r["units"]))]


def test_transport_finds_damage():
    for n in (0, 1, 150, 151, 152, 153, 155, 160, 176, 180, 335, 336, 4095, 4096, 4097, 70_000):
        p = random.Random(n).randbytes(n)
        s = transport.demux(transport.mux(p))
        assert s.payload == p and not s.errors
    good = transport.mux(bytes(5000))
    assert any("continuity" in e for e in transport.demux(good[: 188 * 5] + good[188 * 6 :]).errors)
    assert any("checksum" in e for e in transport.demux(good[:12] + b"\x55" + good[13:]).errors)
    assert any("sync" in e for e in transport.demux(good[: 188 * 3] + b"\0" + good[188 * 3 + 1 :]).errors)
    assert "length" in transport.demux(good[:-1]).errors


def as_unigram(data: bytes, scores: list[float]) -> bytes:
    """The model with its type set to unigram, in which the library encodes by a Viterbi of its own, and with other scores."""

    def varint(at):
        n = shift = 0
        while True:
            n |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return n, at

    at, out, k = 0, bytearray(data), 0
    while at < len(data):
        tag, at = varint(at)
        n, at = varint(at)
        end = at + n
        if tag in (1 << 3 | 2, 2 << 3 | 2):
            while at < end:
                inner, at = varint(at)
                if tag == 2 << 3 | 2 and inner == 3 << 3:
                    assert data[at] == 2
                    out[at] = 1
                if tag == 1 << 3 | 2 and inner == 2 << 3 | 5:
                    out[at : at + 4] = struct.pack("<f", scores[k])
                if inner & 7 == 0:
                    _, at = varint(at)
                elif inner & 7 == 2:
                    n, at = varint(at)
                    at += n
                else:
                    at += 4 if inner & 7 == 5 else 8
            k += tag == 1 << 3 | 2
        at = end
    assert k == len(scores)
    return bytes(out)


def test_unigram_beside_the_library():
    """Word by word, no encoding of the library's own Viterbi scores better, and nearly all are the same."""
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    pieces = unigram.Pieces(path, most=300)
    sp = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(open(path, "rb").read(), pieces.scores))
    words = {w for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall() for w in t.split()}
    score, same = lambda x: sum(pieces.scores[i] for i in x), 0
    for w in words:
        ids, theirs = np.frombuffer(pieces.encode(w), "<u4").tolist(), sp.encode(w)
        assert ids == theirs or score(ids) >= score(theirs) - 1e-3, w
        same += ids == theirs
    assert same > 0.99 * len(words)


def test_unigram_scores():
    assert unigram.log_probabilities([0.0, -1.5, -2.25]) == [0.0, -1.5, -2.25]
    got = unigram.log_probabilities([0.0, -1e9, -1.0, -2.0, -3.0])
    assert got[2] > got[3] > got[4] == got[1]


def test_unigram_is_near_the_library_in_length():
    """The figure of the README: tokens beside the library's own encoding of the model, which is BPE."""
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    sp, pieces = sentencepiece.SentencePieceProcessor(model_file=path), unigram.Pieces(path)
    texts = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id LIMIT 200").fetchall()]
    assert abs(sum(len(pieces.encode(t)) // 4 for t in texts) / sum(len(sp.encode(t)) for t in texts) - 1) < 0.02
    assert max(map(len, pieces.memo)) <= 64


def test_unigram_gives_texts_back():
    pieces, rng = unigram.Pieces(vocabulary("piece_bpe_32k.model"), most=300), random.Random(4)
    for _ in range(2_000):
        t = "".join(rng.choice(["the", "a", "ing", "é", " ", "  ", "\n", "中", "🙂", "x", "#", "1", "qu", "\t", "\x01"]) for _ in range(rng.randint(0, 40)))
        assert pieces.decode(pieces.encode(t)) == t
        # Cut into parts or as one, the best total is the same.
        whole = pieces.solve("▁" + t.replace(" ", "▁")) if t else b""
        assert len(whole) == len(pieces.encode(t)) or pieces.decode(whole) == t


def test_unigram_frames(spark, rows):
    docs = frame(spark, rows)
    out = unigram.digests(docs).collect()
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in out) == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert all(r["exact"] for r in out)
    back = unigram.decode(unigram.encode(docs)).collect()
    assert Counter(map(tuple, back)) == Counter((i, t or "") for i, t in rows)


def test_unigram_small_vocabulary_is_best():
    """All segmentations of short strings, for a vocabulary with overlapping pieces."""
    import ahocorasick

    p = unigram.Pieces(vocabulary("piece_bpe_32k.model"))
    scores = {"a": -5.0, "b": -5.0, "ab": -6.0, "ba": -7.0, "aba": -9.0, "bb": -12.0, "cab": -1.0}
    p.auto, p.singles, p.unknown = ahocorasick.Automaton(), {"a", "b"}, -30.0
    for k, (w, s) in enumerate(scores.items()):
        p.auto.add_word(w, (k + 1000, len(w), s))
    p.auto.make_automaton()

    def best(t):
        if not t:
            return 0.0
        return max([scores[w] + best(t[len(w) :]) for w in scores if t.startswith(w)] + [p.unknown + best(t[1:])] * (t[0] not in p.singles))

    names = {k + 1000: s for k, s in enumerate(scores.values())}
    rng = random.Random(8)
    for _ in range(300):
        t = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        ids = np.frombuffer(p.solve(t), "<u4").tolist()
        assert sum(names.get(i, p.unknown) for i in ids) == best(t), t


def test_longest_match(spark, rows):
    match = wordpiece.LongestMatch.at(vocabulary("piece_bpe_32k.model"))

    def greedy(pieces, word, longest):
        at = n = 0
        while at < len(word):
            end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in pieces), None)
            n += 1 if end else len(word[at].encode())
            at = end or at + 1
        return n

    want = Counter()
    for i, t in rows:
        ns = [greedy(match.pieces, "▁" + w, match.longest) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        want[i, len(ns), sum(ns), max(ns, default=0)] += 1
    assert Counter(map(tuple, wordpiece.token_counts(frame(spark, rows)).collect())) == want
    rng = random.Random(6)
    for _ in range(300):
        pieces = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        small = wordpiece.LongestMatch(list(pieces), mark="")
        for _ in range(20):
            w = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 15)))
            assert small.count(w) == greedy(pieces, w, 5), (pieces, w)


def filled(spark, docs, shards):
    """Sequential: rows by point and rank, each to the first shard clockwise with room."""
    nodes = sorted((r["stop"], r["arc"], list(r["shards"])) for r in ring.arcs(spark, shards, ring.VIRTUAL, ring.POINTS).collect())
    text = F.coalesce("text", F.lit(""))
    named = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("size", "text_crc32")).otherwise(F.xxhash64("doc_id"))
    keyed = [tuple(r) for r in named.select(ring.point(key), F.xxhash64(F.lit("rank"), "doc_id", "size", "text_crc32"), "doc_id", "size", "text_crc32").collect()]
    n, used, out = len(keyed), [0] * shards, Counter()
    stops = [s for s, _, _ in nodes]
    arc = lambda p: next((k for k, s in enumerate(stops) if s >= p), 0)
    # The first arc also has the points after the last node; these come first in it.
    for _, _, p, _, i, size, crc in sorted(((arc(p), p <= stops[0], p, h, i, size, crc) for p, h, i, size, crc in keyed), key=lambda x: (x[0], x[1], x[2], x[3], x[4] is not None, x[4] or 0, x[5], x[6])):
        shard = next(s for s in nodes[arc(p)][2] if used[s] < n // shards + (s < n % shards))
        out[i, size, crc, shard, used[shard]] += 1
        used[shard] += 1
    return out


def test_ring(spark, rows):
    docs = frame(spark, rows)
    for shards in (16, 3):
        out = ring.place(docs, shards).collect()
        assert Counter(tuple(r)[:5] for r in out) == filled(spark, docs, shards)
        slots = defaultdict(list)
        for r in out:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        sizes = [len(slots[s]) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1


def test_ring_moves_little(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    a, b = (ring.place(docs, n).select("doc_id", F.col("shard").alias(f"s{n}")) for n in (16, 17))
    moved = a.join(b, "doc_id").filter("s16 <> s17").count() / 20_000
    assert moved < 0.12, moved  # 5.9 % is the least possible; dealing anew by remainder would move 94 %


TURNS = [
    (1, 0, "system", "be <s>[SYS]"), (1, 1, "user", "a\\1b\\0c\\"), (1, 2, "user", "[TURN][/INST]</s>"), (1, 3, "assistant", "é🙂</s>[INST] ok [/INST]"), (1, 4, "assistant", ""),
    (2, 0, "tool", "x[/ROLE]"), (2, 1, "[ROLE]x</s>", None), (2, 2, "assistant", "<"), (2, 2, "assistant", "<"), (3, None, None, None), (None, 0, "user", "hi"), (None, 1, "assistant", "[INST"), (4, 5, "assistant", "z\n"), (4, 2, "assistant", "y"), (5, 0, "user", ""),
]


@pytest.mark.parametrize("turns", [TURNS, []])
def test_chat(spark, turns):
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("formatted", F.lit(2))
    held = defaultdict(list)
    for c, k, r, t in turns:
        held[c].append((k is not None, k or 0, r or "", t or ""))
    out = chat.chat(df)
    back = {r["conv_id"]: r for r in chat.digests(out).collect()}
    whole = {r["conv_id"]: r for r in out.collect()}
    assert set(back) == set(held)
    for c, ts in held.items():
        ts.sort()
        said = "".join(t for _, _, r, t in ts if r == "assistant")
        want = (len(ts), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in ts).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(whole[c]["formatted"]))
        assert tuple(back[c])[1:] == want
        assert len(whole[c]["loss_spans"]) == sum(r == "assistant" for _, _, r, _ in ts)
    if turns:
        assert whole[4]["formatted"] == "<s>[/INST]y[TURN]z\n</s>"
        assert whole[3]["formatted"] == "<s>[ROLE][/ROLE]</s>"


def test_chat_random_texts(spark):
    rng = random.Random(9)
    bits = ["<", "s", ">", "/", "[", "INST", "]", "TURN", "\\", "0", "1", "</s>", "[/INST]", "ROLE", "\n", "<s>"]
    turns = [(c, k, rng.choice(["user", "assistant", "system", "x", "[ROLE]"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for c in range(400) for k in range(4)]
    out = chat.digests(chat.chat(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()
    for r in out:
        own = [t for t in turns if t[0] == r["conv_id"]]
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x}\n{t}\n" for _, _, x, t in own).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256("".join(t for _, _, x, t in own if x == "assistant").encode()).hexdigest()


def test_chat_of_very_many_turns(spark):
    """Time in proportion: 100,000 turns of one conversation, with few and many changes of role, beside short ones."""
    n = 100_000
    rows = spark.range(n).selectExpr("id % 2 AS conv_id", "id AS turn", "if(id % 2 = 0 AND id % 6 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    out = {r["conv_id"]: r for r in chat.digests(chat.chat(rows)).collect()}
    for c in (0, 1):
        own = [(k, "user" if k % 6 == 0 else "assistant", f"t{k}") for k in range(c, n, 2)]
        said = "".join(t for _, r, t in own if r == "assistant")
        assert out[c]["n_turns"] == len(own) and out[c]["loss_chars"] == len(said) and out[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert out[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()


def test_licenses(spark, rows):
    known = {k: set(licenses.bigrams_of(v)) for k, v in licenses.TEMPLATES.items()}

    def hits(text):
        plain = re.sub(r"[^\w\n]|_", " ", (text or "").lower())
        units = ([(0, plain)] if "\n" in plain else []) + list(enumerate(plain.split("\n"), 1))
        for line, unit in units:
            w = unit.split()
            a = set(zip(w, w[1:]))
            a = {" ".join(x) for x in a}
            score = [(-2 * len(a & b) / (len(a) + len(b)), k) for k, b in known.items()] if a else [(0, "")]
            if -min(score)[0] >= 0.8:
                yield line, min(score)[1], round(-min(score)[0], 6)

    extra = [(100, licenses.TEMPLATES["MIT notice"].upper()), (101, "x\n  Licensed under the APACHE license (version 2.0)!\nall rights\nAll rights reserved.\n"), (102, "Licensed under the\nApache License, Version 2.0.")]
    extra = extra if rows else []
    want = Counter((i, tuple(hits(t))) for i, t in [*rows, *extra])
    out = licenses.scan(frame(spark, [*rows, *extra])).collect()
    assert Counter((r[0], tuple((h["line"], h["license"], h["dice"]) for h in r[1])) for r in out) == want
    if rows:
        by = {r[0]: [h["license"] for h in r[1]] for r in out}
        assert by[100] == ["MIT notice"] and by[101] == ["Apache-2.0 phrase", "proprietary phrase"] and by[102] == ["Apache-2.0 phrase"]


def test_license_cues():
    for least in (0.5, 0.8, 0.95):
        share = least / (2 - least)
        known = {k: licenses.bigrams_of(v) for k, v in licenses.TEMPLATES.items()}
        found = licenses.cues(known, share)
        for bs in known.values():
            assert sum(not set(b.split()) & set(found) for b in bs) < share * len(bs)
        assert least < 0.8 or len(found) < 50


def test_changed_license_in_a_longer_text(spark):
    """The standard MIT and BSD texts with their copyright lines, other names and comment marks, after and before other lines."""
    import textwrap

    tail = "\n".join(f"Row {k} of the list has {k * k} things." for k in range(90))
    rows = []
    for i, (name, old, new) in enumerate([("MIT", "AUTHORS OR COPYRIGHT HOLDERS", "REGENTS"), ("BSD-3-Clause", "the copyright holder nor", "the Example University nor"), ("Apache-2.0 notice", "this file", "these files"), ("ISC", "fee is", "charge is")]):
        text = "\n".join(f" * {x}" for x in textwrap.wrap(licenses.TEMPLATES[name].replace(old, new), 79, break_long_words=False))
        rows.append((i, f"The Example Tool\n/*\n * Copyright (c) 2020 Jo Doe\n *\n{text}\n */\n{tail}"))
    out = {r[0]: r[1] for r in licenses.scan(frame(spark, rows)).collect()}
    assert [[h["license"] for h in out[i]] for i in range(4)] == [["MIT"], ["BSD-3-Clause"], ["Apache-2.0 notice"], ["ISC"]]
    assert all(h["line"] <= 6 and h["last"] > 8 for hits in out.values() for h in hits)


def test_wrapped_license_in_a_longer_text(spark):
    import textwrap

    some = "The quick brown fox of the north jumps over the lazy dog.\nIt is used to go to the river.\n\n"
    tail = "\n".join(f"Row {k} of the list has {k * k} things." for k in range(90))
    rows, want = [], {}
    for i, (name, t) in enumerate(sorted(licenses.TEMPLATES.items())):
        wrapped = textwrap.wrap(t, 40, break_long_words=False)
        if len(wrapped) > 1:
            rows.append((i, some + "\n".join(f"# {x}" for x in wrapped) + "\n\n" + tail))
            want[i] = [(4, 3 + len(wrapped), name, 1.0)]
    two = "\n".join(textwrap.wrap(licenses.TEMPLATES["GPL-3.0 notice"], 60, break_long_words=False))
    rows.append((100, f"{some}{two}\n\n{some}{two}\n{some}{tail}"))
    n = two.count("\n")
    want[100] = [(4, 4 + n, "GPL-3.0 notice", 1.0), (9 + n, 9 + 2 * n, "GPL-3.0 notice", 1.0)]
    rows += [(101, some * 3), (102, some + "no licence at all")]
    want |= {101: [], 102: []}
    out = licenses.scan(frame(spark, rows)).collect()
    assert {r[0]: [(h["line"], h["last"], h["license"], h["dice"]) for h in r[1]] for r in out} == want
