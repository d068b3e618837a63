"""Operator 7: best-two-fit packing of tokenised documents into sequences of ``LENGTH`` tokens.

``pieces`` tokenises (one Arrow pass; whole texts) and cuts documents of more than LENGTH tokens. ``place`` deals the
pieces evenly to groups of about ``GROUP_TOKENS`` tokens or ``GROUP_ROWS`` rows, whichever makes more groups, and packs each
by best-two-fit, so that no task holds more than a bounded number of rows, whatever documents look like. A group leaves a
sequence or so unfilled; the pieces of the unfilled sequences of all groups are dealt and packed anew, as long as they are
few enough for fewer groups, so that the whole table has about as many unfilled sequences as one group has. Only the
pieces' figures are shuffled. The number of groups follows the totals.

Defined results: a null or empty text is the end token alone; equal rows are packed each for itself; a null doc_id is
carried along; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices, table

LENGTH, END, GROUP_TOKENS, GROUP_ROWS = 4096, 1, 4 << 20, 50_000
#: A sequence with fewer tokens is unfilled: its pieces are packed anew beside those of other groups.
FILLED = LENGTH - LENGTH // 64
#: Characters of a word that the memo keeps; longer ones are rare and would take much memory.
KEPT_CHARS = 64


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Characters whose classes are the same here and in the tokenizer's own expression (a test goes through all of them).
_L, _N = "a-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾"
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\t\n\r\x20{_L}{_N}]+")
_OTHER = re.compile("[^\t\n\r\x20-\x7e¡-įı-ſ]")


#: Stands for a word's end in ``tiktoken``'s bytes. Texts with this character don't come there.
_END_OF_WORD = b"\0"


def _bytes_of_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones as they are, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def merge_ranks(vocab: dict[str, int]) -> dict[bytes, int]:
    """Byte-pair ranks (ids) of a vocabulary of word-end BPE whose ids go by the order of merges."""
    of = _bytes_of_letters()
    spelled = {w: i for w, i in vocab.items() if all(c in of for c in w.removesuffix("</w>"))}
    return {bytes(of[c] for c in w.removesuffix("</w>")) + _END_OF_WORD * w.endswith("</w>"): i for w, i in spelled.items() if w.removesuffix("</w>") != chr(256)}


class _Words(dict):
    """Ids of words, as bytes. A word that isn't there is taken over from the elder memo, or encoded."""

    def __init__(self, piece, elder: dict[str, bytes]):
        self.piece, self.elder = piece, elder

    def __missing__(self, word: str) -> bytes:
        out = self.elder.get(word) or array("I", self.piece(word.encode() + _END_OF_WORD)).tobytes()
        if len(word) <= KEPT_CHARS:
            self[word] = out
        return out


class WordTokenizer:
    """The ids that ``tokenizers`` gives for a vocabulary of word-end BPE, with a memo of words.

    Such a vocabulary never merges over the bounds of words, so the ids of a text are those of its words. Texts of
    Latin letters are taken apart here, and a word that isn't in the memo goes to the byte-pair merging of ``tiktoken``; any other
    text goes to ``tokenizers`` whole. The two merge alike if ids go by the order of merges and each entry of the vocabulary
    comes out as itself (a test checks this): two neighbours that make up an entry are then always the pair it is merged from.
    At ``most`` words the memo becomes the elder one, from which words that come again are taken over; so it forgets
    rare words; words of more than ``KEPT_CHARS`` characters aren't kept. So its memory is bounded in bytes, and no
    result changes.
    """

    held: dict[str, WordTokenizer] = {}

    def __init__(self, path: str, most: int = 50_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.of, self.most = Tokenizer.from_file(path), most
        special = {t.content for t in self.of.get_added_tokens_decoder().values()}
        ranks = merge_ranks({w: i for w, i in self.of.get_vocab().items() if w not in special})
        ranks[_END_OF_WORD] = max(ranks.values()) + 1  # a single byte needs a rank; words never end in it
        self.memo = _Words(tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece, {})

    @classmethod
    def at(cls, path: str) -> WordTokenizer:
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        out = []
        for t in texts:
            if "<|" in t or _OTHER.search(t):
                out.append(np.array(self.of.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            if len(self.memo) > self.most:
                self.memo.elder = {}
                self.memo = _Words(self.memo.piece, self.memo)
            out.append(b"".join(map(self.memo.__getitem__, _WORD.findall(t.lower()))))
        return out


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and ids (little-endian 32-bit numbers) if asked for."""
    path = path or vocabulary("word_bpe_49k.json")
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = WordTokenizer.at(path), END.to_bytes(4, "little")
        for batch in batches:
            for part in slices(batch, 1 << 19):
                ids, texts = (c.to_pylist() for c in part.columns)
                rows = []
                for i, data in zip(ids, tok.encode([t or "" for t in texts]), strict=True):
                    data += end
                    for k, at in enumerate(range(0, len(data), 4 * LENGTH)):
                        one = data[at : at + 4 * LENGTH]
                        rows.append((i, k, at // 4, len(one) // 4, zlib.crc32(one), one)[: len(kinds)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)  # noqa: B905

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES + ", ids binary" * with_ids)


class _Stock:
    """Unpacked lengths: how many of each, and the distinct ones in order."""

    def __init__(self, lengths: list[int]):
        self.count: dict[int, int] = defaultdict(int)
        for n in lengths:
            self.count[n] += 1
        self.sizes = sorted(self.count)

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            del self.sizes[bisect_right(self.sizes, n) - 1]

    def give(self, n: int) -> None:
        if not self.count[n]:
            self.sizes.insert(bisect_right(self.sizes, n), n)
        self.count[n] += 1

    def largest(self, most: int) -> int:
        """The largest length up to ``most``; 0 if there is none."""
        k = bisect_right(self.sizes, most)
        return self.sizes[k - 1] if k else 0

    def best_two(self, most: int) -> tuple[int, int] | None:
        """The two lengths with the largest sum up to ``most``."""
        sizes, best, found = self.sizes, 0, None
        low, high = 0, bisect_right(sizes, most) - 1
        while low <= high:
            total = sizes[low] + sizes[high]
            if total > most or (low == high and self.count[sizes[low]] < 2):
                high -= 1
                continue
            if total > best:
                best, found = total, (sizes[low], sizes[high])
                if best == most:
                    break
            low += 1
        return found


def best_two_fit(lengths: list[int], room: int = LENGTH) -> list[list[int]]:
    """Bins of lengths. A bin is filled greedily, largest that fits first. While it has a gap, its smallest document
    gives way to the two unpacked ones that fit the gap it leaves most tightly, if they fill more of it."""
    stock, bins = _Stock(lengths), []
    while stock.sizes:
        held, gap = [], room
        while gap and (n := stock.largest(gap)):
            stock.take(n)
            held.append(n)
            gap -= n
        while gap and len(held) > 1 and (two := stock.best_two(gap + held[-1])) and sum(two) > held[-1]:
            stock.give(small := held.pop())
            for n in two:
                stock.take(n)
            held = sorted([*held, *two], reverse=True)
            gap += small - sum(two)
        bins.append(held)
    return bins


def _groups(rows: DataFrame) -> tuple[int, int]:
    """How many groups to deal the pieces to, and how many pieces there are."""
    tokens, n = rows.agg(F.sum("length"), F.count("*")).first()
    return max(1, (tokens or 0) // GROUP_TOKENS, n // GROUP_ROWS), n


def _packed(rows: DataFrame, groups: int, turn: int) -> DataFrame:
    """``rows`` with sequence_id, offset and filled (tokens of the sequence)."""
    kinds = T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in ("sequence_id", "offset", "_filled"))])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = group.column("length").to_pylist()
        at: dict[int, list[int]] = defaultdict(list)
        for k in range(len(lengths) - 1, -1, -1):
            at[lengths[k]].append(k)
        base = turn << 56 | group.column("_group")[0].as_py() << 24
        seq, off, filled = (np.zeros(len(lengths), np.int64) for _ in range(3))
        for s, held in enumerate(best_two_fit(lengths)):
            used, total = 0, sum(held)
            for n in held:
                k = at[n].pop()
                seq[k], off[k], filled[k] = base + s, used, total
                used += n
        for name, values in (("sequence_id", seq), ("offset", off), ("_filled", filled)):
            group = group.append_column(name, pa.array(values))
        return group.drop_columns("_group")

    dealt = rows.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(run, kinds)


def place(rows: DataFrame) -> DataFrame:
    """The pieces with sequence_id and offset. ``rows`` must be stored (``cut`` or a table), as groups go by position."""
    names, (groups, n), turn, done = rows.columns, _groups(rows), 0, None
    while groups > 1:
        out = cut(_packed(rows, groups, turn), None if "ids" in names else n)  # with ids rows are large
        left = out.filter(F.col("_filled") < FILLED)
        fewer, n = _groups(left)
        if 2 * fewer > groups:  # documents that don't go together: packing them anew would change nothing
            left, full = None, out
        else:
            full = out.filter(F.col("_filled") >= FILLED)
        done = full if done is None else done.unionByName(full)
        if left is None:
            return done.drop("_filled")
        rows, groups, turn = cut(left.select(*names), None if "ids" in names else n), fewer, turn + 1
    out = _packed(rows, 1, turn)
    return (out if done is None else done.unionByName(out)).drop("_filled")


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    return place(cut(pieces(docs, path), docs.count(), dealt=True))


def sequences(docs: DataFrame, path: str | None = None) -> DataFrame:
    """sequence_id, n_tokens, ids (array of int): the packed sequences themselves, each of LENGTH tokens at most."""
    placed = place(cut(pieces(docs, path, with_ids=True)))
    one = F.struct("offset", "ids")
    whole = placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(one)).alias("p"))
    schema = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids = [np.frombuffer(b"".join(x["ids"] for x in p), "<i4") for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.list_(pa.int32()))], schema=schema)

    return whole.mapInArrow(run, "sequence_id long, n_tokens long, ids array<int>")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
