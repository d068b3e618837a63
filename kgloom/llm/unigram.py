"""Operator 3: SentencePiece encoding and decoding by an Aho-Corasick automaton and a single-pass Viterbi.

The automaton holds the pieces of the vocabulary. It goes over the text once; at each position the output links give
the pieces that end there, and each relaxes the best score of that position (ties: the longest piece). A character in no
piece is spelled by its bytes. The encoding is the one of largest total score.

Scores: those of the vocabulary if it is a unigram model. A BPE model has merge ranks (0, -1, -2 ...) in their place, which
say nothing of probabilities; there a piece scores as Zipf's law has it for its rank, ``-log(rank + ZIPF)``, characters as
the vocabulary's last. Nothing is fitted. Such encodings are no BPE: they are near the library's for the model in length
(README has the figure) but not the same ids.

No piece has a word mark after another character, and none a line feed, so that every encoding is cut there; parts
between such places are solved once and, up to ``KEPT_CHARS`` characters, kept in a memo of bounded size. Both facts are checked when the vocabulary
is read; where one doesn't hold, texts aren't cut at that place.

Defined results: a null or empty text has no ids; equal texts give equal ids; a null doc_id is carried along; other
columns are ignored; an empty table gives no rows. Decoding gives the text back, but for the character U+2581, which
marks blanks and comes back as one; ``exact`` says whether it did.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table
from .packing import KEPT_CHARS, vocabulary

MARK = "▁"
#: How much worse than the worst piece an unknown character scores.
PENALTY = 10.0
#: Zipf-Mandelbrot offset: ranks below it differ little.
ZIPF = 100


def log_probabilities(scores: list[float]) -> list[float]:
    """The scores of pieces, by id, as log-probabilities. Merge ranks are whole numbers; a far greater one stands for the last."""
    if any(s != int(s) for s in scores):
        return scores
    last = max((-s for s in scores if -s < len(scores)), default=0)
    return [-math.log(ZIPF + min(-s, last)) for s in scores]


class Pieces:
    held: dict[str, Pieces] = {}

    def __init__(self, path: str, most: int = 300_000):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.most, self.memo, self.elder = most, {}, {}
        self.auto, self.singles, self.bytes, self.text = ahocorasick.Automaton(), set(), [0] * 256, []
        self.scores = log_probabilities([sp.get_score(i) for i in range(sp.get_piece_size())])
        least, inner, lines = 0.0, False, False
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[b := int(piece[3:5], 16)] = i
                self.text.append(bytes([b]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.text.append(b"")
            else:
                self.text.append(piece.replace(MARK, " ").encode())
                least = min(least, self.scores[i])
                inner |= MARK in piece.lstrip(MARK)
                lines |= "\n" in piece
                self.auto.add_word(piece, (i, len(piece), self.scores[i]))
                if len(piece) == 1:
                    self.singles.add(piece)
        self.auto.make_automaton()
        self.unknown = least - PENALTY
        body = rf"[^{'' if inner else MARK}{'' if lines else chr(10)}]" if not (inner and lines) else r"[\s\S]"
        self.parts = re.compile(("" if lines else "\n|") + (f"{MARK}+{body}*|{body}+" if not inner else f"{body}+"))

    @classmethod
    def at(cls, path: str) -> Pieces:
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def solve(self, part: str) -> bytes:
        """The ids of largest total score, as 32-bit numbers."""
        n, low = len(part), float("-inf")
        best, last, size = [0.0] + [low] * n, [0] * (n + 1), [1] * (n + 1)
        odd = [k for k, c in enumerate(part, 1) if c not in self.singles]
        odd.append(n + 2)
        j = 0
        for end, (i, length, score) in self.auto.iter(part):
            end += 1
            while odd[j] < end:  # positions that only a spelled character, or a longer piece, leads to
                self._spell(best, last, size, odd[j])
                j += 1
            total = best[end - length] + score
            if total > best[end]:
                best[end], last[end], size[end] = total, i, length
        for k in odd[j:-1]:
            self._spell(best, last, size, k)
        out, k = [], n
        while k:
            if last[k] < 0:
                out += [self.bytes[b] for b in reversed(part[k - 1].encode("utf-8", "surrogatepass"))]
            else:
                out.append(last[k])
            k -= size[k]
        return array("I", out[::-1]).tobytes()

    def _spell(self, best: list[float], last: list[int], size: list[int], k: int) -> None:
        if best[k - 1] + self.unknown > best[k]:
            best[k], last[k], size[k] = best[k - 1] + self.unknown, -1, 1

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        parts = self.parts.findall(MARK + text.replace(" ", MARK))
        new = set(parts).difference(self.memo)
        if new:
            if len(self.memo) + len(new) > self.most:
                self.memo, self.elder = {}, self.memo
                new = set(parts)
            self.memo |= {part: self.elder.get(part) or self.solve(part) for part in new}
        out = b"".join(map(self.memo.__getitem__, parts))
        for part in [part for part in new if len(part) > KEPT_CHARS]:
            del self.memo[part]
        return out

    def decode(self, ids: bytes) -> str:
        whole = b"".join(map(self.text.__getitem__, array("I", ids)))
        return whole.decode("utf-8", "surrogatepass")[1:]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int)."""
    return _run(docs, path, [("ids", pa.list_(pa.int32()), "array<int>")], lambda p, t, ids: (array("i", ids),))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text, from doc_id and ids."""
    path = path or vocabulary("piece_bpe_32k.model")
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.at(path)
        for batch in batches:
            for part in slices(batch):
                texts = [pieces.decode(array("I", x or []).tobytes()) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _run(docs: DataFrame, path: str | None, columns: list[tuple], make) -> DataFrame:
    path = path or vocabulary("piece_bpe_32k.model")
    schema = pa.schema([("doc_id", pa.int64()), *((n, t) for n, t, _ in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.at(path)
        for batch in batches:
            for part in slices(batch, 1 << 20):
                rows = [make(pieces, t or "", pieces.encode(t or "")) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types[1:], strict=True))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} {s}" for n, _, s in columns))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of little-endian 32-bit ids), decoded_sha256 (of what the ids give back), exact."""

    def make(pieces: Pieces, text: str, ids: bytes) -> tuple:
        back = pieces.decode(ids)
        return len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text

    return _run(docs, path, [("n_tokens", pa.int64(), "long"), ("ids_crc32", pa.int64(), "long"), ("decoded_sha256", pa.string(), "string"), ("exact", pa.bool_(), "boolean")], make)


def op3_unigram_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
