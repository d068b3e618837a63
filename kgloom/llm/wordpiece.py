"""Operator 5: token counts by linear longest match over a vocabulary trie with failure links.

A word is cut greedily: always the longest piece that the vocabulary has. Going back after a failed match would be
quadratic; instead each node of the trie has a failure link to the node of what remains once the pieces before it are
popped, and the count of those pieces. So a word's length in pieces comes from one pass, and no piece is ever built.

A word is a run of other than white space, with the vocabulary's word mark before it. A character that no piece has is
spelled by its bytes, each a token. Counts of words of up to ``KEPT_CHARS`` characters are kept in a memo of bounded size.

Defined results: a null or empty text has no words and no tokens; equal texts have equal counts; a null doc_id is
carried along; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import on_batches, table
from .packing import KEPT_CHARS, vocabulary

MARK = "▁"


class LongestMatch:
    """Counts pieces. ``pieces`` may stand at any place of a word."""

    held: dict[str, LongestMatch] = {}

    def __init__(self, pieces: list[str], mark: str = MARK, most: int = 300_000):
        self.pieces, self.mark, self.most, self.memo = set(pieces), mark, most, {}
        self.longest = max(map(len, pieces), default=0)
        self.step: list[dict[str, int]] = [{}]
        whole = [False]
        for p in pieces:
            at = 0
            for c in p:
                if c not in self.step[at]:
                    self.step[at][c] = len(self.step)
                    self.step.append({})
                    whole.append(False)
                at = self.step[at][c]
            whole[at] = True
        self.fail, self.popped = [-1] * len(self.step), [0] * len(self.step)
        queue = deque((0, c, v) for c, v in self.step[0].items())
        while queue:
            parent, c, v = queue.popleft()
            if whole[v]:
                self.fail[v], self.popped[v] = 0, 1
            else:
                z, n = self.fail[parent], self.popped[parent]
                while z >= 0 and c not in self.step[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.step[z][c], n
            queue.extend((v, d, w) for d, w in self.step[v].items())

    @classmethod
    def at(cls, path: str) -> LongestMatch:
        if path not in cls.held:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            cls.held[path] = cls([sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))])
        return cls.held[path]

    def count(self, word: str) -> int:
        step, fail, popped, at, n = self.step, self.fail, self.popped, 0, 0
        for c in word:
            while (to := step[at].get(c)) is None:
                if not at:  # no piece starts with it
                    n += len(c.encode("utf-8", "surrogatepass"))
                    to = 0
                    break
                if fail[at] < 0:
                    return self.plain(word)
                n += popped[at]
                at = fail[at]
            at = to
        while at:
            if fail[at] < 0:
                return self.plain(word)
            n += popped[at]
            at = fail[at]
        return n

    def plain(self, word: str) -> int:
        """Greedy longest match with going back, for words with characters that only longer pieces have."""
        at = n = 0
        while at < len(word):
            for end in range(min(len(word), at + self.longest), at, -1):
                if word[at:end] in self.pieces:
                    at, n = end, n + 1
                    break
            else:
                n += len(word[at].encode("utf-8", "surrogatepass"))
                at += 1
        return n

    def of_word(self, word: str) -> int:
        got = self.memo.get(word)
        if got is None:
            got = self.count(self.mark + word)
            if len(word) <= KEPT_CHARS:
                if len(self.memo) >= self.most:
                    self.memo.clear()
                self.memo[word] = got
        return got


_SPACES = str.maketrans("\t\n\x0b\f\r", "     ")


def words(text: str | None) -> list[str]:
    return [w for w in (text or "").translate(_SPACES).split(" ") if w]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens, longest_word (in tokens)."""
    path = path or vocabulary("piece_bpe_32k.model")

    def make(cols: list[list]) -> list[list]:
        match, n_words, n_tokens, longest = LongestMatch.at(path), [], [], []
        for t in cols[1]:
            ns = list(map(match.of_word, words(t)))
            n_words.append(len(ns))
            n_tokens.append(sum(ns))
            longest.append(max(ns, default=0))
        return [cols[0], n_words, n_tokens, longest]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return on_batches(rows, make, "doc_id long, n_words long, n_tokens long, longest_word long", pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_tokens", "longest_word")]))


def op5_longest_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
