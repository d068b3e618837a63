"""Operator 1: personal data by anchor expansion.

One Aho-Corasick automaton goes over each whole text and finds anchors: at-signs, plus signs, digits, schemes and
cues of identifiers. From an anchor a local parser of its kind expands to the bounds of the span and validates it; text
without anchors is never looked at twice. Email, ip, card and phone have the bounds that a leftmost, non-overlapping
search by their expressions has. Added kinds: ``login`` (user:password@ in a URL), ``iban`` (after its cue, a run of words that holds
modulo 97, as words may follow it)
and ``account`` (6 to 17 digits after a cue, no part of another span).

Defined results: a null or empty text has no spans; equal rows give equal rows; a null doc_id is carried along; other
columns are ignored by the query and kept by ``redact``; an empty table gives no rows. Offsets are code points.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import on_batches, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "account")
CUES = ("account", "acct", "konto", "compte", "cuenta")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_LETTER = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"://[^\s/?#@:]+:[^\s/?#@]+@[A-Za-z0-9][A-Za-z0-9.-]*")
_IBAN = re.compile(r"(?:[\x20-]?(?i:no\.?|number|nr\.?))?[:\s]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_IBAN_LENGTHS = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 "
        "HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 "
        "QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}
_END = re.compile(r"(?<=[A-Z0-9])(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:\x20?(?:no\.?|number|nr\.?|#))?[\x20:=#]{1,3}([0-9](?:-?[0-9]){5,16})(?![0-9])", re.IGNORECASE)


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, "digit")
    for key, value in {"@": "at", "+": "plus", "://": "scheme"}.items():
        a.add_word(key, value)
    for cue in ("iban", *CUES):
        for form in {cue, cue.title(), cue.upper()}:
            a.add_word(form, "iban" if cue == "iban" else "account")
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(int("0246813579"[int(d)]) for d in even)) % 10 == 0


def _iban(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _iban_end(text: str, start: int, end: int) -> int | None:
    """Where the number from ``start`` ends: a run of whole words up to ``end`` that holds modulo 97, of its country's
    length or else the longest."""
    size = lambda e: len(text[start:e].replace(" ", ""))
    ends = [e for m in _END.finditer(text, start, end + 1) if (e := m.start()) <= end and size(e) >= 15 and _iban(text[start:e])]
    own = _IBAN_LENGTHS.get(text[start : start + 2])
    return next((e for e in ends if size(e) == own), max(ends, default=None))


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end), by start, then kind as in KINDS."""
    if not text:
        return []
    out: list[tuple[str, int, int]] = []
    later: list[tuple[str, int]] = []
    email = ip = card = phone = 0  # where the last match of the kind ended
    for at, what in _automaton().iter(text):
        if what == "digit":
            if at >= card and (m := _CARD.match(text, at)):
                card = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", at, card))
            if at >= ip:
                if m := _IP.match(text, at):
                    ip = m.end()
                    if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                        out.append(("ip", at, ip))
                else:
                    ip = _DIGITS.match(text, at).end()
        elif what == "at":
            start = at
            while start > email and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email = m.end()
                out.append(("email", start, email))
        elif what == "plus":
            if at >= phone and (m := _PHONE.match(text, at)):
                phone = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", at, phone))
        else:
            later.append((what, at))
    for what, at in later:
        if what == "scheme":
            start = at - 2
            while start > 0 and text[start - 1] in _LETTER:
                start -= 1
            if start < at - 2 and (m := _LOGIN.match(text, at - 2)):
                out.append(("login", start, m.end()))
        elif what == "iban":
            if (m := _IBAN.match(text, at + 1)) and (end := _iban_end(text, m.start(1), m.end(1))):
                out.append((what, m.start(1), end))
        elif (m := _ACCOUNT.match(text, at + 1)) and not any(s < m.end(1) and m.start(1) < e for _, s, e in out):
            out.append((what, m.start(1), m.end(1)))
    rank = KINDS.index
    return sorted(set(out), key=lambda x: (x[1], rank(x[0]), x[2]))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of kind, start, end): one row for each row of ``docs``."""

    def make(cols: list[list]) -> list[list]:
        return [cols[0], [[{"kind": k, "start": s, "end": e} for k, s, e in spans(t)] for t in cols[1]]]

    one = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return on_batches(rows, make, "doc_id long, spans array<struct<kind:string,start:long,end:long>>", pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(one))]))


def masked(text: str | None) -> str | None:
    """``text`` with each span, or run of overlapping spans, replaced by the kind of its first."""
    if not (found := spans(text)):
        return text
    out, done, upto = [], 0, 0
    for kind, start, end in found:
        if start >= upto:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = upto = max(upto, end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with its personal data masked in ``text``; n_chars, if there, follows."""

    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        parts = [pa.array([masked(t) for t in texts.slice(k, 256).to_pylist()], pa.string()) for k in range(0, len(texts), 256)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    out = docs.withColumn("text", mask("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _joined(only_base: bool) -> F.Column:
    found = F.filter("spans", lambda s: s["kind"].isin(*BASE)) if only_base else F.col("spans")
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    kinds = F.transform("spans", lambda s: s["kind"])
    n = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *n, F.sha2(_joined(True), 256).alias("base_sha256"), _joined(False).alias("spans"))
