"""Operator 2: MPEG transport streams as a media column.

``store`` puts the bytes of a text into a transport stream: a program association table, a program map table and one
elementary stream of private data, whose access units of ``UNIT`` 8-bit samples each get a PES packet with a timestamp.
``read`` takes such streams apart again: it parses the program tables (with their checksums), checks the continuity
counter of every packet, reassembles the elementary packets, and stores timestamps with random-access points.

Defined results: a null or empty text is 64 zero bytes; equal texts give equal streams; a null doc_id is carried
along; other columns are ignored; an empty table gives no rows. A stream that is broken gives its errors in ``errors``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

PACKET, UNIT, PMT_PID, ES_PID, STREAM_TYPE, STREAM_ID = 188, 4096, 0x1000, 0x100, 0x06, 0xBD
#: A random-access point every so many access units; samples a second; ticks of the timestamps' clock a second.
EVERY, RATE, CLOCK = 4, 8000, 90_000


@cache
def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


def crc32_mpeg(data: bytes) -> int:
    c, t = 0xFFFFFFFF, _crc_table()
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ t[c >> 24 ^ b]
    return c


def _section(table_id: int, ext: int, body: bytes) -> bytes:
    n = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | n >> 8, n & 0xFF]) + ext.to_bytes(2, "big") + bytes([0xC1, 0, 0]) + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


@cache
def _tables() -> bytes:
    pat = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
    out = b""
    for pid, section in ((0, pat), (PMT_PID, pmt)):
        packet = bytes([0x47, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section
        out += packet + b"\xff" * (PACKET - len(packet))
    return out


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 30 & 7) << 1, pts >> 22 & 0xFF, 1 | (pts >> 15 & 0x7F) << 1, pts >> 7 & 0xFF, 1 | (pts & 0x7F) << 1])


def mux(payload: bytes) -> bytes:
    out, counter = [_tables()], 0
    high, low = 0x40 | ES_PID >> 8, ES_PID & 0xFF
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit, pts = payload[at : at + UNIT], at * CLOCK // RATE & 0x1FFFFFFFF
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (8 + len(unit)).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + unit
        # The first packet has the clock reference and, every so often, the random-access mark.
        adapt = bytes([0x10 | 0x40 * (k % EVERY == 0)]) + (pts << 15 | 0x7E00).to_bytes(6, "big")
        begin, first = 0, True
        while begin < len(pes):
            room = PACKET - 4 - (1 + len(adapt) if first else 0)
            part = pes[begin : begin + room]
            begin += room
            head = bytes([0x47, high if first else ES_PID >> 8, low])
            if first or len(part) < room:
                body = adapt if first else b""
                gap = room - len(part)
                if not first:
                    body, gap = (b"\x00", gap - 2) if gap > 1 else (b"", 0)
                body += b"\xff" * gap
                out += [head, bytes([0x30 | counter, len(body)]), body, part]
            else:
                out += [head, bytes([0x10 | counter]), part]
            counter, first = counter + 1 & 15, False
    return b"".join(out)


@dataclass
class Stream:
    payload: bytes = b""
    packets: int = 0
    program: int | None = None
    stream_type: int | None = None
    #: (timestamp, random access, bytes) of each elementary packet.
    units: list[tuple[int, bool, int]] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def demux(ts: bytes) -> Stream:
    s = Stream(packets=len(ts) // PACKET)
    pmt_pid = es_pid = None
    counters: dict[int, int] = {}
    held: list[bytes] = []
    rap, data = False, []

    def ended() -> None:
        if not held:
            return
        pes = b"".join(held)
        held.clear()
        if pes[:3] != b"\x00\x00\x01" or len(pes) < 14:
            s.errors.append("start code")
            return
        size, skip = int.from_bytes(pes[4:6], "big"), 9 + pes[8]
        pts = (pes[9] >> 1 & 7) << 30 | pes[10] << 22 | (pes[11] >> 1) << 15 | pes[12] << 7 | pes[13] >> 1
        if len(pes) != size + 6:
            s.errors.append(f"packet of {len(pes) - 6} bytes, {size} announced")
        data.append(pes[skip : size + 6])
        s.units.append((pts, rap, len(data[-1])))

    if len(ts) % PACKET:
        s.errors.append("length")
    for at in range(0, len(ts) - PACKET + 1, PACKET):
        b1, flags = ts[at + 1], ts[at + 3]
        if ts[at] != 0x47:
            s.errors.append(f"sync byte at {at}")
            continue
        pid, begin, mark = (b1 & 0x1F) << 8 | ts[at + 2], at + 4, False
        if flags & 0x20:
            n = ts[begin]
            mark = n > 0 and bool(ts[begin + 1] & 0x40)
            begin += 1 + n
        if not flags & 0x10:
            continue
        was = counters.get(pid)
        if was is not None and flags & 15 != was + 1 & 15:
            s.errors.append(f"continuity of {pid} at {at}")
        counters[pid] = flags & 15
        if pid == es_pid:
            if b1 & 0x40:
                ended()
                rap = mark
            held.append(ts[begin : at + PACKET])
        elif pid in (0, pmt_pid) and b1 & 0x40:
            begin += 1 + ts[begin]
            n = (ts[begin + 1] & 0x0F) << 8 | ts[begin + 2]
            section = ts[begin : begin + 3 + n]
            if crc32_mpeg(section):
                s.errors.append(f"checksum of the table of {pid}")
            elif pid == 0:
                s.program, pmt_pid = int.from_bytes(section[8:10], "big"), int.from_bytes(section[10:12], "big") & 0x1FFF
            else:
                k = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
                s.stream_type, es_pid = section[k], int.from_bytes(section[k + 1 : k + 3], "big") & 0x1FFF
    ended()
    s.payload = b"".join(data)
    return s


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b"\x00" * (-len(data) % 64 or 64 * (not data))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the transport stream of the text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                pairs = [padded(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in pairs], pa.int64()), pa.array([mux(p) for _, p in pairs], pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


UNITS = "array<struct<pts:long,random_access:boolean,bytes:long>>"
READ = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, program int, stream_type int, packets long, units {UNITS}, errors array<string>"


def read(media: DataFrame) -> DataFrame:
    """What the streams of ``store`` hold: digests of the payload, program, timestamps with random-access points, errors."""
    unit = pa.struct([("pts", pa.int64()), ("random_access", pa.bool_()), ("bytes", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("program", pa.int32()), ("stream_type", pa.int32()), ("packets", pa.int64()), ("units", pa.list_(unit)), ("errors", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for i, n, m in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    s = demux(m)
                    p = s.payload
                    rows.append((i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), s.program, s.stream_type, s.packets, [dict(zip(("pts", "random_access", "bytes"), u, strict=True)) for u in s.units], s.errors))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, READ)


def op2_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read(store(table(spark, sf_dir, "documents")))
    points = F.transform(F.filter("units", lambda u: u["random_access"]), lambda u: u["pts"])
    feature = F.format_string("program=%d;type=%d;packets=%d;units=%d;pts=%d-%d;random_access=%s;errors=%d", "program", "stream_type", "packets", F.size("units"), F.array_min(F.transform("units", lambda u: u["pts"])), F.array_max(F.transform("units", lambda u: u["pts"])), F.array_join(points, "+"), F.size("errors"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
