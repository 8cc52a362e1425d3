"""MPEG transport streams in a binary column: writing, and reading with checks.

A payload is cut into access units of UNIT bytes. Each becomes one PES packet
with a presentation timestamp; every RANDOM_EVERY-th carries a random-access
flag and a clock reference and is preceded by the program tables. The reader
follows the tables to the stream, checks continuity counters and table sums,
puts the PES packets together again and reports timestamps and random-access
points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strata.llm import words as W
from strata.llm.runtime import lean, plain, prepare

PMT_PID, ES_PID, PRIVATE = 0x1000, 0x0100, 0x06
UNIT, RANDOM_EVERY, TICK, ALIGN = 192 * 85, 8, 3600, 192


def _table_crc() -> np.ndarray:
    t = np.zeros(256, np.uint32)
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        t[i] = c
    return t


_CRC = _table_crc().tolist()


def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table: int, extension: int, body: bytes) -> bytes:
    n = 5 + len(body) + 4
    head = bytes([table, 0xB0 | n >> 8, n & 255]) + extension.to_bytes(2, "big") + bytes([0xC1, 0, 0]) + body
    return head + crc_mpeg(head).to_bytes(4, "big")


def _psi(pid: int, section: bytes) -> np.ndarray:
    p = np.full(188, 0xFF, np.uint8)
    p[:5] = (0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0)
    p[5 : 5 + len(section)] = np.frombuffer(section, np.uint8)
    return p


_PAT = _psi(0, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _psi(PMT_PID, _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _pts(t: int) -> bytes:
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 255, 1 | t >> 14 & 0xFE, t >> 7 & 255, 1 | t << 1 & 0xFE])


def mux(payload: bytes) -> bytes:
    """A transport stream that holds payload."""
    out, counter, tables = [], 0, 0
    data = np.frombuffer(payload, np.uint8)
    for u, at in enumerate(range(0, max(1, len(data)), UNIT)):
        body = data[at : at + UNIT]
        random = u % RANDOM_EVERY == 0
        time = u * TICK & (1 << 33) - 1
        if random:
            for p in (_PAT, _PMT):
                p = p.copy()
                p[3] |= tables & 15
                out.append(p)
            tables += 1
        head = b"\x00\x00\x01\xbd" + (8 + len(body)).to_bytes(2, "big") + b"\x84\x80\x05" + _pts(time)
        pes = np.concatenate([np.frombuffer(head, np.uint8), body])
        lead = 8 if random else 0
        n = -(-(len(pes) + lead) // 184)
        spare = n * 184 - lead - len(pes)
        p = np.full((n, 188), 0xFF, np.uint8)
        p[:, 0], p[:, 1], p[:, 2] = 0x47, ES_PID >> 8, ES_PID & 255
        p[0, 1] |= 0x40
        p[:, 3] = 0x10 | counter + np.arange(n) & 15
        counter += n
        start = np.full(n, 4)
        if random:
            pcr = time
            p[0, 3] |= 0x20
            p[0, 4:12] = (7, 0x50, pcr >> 25 & 255, pcr >> 17 & 255, pcr >> 9 & 255, pcr >> 1 & 255, (pcr & 1) << 7 | 0x7E, 0)
            start[0] = 12
        if spare:
            if n == 1 and random:
                p[0, 4] += spare
                start[0] += spare
            else:
                p[-1, 3] |= 0x20
                p[-1, 4] = spare - 1
                if spare > 1:
                    p[-1, 5] = 0
                start[-1] = 4 + spare
        p[np.arange(188) >= start[:, None]] = pes
        out.append(p.reshape(-1))
    return np.concatenate(out).tobytes()


@dataclass
class Stream:
    payload: bytes
    timestamps: list[int]
    random_access: list[int]  # packet numbers
    packets: int
    discontinuities: int


def demux(ts: bytes) -> Stream:
    """The first program's first stream. ValueError where sync bytes, table sums, tables or PES heads are wrong."""
    if not ts or len(ts) % 188:
        raise ValueError("not whole transport packets")
    p = np.frombuffer(ts, np.uint8).reshape(-1, 188)
    if (p[:, 0] != 0x47).any():
        raise ValueError("sync byte")
    pid = (p[:, 1].astype(int) & 31) << 8 | p[:, 2]

    def section(want: int) -> bytes:
        at = np.flatnonzero((pid == want) & (p[:, 1] & 0x40 > 0))
        if not len(at):
            raise ValueError(f"no table on {want}")
        row = p[at[0]].tobytes()
        s = row[5 + row[4] :]
        s = s[: 3 + (s[1] << 8 & 0xF00 | s[2])]
        if crc_mpeg(s):
            raise ValueError("table sum")
        return s

    pat = section(0)
    pmt = section(pat[10] << 8 & 0x1F00 | pat[11])
    skip = 12 + (pmt[10] << 8 & 0xF00 | pmt[11])
    es = pmt[skip + 1] << 8 & 0x1F00 | pmt[skip + 2]
    gaps = 0
    for x in np.unique(pid):
        own = p[pid == x]
        count = own[own[:, 3] & 0x10 > 0, 3] & 15
        gaps += int(((np.diff(count.astype(int)) - 1) % 16 != 0).sum())
    at = np.flatnonzero(pid == es)
    own = p[at]
    extra = (own[:, 3] & 0x20) > 0
    start = np.where(extra, 5 + own[:, 4].astype(int), 4)
    has = (own[:, 3] & 0x10) > 0
    keep = (np.arange(188) >= start[:, None]) & has[:, None]
    stream = own[keep]
    ends = np.cumsum(keep.sum(axis=1))
    begins = (own[:, 1] & 0x40) > 0
    first = (ends - keep.sum(axis=1))[begins]
    random = extra & (own[:, 4] > 0) & ((own[:, 5] & 0x40) > 0)
    units, times = [], []
    for a, b in zip(first, np.append(first[1:], len(stream)), strict=True):
        h = stream[a : a + 14].tobytes()
        if h[:3] != b"\x00\x00\x01" or (h[4] << 8 | h[5]) + 6 != b - a:
            raise ValueError("PES head or length")
        if h[7] & 0x80:
            times.append((h[9] & 14) << 29 | h[10] << 22 | (h[11] & 254) << 14 | h[12] << 7 | h[13] >> 1)
        units.append(stream[a + 9 + h[8] : b])
    return Stream(np.concatenate(units).tobytes() if units else b"", times, at[random].tolist(), len(p), gaps)


def padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % ALIGN or (0 if text else ALIGN))


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text, padded, as a transport stream. Null is the empty text; equal texts give equal streams."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, part in W.chunked(b.column(1)):
                texts = [(x or "").encode() for x in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(part)), pa.array([len(x) for x in texts], pa.int64()), pa.array([mux(padded(x)) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return plain(docs, "doc_id", "text").mapInArrow(lean(run), "doc_id long, n_bytes long, media binary")


READ = "doc_id long, n_bytes long, payload binary, packets long, discontinuities long, timestamps array<long>, random_access array<long>, media_bytes long, media_sha256 string"


def load(media: DataFrame) -> DataFrame:
    """What the stored streams hold: payload, timestamps, random-access packets and the checks' findings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [[] for _ in range(7)]
            for m in b.column(2):
                ts = m.as_buffer().to_pybytes()
                s = demux(ts)
                for c, x in zip(cols, (s.payload, s.packets, s.discontinuities, s.timestamps, s.random_access, len(ts), hashlib.sha256(ts).hexdigest()), strict=True):
                    c.append(x)
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_bytes", "payload", "packets", "discontinuities", "timestamps", "random_access", "media_bytes", "media_sha256"])

    return media.mapInArrow(lean(run), READ)


def tail_crc(payload: bytes) -> int:
    return zlib.crc32(payload[-16:])
