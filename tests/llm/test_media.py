import hashlib
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from strata.llm import mpegts, queries


@given(st.integers(0, 6), st.integers(-3, 3), st.integers(0, 255))
def test_streams_come_back(units, more, byte):
    payload = bytes((byte + i * 7) & 255 for i in range(max(1, units * mpegts.UNIT // 4 + more)))
    ts = mpegts.mux(payload)
    s = mpegts.demux(ts)
    n = -(-len(payload) // mpegts.UNIT)
    assert s.payload == payload and s.discontinuities == 0 and s.packets * 188 == len(ts)
    assert s.timestamps == [i * mpegts.TICK for i in range(n)] and len(s.random_access) == -(-n // mpegts.RANDOM_EVERY)
    for p in s.random_access:
        assert ts[188 * p + 1] & 0x40 and ts[188 * p + 5] & 0x40


def test_every_packet_is_well_formed():
    ts = mpegts.mux(b"x" * 100_000)
    counters = {}
    for i in range(0, len(ts), 188):
        p = ts[i : i + 188]
        pid = (p[1] & 31) << 8 | p[2]
        assert p[0] == 0x47 and p[3] & 15 == counters.get(pid, -1) + 1 & 15
        counters[pid] = p[3] & 15
        if p[3] & 0x20:
            assert p[4] <= 183
    assert set(counters) == {0, mpegts.PMT_PID, mpegts.ES_PID}


def test_lost_packets_and_damage_are_found():
    ts = mpegts.mux(b"x" * (3 * mpegts.UNIT))
    assert mpegts.crc_mpeg(b"123456789") == 0x0376E6E7
    bad = bytearray(ts)
    bad[0] = 0
    with pytest.raises(ValueError, match="sync"):
        mpegts.demux(bytes(bad))
    bad = bytearray(ts)
    bad[15] ^= 1
    with pytest.raises(ValueError, match="sum"):
        mpegts.demux(bytes(bad))
    with pytest.raises(ValueError):
        mpegts.demux(ts[: 188 * 4] + ts[188 * 5 :])  # a PES packet isn't whole
    with pytest.raises(ValueError, match="whole"):
        mpegts.demux(ts[:-1])
    with pytest.raises(ValueError, match="no table"):
        mpegts.demux(ts[188:])
    again = mpegts.demux(ts + mpegts.mux(b"y" * 192))  # a splice: counters start anew
    assert again.discontinuities > 0


def test_timestamps_have_33_bits():
    for t in (0, 1, 3600, (1 << 33) - 1, 0x155555555):
        h = mpegts._pts(t)
        assert (h[0] & 14) << 29 | h[1] << 22 | (h[2] & 254) << 14 | h[3] << 7 | h[4] >> 1 == t and h[0] & 1 and h[2] & 1 and h[4] & 1


def test_documents(spark, table, corpus):
    rows = mpegts.load(mpegts.store(table(corpus))).collect()
    want = sorted((str(i), len((t or "").encode()), mpegts.padded((t or "").encode())) for i, t in corpus)
    assert sorted((str(r["doc_id"]), r["n_bytes"], bytes(r["payload"])) for r in rows) == want
    assert all(r["discontinuities"] == 0 and len(r["payload"]) % 192 == 0 and len(r["payload"]) for r in rows)
    assert mpegts.load(mpegts.store(table([]))).collect() == []


def test_query(spark, small):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op7_media(spark, small).collect()
    assert len(rows) == len(docs)
    same = {}
    for r in rows:
        raw = docs[r["doc_id"]]
        p = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        ts = mpegts.mux(p)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(ts), hashlib.sha256(ts).hexdigest())
        assert same.setdefault(raw, r["feature"]) == r["feature"]


def test_streams_are_written_before_they_are_read(spark, small):
    files = queries.op7_media(spark, small).inputFiles()
    assert files and all("strata-media-" in f for f in files)
