import base64
import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import types as T

from strata.llm import queries, warc

PAGES = T.StructType().add("page_id", "long").add("url", "string").add("html", "string").add("archive", "string").add("first", "long")
ROWS = [
    (5, "http://www.B.example.com/x?b=2&a=1", "<p>é</p>"), (3, "https://a.example.com", "<p>é</p>"), (9, "http://b.example.com:8080/x", None), (4, "", ""), (7, None, "<p>é</p>"), (None, "http://z.org/\r\nX: y", "q"),
    (8, "not a url\x00", "WARC/1.1\r\n\r\nfake\r\n\r\n"), (8, "http://b.example.com/same", "twice"), (8, "http://b.example.com/same", "twice"), (11, "http://[bad", "x" * 5000), (12, "http://b.example.com/same", "later"),
]


def pages(spark, rows=ROWS, parts=3):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], PAGES).repartition(parts)


@given(st.lists(st.lists(st.integers(0, 30)), max_size=9))
def test_loser_tree_merges(runs):
    tree = warc.LoserTree([sorted(r) for r in runs], lambda x: x)
    assert list(tree) == sorted(x for r in runs for x in r)


def test_merge_of_equal_keys_goes_by_run():
    got = list(warc.LoserTree([[(1, "a"), (2, "a")], [(1, "b")], [(0, "c"), (2, "c")]], lambda x: x[0]))
    assert got == [(0, "c"), (1, "a"), (1, "b"), (2, "a"), (2, "c")]


@given(st.binary(max_size=300), st.text(max_size=40), st.integers(0, 2**40))
def test_records_come_back(payload, url, page):
    a = warc.record(page, url, "2024-01-01T00:00:00Z", payload, warc.base32_sha1(payload), None)
    b = warc.record(page + 1, url, "2024-01-01T00:00:01Z", payload, warc.base32_sha1(payload), page)
    (at0, n0, f0, b0), (at1, n1, f1, b1) = warc.records(a + b)
    assert (at0, n0, at1, n1) == (0, len(a), len(a), len(b))
    x, y = warc.parsed(f0, b0), warc.parsed(f1, b1)
    assert (x[0], x[3], x[5], x[6]) == (page, len(payload), "response", None) and (y[0], y[3], y[5], y[6]) == (page + 1, len(payload), "revisit", page)
    assert b0.endswith(payload) and len(b1) < 200


def test_cut_and_changed_archives_are_errors():
    good = warc.record(1, "u", "d", b"payload", warc.base32_sha1(b"payload"), None)
    with pytest.raises(ValueError):
        list(warc.records(good[:-3]))
    with pytest.raises(ValueError):
        list(warc.records(b"junk" + good))
    (_, _, f, b) = next(iter(warc.records(good.replace(b"payload\r\n", b"pAyload\r\n"))))
    with pytest.raises(ValueError):
        warc.parsed(f, b)


@pytest.mark.parametrize("size", [8 << 20, 300])
def test_captures(spark, monkeypatch, size):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", size)
    rows = warc.captures(pages(spark)).collect()
    low = {}
    for p, _, h in ROWS:
        low[h or ""] = min((x for x in (low.get(h or ""), p) if x is not None), default=None)
    want = []
    for p, _, h in ROWS:
        raw = (h or "").encode()
        first = low[h or ""]
        kind = "response" if p == first else "revisit"
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind if first is not None else "response", first if kind == "revisit" else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=key) == sorted(want, key=key)
    in_order = sorted(rows, key=lambda r: r["capture_order"])
    keys = [(r["url_key"], r["date"], -1 if r["page_id"] is None else r["page_id"]) for r in in_order]
    assert keys == sorted(keys) and len({r["capture_order"] for r in rows}) == len(rows)
    assert [r["capture_rank"] for r in in_order] == list(range(len(rows)))  # the rank is that order, without gaps


def test_url_keys():
    assert warc.url_key("HTTP://www.B.example.com:80/X?b=2&a=1#f") == "com,example,b)/x?a=1&b=2"
    assert warc.url_key("https://a.org:8443") == "org,a:8443)/" and warc.url_key("") == ")/" and warc.url_key("http://[bad") == "http://[bad"


def test_no_pages_and_query(spark, small):
    assert warc.captures(pages(spark, [])).collect() == []
    rows = queries.op2_warc(spark, small).collect()
    html = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in rows} == {i: (len(h), warc.base32_sha1(h)) for i, h in html.items()}
