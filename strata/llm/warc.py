"""WARC archives from pages, read back, and their capture index merged.

Archives are byte strings of up to ARCHIVE_BYTES in a binary column, written
to the shared folder as a table: its commit protocol keeps a retried task from
leaving half an archive. Of records with equal payloads the one with the
smallest page_id is a response; the others are revisits that carry the HTTP
head alone, whose Content-Length is the full payload's. Reading recomputes the
digest of every stored payload.

Each archive's index lines, sorted by URL key, timestamp and page, are one
capture run. The runs are cut at common range bounds of all three, so one hot
URL spreads too, and within a range a loser tree merges its k runs.

Null html is an empty payload, null url an empty key; repeated pages of one
page_id and payload are all responses where that id is the smallest.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.runtime import lean, parts, plain, prepare, table

ARCHIVE_BYTES, RANGE_LINES = 8 << 20, 50_000
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str) -> str:
    """Sort-friendly key: host labels reversed, no scheme, user, www or fragment, all lower case."""
    try:
        u = urlsplit(url.strip())
        host = (u.hostname or "").removeprefix("www.")
        port = f":{u.port}" if u.port and u.port not in (80, 443) else ""
    except ValueError:
        return url.strip().lower()
    query = f"?{'&'.join(sorted(u.query.split('&')))}" if u.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){u.path or '/'}{query}".lower()


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str, date: str, payload: bytes, digest: str, first: int | None) -> bytes:
    """One record; first: the page that it revisits, or null for a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if first is None else "revisit"
    block = http if first is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', url)}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(archive: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, fields and block of each record. ValueError where the archive breaks off."""
    at = 0
    while at < len(archive):
        end = archive.find(b"\r\n\r\n", at)
        if end < 0 or not archive.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at {at}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in archive[at:end].decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        block = archive[end + 4 : end + 4 + n]
        stop = end + 4 + n + 4
        if archive[stop - 4 : stop] != b"\r\n\r\n":
            raise ValueError(f"record at {at} is cut")
        yield at, stop - at, fields, block
        at = stop


def _page(urn: str) -> int | None:
    s = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(s) if s else None


def parsed(fields: dict[str, str], block: bytes) -> tuple:
    """page_id, url key, date, payload bytes, digest, type, refers_to. A stored payload must have its digest."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError("payload doesn't have its digest")
    refers = fields.get("WARC-Refers-To")
    return _page(fields["WARC-Record-ID"]), url_key(fields["WARC-Target-URI"]), fields["WARC-Date"], size, digest, fields["WARC-Type"], _page(refers) if refers else None


def write(pages: DataFrame) -> DataFrame:
    """(archive, content): all pages as archives in the shared folder."""
    prepare(pages.sparkSession)
    own = plain(pages, "page_id", "url", "html").withColumn("sha1", F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary"))))
    first = own.groupBy("sha1").agg(F.min("page_id").alias("first"))
    # payloads don't go by their digest, which many may share, but by page and digest
    ids = own.select("page_id", "sha1").distinct().join(first, "sha1").select(F.col("page_id").alias("page"), F.col("sha1").alias("sum"), "first")
    told = own.join(ids, F.col("page_id").eqNullSafe(F.col("page")) & (F.col("sha1") == F.col("sum"))).select("page_id", "url", "html", F.when(F.col("page_id") == F.col("first"), None).otherwise(F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{n:06d}.warc"]), pa.array([b"".join(held)], pa.binary())], ["archive", "content"])

        for b in batches:
            for page, url, html, refers in zip(*[c.to_pylist() for c in b.columns], strict=True):
                payload = (html or "").encode()
                date = (EPOCH + timedelta(seconds=(page or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")
                held.append(record(page, url or "", date, payload, base32_sha1(payload), refers))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    n, held, size = n + 1, [], 0
        if held:
            yield flush()

    return table(told.mapInArrow(lean(run), "archive string, content binary"), "warc")


INDEX = "archive string, offset long, length long, page_id long, url_key string, date string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_KINDS = [{"string": pa.string(), "long": pa.int64()}[x.split()[1]] for x in INDEX.split(", ")]


def index(archives: DataFrame) -> DataFrame:
    """One line for each record, each archive's lines sorted: its capture run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                rows = [(name.as_py(), at, n, *parsed(f, x)) for at, n, f, x in records(content.as_py())]
                rows.sort(key=_order)
                yield _batch(rows)

    return archives.mapInArrow(lean(run), INDEX)


def _order(r: tuple) -> tuple:
    return r[4], r[5], -1 if r[3] is None else r[3], r[0], r[1]


def _batch(rows: list[tuple], extra: list[int] | None = None) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
    arrays, names = [pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], list(_NAMES)
    if extra is not None:
        arrays, names = [*arrays, pa.array(extra, pa.int64())], [*names, "capture_order"]
    return pa.RecordBatch.from_arrays(arrays, names)


class LoserTree:
    """Merges k sorted runs with one comparison a level: inner nodes keep the loser of each match, the winner is on top."""

    def __init__(self, runs: Iterable[Iterable], key):
        self.its, self.key = [iter(r) for r in runs], key
        self.k = max(1, len(self.its))
        self.head = [self._next(i) for i in range(len(self.its))] or [None]
        self.tree = [-1] * self.k
        for i in reversed(range(self.k)):
            self._play(i)

    def _next(self, i: int):
        x = next(self.its[i], None)
        return None if x is None else (self.key(x), i, x)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or x is not None and x[:2] < y[:2]

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            if self.tree[node] < 0:  # the first to come waits for its opponent
                self.tree[node] = winner
                return
            if self._beats(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while (top := self.head[self.tree[0]]) is not None:
            yield top[2]
            i = top[1]
            self.head[i] = self._next(i) if self.its else None
            self._play(i)


def merge(lines: DataFrame) -> DataFrame:
    """The index in global order of URL key, date and page, with that order as the column capture_order.

    lines: a written table, as it is counted first: a range has about RANGE_LINES lines at most, which is what a task holds.
    """
    ranges = max(parts(lines.sparkSession), math.ceil(lines.count() / RANGE_LINES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, runs = TaskContext.get().partitionId(), {}
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                runs.setdefault(r[0], []).append(r)
        out, n = [], part << 40
        for r in LoserTree(runs.values(), _order):
            out.append(r)
            if len(out) == 5000:
                yield _batch(out, list(range(n, n + 5000)))
                out, n = [], n + 5000
        if out:
            yield _batch(out, list(range(n, n + len(out))))

    sorted_runs = lines.repartitionByRange(ranges, "url_key", "date", "page_id").sortWithinPartitions("archive", "url_key", "date", F.asc_nulls_first("page_id"), "offset")
    return sorted_runs.mapInArrow(lean(run), INDEX + ", capture_order long")


def captures(pages: DataFrame) -> DataFrame:
    """Archives written, read back, indexed, and the index merged; capture_rank counts the lines in that order from 0."""
    merged = table(merge(table(index(write(pages)), "runs")), "merged")
    part = F.shiftright("capture_order", 40)
    # a row for each range of RANGE_LINES lines
    sizes = merged.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    sizes = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.col("before") + F.col("capture_order").bitwiseAND((1 << 40) - 1)
    return merged.join(sizes, part == F.col("part")).select(*merged.columns, rank.alias("capture_rank"))
