"""Two binary formats: sorted segments of pairs, and write-ahead logs. All numbers are little-endian.

Segment: records (key length i32, value length i32, key, value), then a bloom
filter (bits i32, hashes i32, bytes), then a footer (its offset i64, version i32,
magic i32). Log: batches of a begin mark, puts (mark, key length, value length,
CRC-32 of key and value as i64, key, value) and a commit mark, all marks i32.

Files are read through Spark's binaryFile source, from any file system that it
reads, one task for each; a file is at most 2 GB. Writers make files' bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.sources.lineage import ship

# Fixed values of the formats.
MAGIC, VERSION = 0x4B4F5245, 1
BLOOM_BITS, BLOOM_HASHES = 100_000, 3
BEGIN, PUT, COMMIT, LARGEST = 1, 2, 3, 50 * 1024 * 1024
CHUNK = 5000


class CorruptFile(ValueError):
    """Not a file of this format."""


class UnsupportedVersion(ValueError):
    """A segment of another version."""


def _signed(x: int) -> int:
    return (x + (1 << 31)) % (1 << 32) - (1 << 31)


def bloom_places(key: bytes, bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> list[int]:
    """The bits of a key: two 32-bit hashes over signed bytes, combined."""
    a, b = 5381, 0
    for c in key:
        c -= (c & 0x80) << 1
        a, b = _signed(_signed(a * 33) ^ c), _signed(b * 31 + c)
    return [abs(_signed(a + i * b)) % bits for i in range(hashes)]


def segment(pairs: Iterable[tuple[bytes, bytes]]) -> bytes:
    """A segment's bytes; pairs in order of key, each key once, an empty value a delete."""
    body, bloom, last = bytearray(), bytearray(), None
    for k, v in pairs:
        if last is not None and k <= last:
            raise ValueError("keys must rise")
        last = k
        body += struct.pack("<ii", len(k), len(v)) + k + v
        for p in bloom_places(k):
            if len(bloom) <= p >> 3:
                bloom.extend(bytes((p >> 3) + 1 - len(bloom)))
            bloom[p >> 3] |= 1 << (p & 7)
    return bytes(body) + struct.pack("<ii", BLOOM_BITS, BLOOM_HASHES) + bytes(bloom) + struct.pack("<qii", len(body), VERSION, MAGIC)


def _body_end(data: bytes) -> int:
    if len(data) < 16:
        raise CorruptFile("no footer")
    end, version, magic = struct.unpack_from("<qii", data, len(data) - 16)
    if magic != MAGIC:
        raise CorruptFile("wrong magic number")
    if version != VERSION:
        raise UnsupportedVersion(f"version {version}")
    if not 0 <= end <= len(data) - 24:
        raise CorruptFile("bloom filter out of bounds")
    return end


def might_contain(data: bytes, key: bytes) -> bool:
    """Whether a segment's bloom filter lets a key be there."""
    end = _body_end(data)
    bits, hashes = struct.unpack_from("<ii", data, end)
    own = data[end + 8 : len(data) - 16]
    return all(p >> 3 < len(own) and own[p >> 3] >> (p & 7) & 1 for p in bloom_places(key, bits, hashes))


def segment_pairs(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    end, at = _body_end(data), 0
    while at < end:
        k, v = struct.unpack_from("<ii", data, at)
        if k < 0 or v < 0 or at + 8 + k + v > end:
            raise CorruptFile(f"record at {at}")
        yield data[at + 8 : at + 8 + k], data[at + 8 + k : at + 8 + k + v]
        at += 8 + k + v


def log_batch(pairs: Iterable[tuple[bytes, bytes]]) -> bytes:
    """A committed batch of a write-ahead log."""
    puts = [struct.pack("<iiiq", PUT, len(k), len(v), zlib.crc32(k + v)) + k + v for k, v in pairs]
    return struct.pack("<i", BEGIN) + b"".join(puts) + struct.pack("<i", COMMIT)


def log_pairs(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The pairs of committed batches, up to the first bytes that make no sense."""
    at, held = 0, []
    while at + 4 <= len(data):
        (mark,) = struct.unpack_from("<i", data, at)
        at += 4
        if mark == BEGIN:
            held = []
        elif mark == COMMIT:
            yield from held
            held = []
        elif mark == PUT:
            if at + 16 > len(data):
                return
            k, v, crc = struct.unpack_from("<iiq", data, at)
            at += 16
            if not (0 <= k <= LARGEST and 0 <= v <= LARGEST) or at + k + v > len(data):
                return
            key, value = data[at : at + k], data[at + k : at + k + v]
            if zlib.crc32(key + value) != crc:
                return
            held.append((key, value))
            at += k + v
        else:
            return


PAIRS = "path string, position long, key binary, value binary"


def decode(files: DataFrame, pairs: Callable[[bytes], Iterator[tuple[bytes, bytes]]], skip_corrupt: bool = False) -> DataFrame:
    """(path, position, key, value) of files (path, content)."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b["path"].to_pylist(), b["content"], strict=True):
                keys, values, n = [], [], 0

                def flush():
                    return pa.RecordBatch.from_arrays([pa.array([path] * len(keys), pa.string()), pa.array(range(n - len(keys), n), pa.int64()), pa.array(keys, pa.binary()), pa.array(values, pa.binary())], ["path", "position", "key", "value"])  # noqa: B023

                try:
                    for k, v in pairs(data.as_buffer().to_pybytes()):
                        keys.append(k)
                        values.append(v)
                        n += 1
                        if len(keys) == CHUNK:
                            yield flush()
                            keys, values = [], []
                except CorruptFile:
                    if not skip_corrupt:
                        raise
                if keys:
                    yield flush()

    return files.select("path", "content").mapInArrow(run, PAIRS)


def encode(rows: DataFrame, make: Callable[[list[tuple[bytes, bytes]]], bytes], pairs_each: int = 100_000) -> DataFrame:
    """(path, content): files of up to pairs_each pairs from each partition's rows (key, value), in their order."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held = TaskContext.get().partitionId(), 0, []

        def file():
            return pa.RecordBatch.from_arrays([pa.array([f"{part}_{n}"]), pa.array([make(held)], pa.binary())], ["path", "content"])

        for b in batches:
            held += zip(b["key"].to_pylist(), b["value"].to_pylist(), strict=True)
            while len(held) > pairs_each:
                rest, held = held[pairs_each:], held[:pairs_each]
                yield file()
                n, held = n + 1, rest
        if held:
            yield file()

    return rows.select("key", "value").mapInArrow(run, "path string, content binary")


def _read(spark: SparkSession, paths: str | list[str], pairs, skip_corrupt: bool) -> DataFrame:
    return decode(spark.read.format("binaryFile").load(paths), pairs, skip_corrupt)


def read_segments(spark: SparkSession, paths: str | list[str], skip_corrupt: bool = False) -> DataFrame:
    """(path, position, key, value) of segment files; corrupt ones are an error, or are skipped whole if found so before their first record."""
    return _read(spark, paths, segment_pairs, skip_corrupt)


def read_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, position, key, value) of what write-ahead logs have committed."""
    return _read(spark, paths, log_pairs, False)


def file_number(path: str):
    """A Column: the last number in a file's name, by which segments are ordered (10 after 2)."""
    return F.regexp_extract(F.element_at(F.split(F.col(path), "/"), -1), r"(\d+)\D*$", 1).cast("long")
