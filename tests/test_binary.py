import struct
import zlib

import pytest

from strata.sources import binary as B

PAIRS = [(b"a", b"1"), (b"b", b""), ("é".encode(), b"\x00\xff" * 9), (b"\xff\xff", b"z")]


def write(path, data):
    path.write_bytes(data)
    return str(path)


def test_segments(spark, tmp_path):
    for n in (2, 10):
        write(tmp_path / f"segment_{n}.sst", B.segment([*PAIRS, (b"\xff\xff\xff", str(n).encode())]))
    rows = B.read_segments(spark, str(tmp_path))
    got = sorted((r["path"][-6:], r["position"], bytes(r["key"]), bytes(r["value"])) for r in rows.collect())
    assert len(got) == 10 and [(k, v) for p, _, k, v in got if p == "_2.sst"][:4] == PAIRS
    newest = rows.select("key", "value", B.file_number("path").alias("n")).groupBy("key").agg({"n": "max"})
    assert {r["max(n)"] for r in newest.collect()} == {10}
    data = B.segment(PAIRS)
    assert all(B.might_contain(data, k) for k, _ in PAIRS) and not all(B.might_contain(data, f"x{i}".encode()) for i in range(20))
    with pytest.raises(ValueError):
        B.segment([(b"b", b""), (b"a", b"")])


def test_corrupt_segments(spark, tmp_path):
    good = B.segment(PAIRS)
    write(tmp_path / "a.sst", good[:-4] + b"abcd")
    with pytest.raises(Exception, match="wrong magic number"):
        B.read_segments(spark, str(tmp_path)).collect()
    write(tmp_path / "b.sst", good)
    write(tmp_path / "c.sst", b"short")
    assert B.read_segments(spark, str(tmp_path), skip_corrupt=True).count() == len(PAIRS)
    write(tmp_path / "d.sst", good[:-8] + struct.pack("<ii", 999, B.MAGIC))
    with pytest.raises(Exception, match="version 999"):
        B.read_segments(spark, str(tmp_path), skip_corrupt=True).collect()


def test_logs_end_at_the_first_nonsense(spark, tmp_path):
    two = B.log_batch(PAIRS[:2]) + B.log_batch(PAIRS[2:])
    wal = lambda data: [(bytes(r["key"]), bytes(r["value"])) for r in B.read_logs(spark, write(tmp_path / "x.wal", data)).orderBy("position").collect()]
    assert wal(two) == PAIRS
    assert wal(two[:-5]) == PAIRS[:2]  # the last batch isn't committed
    assert wal(two + b"\xba\xad\xf0\x0d") == PAIRS
    assert wal(b"") == [] and wal(two + struct.pack("<iii", B.PUT, -1, 5)) == PAIRS
    wrong = struct.pack("<i", B.BEGIN) + struct.pack("<iiiq", B.PUT, 1, 1, zlib.crc32(b"other")) + b"kv" + struct.pack("<i", B.COMMIT)
    assert wal(two + wrong + B.log_batch([(b"late", b"1")])) == PAIRS
    assert wal(struct.pack("<i", B.BEGIN) + B.log_batch(PAIRS)) == PAIRS  # a begun batch is dropped by the next


def test_a_log_can_be_put_into_a_store(spark, tmp_path, db):
    rows = B.read_logs(spark, write(tmp_path / "x.wal", B.log_batch([(b"a", b"1")]) + B.log_batch([(b"a", b"2"), (b"b", b"3"), (b"b", b"")])))
    db.kv.write(rows, rows["position"])
    assert db.kv.get(b"a") == b"2" and db.kv.get(b"b") is None


def test_tables_become_files_and_come_back(spark):
    rows = spark.createDataFrame([(f"k{i:04}".encode(), str(i).encode()) for i in range(950)], "key binary, value binary")
    files = B.encode(rows.repartitionByRange(3, "key").sortWithinPartitions("key"), B.segment, 100)
    assert files.count() >= 10
    assert sorted((bytes(r["key"]), bytes(r["value"])) for r in B.decode(files, B.segment_pairs).collect()) == [(f"k{i:04}".encode(), str(i).encode()) for i in range(950)]
    assert B.decode(B.encode(rows, B.log_batch, 7), B.log_pairs).count() == 950
