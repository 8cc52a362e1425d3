import pytest

from strata.database import Database
from strata.operators.kv import prefix_end
from strata.sources.log import Segment


def test_put_get_overwrite_delete(db):
    db.kv.put(b"theme", b"light")
    db.kv.put(b"theme", b"dark")
    assert db.kv.get(b"theme") == b"dark"
    assert db.kv.get_string("theme") == "dark"
    assert db.kv.get(b"ghost") is None and db.kv.get_string("ghost") is None
    db.kv.delete(b"theme")
    db.kv.delete(b"never")
    assert db.kv.get(b"theme") is None


def test_empty_value_is_a_delete(db):
    db.kv.put(b"a", b"data")
    db.kv.put(b"a", b"")
    assert db.kv.get(b"a") is None and db.kv.df().count() == 0


def test_later_pair_of_a_batch_wins(db):
    db.kv.write_batch([(b"k", b"1"), (b"x", b"9"), (b"k", b"2"), (b"x", b"")])
    assert db.kv.get(b"k") == b"2" and db.kv.get(b"x") is None


def test_prefix_scan_and_order(db):
    rows = {b"log:2024:01": b"January Data", b"log:2024:02": b"February Data", b"log:2023:12": b"December", b"user:alice": b"x", b"log:2024:\xff\xff": b"end"}
    db.kv.write_batch(rows.items())
    got = {bytes(r["key"]): bytes(r["value"]) for r in db.kv.by_prefix(b"log:2024:").collect()}
    assert got == {k: v for k, v in rows.items() if k.startswith(b"log:2024:")}
    assert {bytes(r["key"]) for r in db.kv.keys_by_prefix(b"log:2023").collect()} == {b"log:2023:12"}
    assert [bytes(r["key"]) for r in db.kv.ordered().collect()] == sorted(rows)
    assert [bytes(r["key"]) for r in db.kv.tail(b"log:2024:02").collect()] == sorted(k for k in rows if k >= b"log:2024:02")
    assert len(db.kv.by_prefix(b"").collect()) == len(rows)
    assert prefix_end(b"a\xff") == b"b" and prefix_end(b"\xff") is None


def test_large_value_survives_reopening(spark, db):
    value = bytes(i % 255 for i in range(1 << 20))
    db.kv.put(b"blob", value)
    assert Database(spark, db.store.path).kv.get(b"blob") == value


def test_compaction_keeps_the_newest_and_drops_deletes(db):
    for k, v in ((b"a", b"1"), (b"b", b"1"), (b"a", b"2"), (b"b", b""), (b"c", b"3")):
        db.kv.put(k, v)
    before = db.version()
    db.kv.compact()
    assert len(db.store.segments("kv")) == 1
    assert {bytes(r["key"]): bytes(r["value"]) for r in db.kv.df().collect()} == {b"a": b"2", b"c": b"3"}
    assert {bytes(r["key"]) for r in db.kv.df(before).collect()} == {b"a", b"c"}  # an older version can still be read
    db.kv.put(b"a", b"4")
    db.kv.delete(b"c")
    assert {bytes(r["key"]): bytes(r["value"]) for r in db.kv.df().collect()} == {b"a": b"4"}
    assert db.kv.compact() and db.kv.compact() == db.version()
    db.store.clean()
    assert db.kv.get(b"a") == b"4" and len(db.store._versions.names()) == 1
    db.kv.put(b"b", b"5")
    assert db.kv.get(b"b") == b"5"


def test_numbers_of_segments_are_numeric(db):
    for i in range(12):
        db.kv.put(b"k", str(i).encode())
    assert db.kv.get(b"k") == b"11"


def test_two_writers_both_publish(db):
    kv = db.kv.log
    rows = db.spark.createDataFrame([(bytearray(b"a"), bytearray(b"1"))], "key binary, value binary")
    first, second = kv.stage(rows), kv.stage(rows.selectExpr("cast('b' as binary) as key", "value"))
    assert first.batch < second.batch
    db.store.publish([second])
    db.store.publish([first])
    assert db.kv.df().count() == 2 and db.version() == 2
    assert not db.store._versions.claim(f"{2:020d}.json", "other")


def test_unpublished_segments_are_not_seen_and_replaced_ones_are_guarded(db):
    db.kv.put(b"a", b"1")
    old = db.store.segments("kv")
    db.kv.log.stage(db.spark.createDataFrame([(bytearray(b"z"), bytearray(b"1"))], "key binary, value binary"))
    assert db.kv.df().count() == 1
    db.store.publish([], old)
    with pytest.raises(RuntimeError):
        db.store.publish([Segment("kv", "x", 9, True)], old)


def test_null_key_is_an_error(db):
    with pytest.raises(Exception, match="null key"):
        db.kv.log.append(db.spark.createDataFrame([(None, bytearray(b"1"))], "key binary, value binary"))
    assert db.version() == 0 and db.kv.df().count() == 0


def test_key_filter_reaches_the_scan(db):
    from pyspark.sql import functions as F

    for v in (b"1", b"2"):
        db.kv.write_batch([(b"user:1", v), (b"user:2", v)])
    plan = db.kv.by_prefix(b"user:1")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan
    plan = db.kv.keys_by_prefix(b"user:1")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedFilters") and F is not None


def test_drop_all(db):
    db.kv.put(b"a", b"1")
    db.drop_all()
    assert db.version() == 0 and db.kv.get(b"a") is None
