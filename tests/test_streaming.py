from pyspark.sql import functions as F

from strata.streaming.observe import latest_stream, observe_all, observe_by_id


def test_observe_by_id(db, tmp_path):
    c, other = db.collection("users", "age int"), db.collection("other", "age int")
    c.insert("u1", age=1)
    seen = []
    q = observe_by_id(c, "u1", lambda r: seen.append(None if r is None else r["age"]), str(tmp_path / "cp"), processingTime="0 seconds")
    try:
        assert seen == [1]
        c.insert("u2", age=9)
        other.insert("u1", age=7)
        c.insert("u1", age=2)
        c.insert("u1", age=2)
        c.compact()
        c.delete("u1")
        c.delete_all()
        q.processAllAvailable()
        assert seen == [1, 2, 2, None]
    finally:
        q.stop()


def test_observe_all_from_nothing(db, tmp_path):
    c, seen = db.collection("users", "age int"), []
    q = observe_all(c, lambda df: seen.append(sorted(r["id"] for r in df.collect())), str(tmp_path / "cp"), processingTime="0 seconds")
    try:
        c.insert("a", age=1)
        c.insert_batch([{"id": "b", "age": 1}, {"id": "c", "age": 1}])
        c.delete_all()
        q.processAllAvailable()
        assert seen == [[], ["a"], ["a", "b", "c"], []]
    finally:
        q.stop()


def test_latest_stream(spark, tmp_path, small):
    e = spark.read.parquet(f"{small}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).select("user_id", "event_id", "value")
    q = latest_stream(s, ["user_id"], "event_id").writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination()
    want = e.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    assert {tuple(r) for r in spark.table("latest").select("user_id", "event_id").collect()} == {tuple(r) for r in want.collect()}
