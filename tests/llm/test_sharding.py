import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata.llm import queries, sharding


@given(st.integers(0, 200), st.integers(0, 9))
def test_fisher_yates_is_a_permutation(n, bucket):
    order = sharding.fisher_yates(n, 5, bucket)
    assert sorted(order) == list(range(n)) and (order == sharding.fisher_yates(n, 5, bucket)).all()


def test_permutations_are_even():
    seen = {}
    for b in range(6000):
        p = tuple(sharding.fisher_yates(3, 1, b))
        seen[p] = seen.get(p, 0) + 1
    assert len(seen) == 6 and all(850 < n < 1150 for n in seen.values())


def placed(df, shards, bucket_bytes=2000):
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    return sharding.place(sharding.shuffled(df, ["doc_id", "text"], size, 3, bucket_bytes), shards)


def plain(corpus):
    return sorted((str(i), str(t)) for i, t in corpus)


@pytest.mark.parametrize("shards", [1, 7, 24, 500])
def test_law_of_rows(table, corpus, shards):
    rows = placed(table(corpus), shards).collect()
    assert {"_mark", "_at", "_before", "_all", "_n", "score"} < set(rows[0].asDict())
    assert plain((r["doc_id"], r["text"]) for r in rows) == plain(corpus)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(i, [])) for i in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(corpus)


def test_order_does_not_follow_the_input_s_files(table, corpus):
    a, b = (sorted((str(r["doc_id"]), str(r["text"]), r["shard"], r["slot"]) for r in placed(table(corpus, clash=False, parts=p), 5).collect()) for p in (1, 6))
    assert a == b


def test_shuffle_mixes(table):
    rows = placed(table([(i, "t") for i in range(3000)], clash=False), 10, 10_000).collect()
    by = np.array([(r["shard"], r["slot"], r["doc_id"]) for r in rows])
    assert abs(np.corrcoef(by[:, 0] * 300 + by[:, 1], by[:, 2])[0, 1]) < 0.06


def test_repeated_rows_fill_no_bucket(table):
    """Ten thousand equal rows are spread like others, and the order still doesn't follow the input's files."""
    rows = [(7, "same")] * 3000 + [(i, f"t{i}") for i in range(1000)]
    size, got = F.octet_length("text") + 8, []
    for parts in (1, 5):
        cut = sharding.shuffled(table(rows, parts=parts), ["doc_id", "text"], size, 3, 5000, most=100)
        counts = [r["count"] for r in cut.groupBy("_bucket").count().collect()]
        assert sum(counts) == 4000 and max(counts) < 2.5 * np.mean(counts)
        got.append(sorted((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in sharding.place(cut, 7).collect()))
    assert got[0] == got[1]


def test_against_a_plain_two_pass_shuffle(spark, small):
    """Shards and slots of the query are those of a shuffle of each bucket in turn."""
    cut = queries.sharding.shuffled(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"), ["doc_id", "text"], F.octet_length("text") + 8, queries.SHARD_SEED).collect()
    order = [(r["doc_id"]) for r in sorted(cut, key=lambda r: (r["_bucket"], r["_place"]))]
    base, more = divmod(len(order), 24)
    want, at = {}, 0
    for shard in range(24):
        for slot in range(base + (shard < more)):
            want[order[at]] = (shard, slot)
            at += 1
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in queries.op3_sharding(spark, small).collect()} == want


def test_written_shards_are_in_slot_order(spark, table, corpus, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(placed(table(corpus, clash=False), 3), path)
    back = spark.read.parquet(path)
    assert plain((r["doc_id"], r["text"]) for r in back.collect()) == plain(corpus)
    for f in {r["f"] for r in back.select(F.input_file_name().alias("f")).distinct().collect()}:
        s = [r["slot"] for r in spark.read.parquet(f).collect()]
        assert s == sorted(s)


def test_no_rows_and_query(spark, table, small):
    assert placed(table([], clash=False), 4).collect() == []
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op3_sharding(spark, small).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t) + 8, zlib.crc32(t)) for i, t in docs.items()}
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None} and {r["shard"] for r in rows} == set(range(24))
