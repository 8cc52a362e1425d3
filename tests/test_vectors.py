import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.functions import vectors as V
from strata.operators import vectors as O


def found(coll, q, k=1, **kw):
    return [(r["id"], round(r["score"], 4)) for r in coll.search(q, k, **kw).collect()]


CASES = [
    ({"v": [1, 2, 3]}, [1, 2, 3], [("v", 1.0)]), ({"v": [1, 0]}, [0, 1], [("v", 0.0)]), ({"v": [1, 1]}, [-1, -1], [("v", -1.0)]),
    ({"v": [1, 0]}, [0.5, math.sqrt(3) / 2], [("v", 0.5)]), ({"v": [1, 1]}, [100, 100], [("v", 1.0)]), ({"v": [1, 1]}, [-1, 1], [("v", 0.0)]),
    ({"pos": [5], "neg": [-5]}, [10], [("pos", 1.0), ("neg", -1.0)]), ({"v": [1e-15, 1e-15]}, [1e-15, 1e-15], [("v", 1.0)]), ({"v": [1e20, 1e20]}, [1e20, 1e20], [("v", 1.0)]),
    ({"n": [math.nan, 1]}, [1, 1], []), ({"v2d": [1, 0]}, [1, 0, 1], []), ({"zero": [0, 0], "normal": [1, 1]}, [0, 0], [("normal", 0.0), ("zero", 0.0)]),
    ({"A": [1, 0], "B": [0, 1], "C": [1, 0], "D": [-1, 0]}, [1, 0], [("A", 1.0), ("C", 1.0), ("B", 0.0), ("D", -1.0)]),
]


@pytest.mark.parametrize(("stored", "query", "want"), CASES)
def test_geometry(db, stored, query, want):
    c = db.vectors("v")
    c.insert_batch(stored)
    assert found(c, query, 4) == want


def test_top_k_overwrite_delete_and_empty(db):
    c = db.vectors("v")
    assert found(c, [1, 2], 5) == [] and c.count() == 0
    c.insert_batch({f"v{i}": [10 - i, i] for i in range(10)})
    assert [i for i, _ in found(c, [1, 0], 3)] == ["v0", "v1", "v2"]
    assert found(c, [1, 0], 0) == []
    c.insert("v0", [0, 1])
    assert found(c, [1, 0], 1)[0][0] == "v1" and c.count() == 10
    c.delete("v1")
    assert found(c, [1, 0], 1)[0][0] == "v2"
    c.compact()
    assert found(c, [1, 0], 1)[0][0] == "v2" and c.count() == 9


def brute(vectors, q, k):
    out = []
    for i, v in vectors.items():
        if len(v) == len(q):
            n = np.linalg.norm(v) * np.linalg.norm(q)
            out.append((round(float(np.dot(v, q) / n) if n else 0.0, 9), i))
    return [(i, s) for s, i in sorted(out, key=lambda x: (-x[0], x[1]))[:k]]


@pytest.mark.parametrize("block", [1024, 3])
def test_batches_of_queries_both_ways(db, spark, monkeypatch, block):
    monkeypatch.setattr(O, "BLOCK", block)
    rng = random.Random(3)
    vectors = {f"i{n}": [float(rng.randint(-2, 2)) for _ in range(3 if n % 7 else 2)] for n in range(150)}
    c = db.vectors("v")
    c.insert_batch(vectors)
    queries = {f"q{n}": [float(rng.randint(-2, 2)) for _ in range(3 if n % 4 else 2)] for n in range(11)}
    got = {}
    for r in c.search_batch(queries.items(), 6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 9)))
    for q, v in queries.items():
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in brute(vectors, v, 6)])
        assert {i for i, s in got[q] if s > got[q][-1][1] + 1e-6} == {i for i, s in brute(vectors, v, 6) if s > got[q][-1][1] + 1e-6}


def test_functions(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = rows.select(V.magnitude(F.col("a")).alias("m"), V.dot(F.col("a"), F.col("b")).alias("d"), V.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(5.0, 25.0, 1.0), (1.0, None, -2.0), (0.0, 0.0, 0.0)]
    s = spark.createDataFrame([(1.0,), (-1.0,), (-2.0,), (math.nan,)], "s double")
    assert {r["s"] for r in s.where(V.counts(F.col("s"))).collect()} == {1.0, -1.0}


def test_index_is_exact_with_all_cells_and_has_recall_with_few(spark, db, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    c = db.vectors("e")
    c.insert_batch(e)
    index = c.build_index(16)
    q = [r["embedding"] for r in e.orderBy("id").limit(3).collect()]
    for v in q:
        assert found(c, v, 5, mode="ann", nprobe=16) == found(c, v, 5)
    queries = e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    pairs = lambda df: {(r["query_id"], r["id"]) for r in df.collect()}
    exact = pairs(c.search_batch(queries, 5))
    assert pairs(index.top_k(queries, 5, nprobe=16)) == exact
    assert 1 <= index.nprobe <= 16 and len(pairs(index.top_k(queries, 5)) & exact) >= 0.9 * len(exact)


def test_cells_and_queries_in_many_parts(spark, monkeypatch):
    from strata.operators import vectors as VV

    monkeypatch.setattr(VV, "SPLIT_ROWS", 100)
    monkeypatch.setattr(VV, "BLOCK", 7)
    x = np.random.default_rng(3).standard_normal((600, 8))
    x[:300] = x[0] + 0.01 * x[:300]  # a cell with half of all rows
    v = spark.createDataFrame([(f"{i}", r.tolist()) for i, r in enumerate(x)], "id string, embedding array<double>")
    queries = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    index = VV.CellIndex.build(v, cells=6)
    assert index.split == 6 and index.table.count() == 600
    want = {q: [i for i, _ in brute({str(i): r.tolist() for i, r in enumerate(x)}, x[int(q)].tolist(), 4)] for q in (str(i) for i in range(0, 600, 20))}
    for df in (index.top_k(queries, 4, nprobe=6), VV.top_k(v, queries, 4)):
        got = {}
        for r in df.orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        assert got == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def many(spark, monkeypatch):
    """Vectors, more queries than a block, and the queries' answers."""
    monkeypatch.setattr(O, "BLOCK", 7)
    monkeypatch.setattr(O, "STRIP", 32)
    x = np.random.default_rng(6).standard_normal((300, 8))
    v = spark.createDataFrame([(f"{i}", r.tolist()) for i, r in enumerate(x)], "id string, embedding array<double>")
    want = {str(i): [n for n, _ in brute({str(j): r.tolist() for j, r in enumerate(x)}, x[i].tolist(), 4)] for i in range(0, 300, 10)}
    return x, v, v.where("id % 10 = 0").select(F.col("id").alias("query_id"), "embedding"), want


def answers(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    return got


@pytest.mark.parametrize("group", [1 << 20, 1000])
def test_many_queries_are_no_join(many, monkeypatch, group):
    _, v, queries, want = many
    monkeypatch.setattr(O, "GROUP", group)
    found = O.top_k(v, queries, 4)
    assert answers(found) == want and "Join" not in plan(found)


def test_scores_of_a_batch_are_bounded():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(2)
    best, x = O._Best(rng.standard_normal((1024, 16)), 5), rng.standard_normal((10_000, 16))
    tracemalloc.start()
    try:
        best.add(pa.array([str(i) for i in range(len(x))]), x)
        assert tracemalloc.get_traced_memory()[1] < 100e6  # the scores of all of the batch take 82 MB, and were copied
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("group", [1 << 20, 1000])
def test_many_queries_in_all_cells_are_no_join(many, monkeypatch, group):
    _, v, queries, want = many
    monkeypatch.setattr(O, "GROUP", group)
    found = O.CellIndex.build(v, cells=6).top_k(queries, 4, nprobe=6)
    assert answers(found) == want and "Join" not in plan(found)


@pytest.mark.parametrize("group", [1 << 20, 1000])
def test_many_queries_in_few_cells_are_no_join(many, monkeypatch, group):
    x, v, queries, _ = many
    monkeypatch.setattr(O, "GROUP", group)
    index = O.CellIndex.build(v, cells=6)
    found = index.top_k(queries, 4, nprobe=2)
    cell = {r["id"]: r["cell"] for r in index.table.collect()}
    want = {}
    for r in queries.collect():
        near = set(index.probes(r["embedding"], 2))
        want[r["query_id"]] = [n for n, _ in brute({str(j): y.tolist() for j, y in enumerate(x) if cell[str(j)] in near}, r["embedding"], 4)]
    assert answers(found) == want and "Join" not in plan(found)


def test_few_probes_are_enough_for_groups(spark, db):
    gen = np.random.default_rng(1)
    x = np.repeat(gen.standard_normal((20, 16)), 50, axis=0) + 0.05 * gen.standard_normal((1000, 16))
    c = db.vectors("g")
    c.insert_batch({f"{i}": v.tolist() for i, v in enumerate(x)})
    index = c.build_index(20)
    assert index.nprobe <= 5
    hits = [len({i for i, _ in found(c, x[i], 5)} & {i for i, _ in found(c, x[i], 5, mode="ann")}) for i in (0, 333, 999)]
    assert sum(hits) >= 0.9 * 15


def test_search_keeps_k_rows_a_task(spark, db):
    c = db.vectors("v")
    c.insert_batch({str(i): [float(i), 1.0] for i in range(50)})
    plan = c.search([1.0, 0.0], 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_search_by_the_index_has_later_writes(spark, tmp_path):
    from strata.database import Database

    v = Database(spark, str(tmp_path / "db")).vectors("late")
    rng = np.random.default_rng(4)
    v.insert_batch({f"v{i}": rng.standard_normal(8).tolist() for i in range(60)})
    v.build_index(cells=4)
    ask = [1.0] * 8
    v.insert("new", [2.0] * 8)
    best = v.search(ask, 3, nprobe=4).collect()[1]["id"]
    v.delete(best)
    v.insert("v0", [1.0] * 7 + [0.9])
    ids = lambda: ([r["id"] for r in v.search(ask, 5, "ann", nprobe=4).collect()], [r["id"] for r in v.search(ask, 5).collect()])
    got, want = ids()
    assert got == want and got[:2] == ["new", "v0"] and best not in got
    v.compact()
    got, want = ids()
    assert got == want


def test_many_writes_are_compacted(spark, tmp_path, monkeypatch):
    from strata.database import Database
    from strata.sources import log

    monkeypatch.setattr(log, "COMPACT_AT", 3)
    v = Database(spark, str(tmp_path / "db")).vectors("many")
    for i in range(7):
        v.insert(f"v{i % 5}", [float(i), 1.0])
        assert len(v.log.store.segments(v.log.entity)) < 3
    assert sorted((r["id"], r["embedding"][0]) for r in v.df().collect()) == [("v0", 5.0), ("v1", 6.0), ("v2", 2.0), ("v3", 3.0), ("v4", 4.0)]
