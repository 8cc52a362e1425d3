import random

import pytest
from pyspark.sql import functions as F

from strata.plans import algorithms as A


def ids(df):
    c = df.columns[0]
    return sorted(r[c] for r in df.collect())


@pytest.fixture
def store(db):
    return db.graph()


def edges(store, type, *pairs, weights=None):
    store.write([], [(s, t, type, {"weight": str(weights[i])} if weights else {}) for i, (s, t) in enumerate(pairs)])


def nodes(store, *names):
    store.write([(n, ["N"], {"name": n.title()}) for n in names], [])


def test_properties(store):
    store.write([("u1", ["Person"], {"city": "London", "user": "john_doe"}), ("u2", ["Person"], {"city": "London", "user": "johnny_bravo"}), ("u3", ["Person", "Admin"], {"city": "Paris"}), ("x", ["City"], {"city": "London"})], [])
    g = store.graph()
    assert ids(g.nodes_by_property("Person", "city", "London")) == ["u1", "u2"]
    assert ids(g.nodes_by_property("Person", "user", "john_doe")) == ["u1"]
    assert ids(g.nodes_by_property("Admin", "city", "Paris")) == ["u3"]
    assert g.node("u1")["properties"]["city"] == "London" and g.node("nobody") is None
    store.put_node("u1", ["Person"], {"city": "Paris:x"})
    store.remove_node("u2")
    g = store.graph()
    assert ids(g.nodes_by_property("Person", "city", "London")) == [] and ids(g.query().starting_with("Person", "city", "Paris:x").to_ids()) == ["u1"]


def test_edges_both_ways_loops_update_and_removal(store):
    nodes(store, "u1", "u2")
    edges(store, "KNOWS", ("u1", "u2"), weights=[1.0])
    edges(store, "LIKES", ("u1", "u1"))
    g = store.graph()
    assert ids(g.out_ids("u1", "KNOWS")) == ["u2"] and ids(g.in_ids("u2", "KNOWS")) == ["u1"] and ids(g.out_ids("u1", "LIKES")) == ["u1"]
    edges(store, "KNOWS", ("u1", "u2"), weights=[5.0])
    g = store.graph()
    assert [r["properties"]["weight"] for r in g.in_edges("u2", "KNOWS").collect()] == ["5.0"] == [r["properties"]["weight"] for r in g.out_edges("u1", "KNOWS").collect()]
    store.remove_edge("u1", "u2", "KNOWS")
    g = store.graph()
    assert not ids(g.out_ids("u1", "KNOWS")) and not ids(g.in_ids("u2", "KNOWS"))
    store.compact()
    assert ids(store.graph().out_ids("u1", "LIKES")) == ["u1"] and store.graph().edges.count() == 1


def test_traversals(store):
    nodes(store, "alice", "bob", "charlie", "dave", "eve")
    edges(store, "FOLLOWS", ("alice", "bob"), ("alice", "charlie"), ("bob", "dave"), ("charlie", "dave"), ("charlie", "eve"), ("eve", "alice"), ("dave", "ghost"))
    edges(store, "CREATED", ("bob", "post_b1"), ("charlie", "post_c1"))
    edges(store, "BLOCKED", ("alice", "dave"), ("alice", "eve"))
    g = store.graph()
    start = g.query().starting_with_ids("alice", "alice")
    assert ids(start.outbound("FOLLOWS").outbound("CREATED").to_ids()) == ["post_b1", "post_c1"]
    assert ids(start.outbound("FOLLOWS", hops=2).to_ids()) == ["dave", "eve"]
    assert ids(start.outbound("FOLLOWS", hops=3).to_ids()) == ["alice", "ghost"]
    assert ids(start.outbound("FOLLOWS", hops=3).to_nodes()) == ["alice"]
    assert ids(g.query().starting_with_ids("dave").inbound("FOLLOWS", hops=2).to_ids()) == ["alice"]
    blocked = g.out_ids("alice", "BLOCKED").withColumnRenamed("target_id", "id")
    assert ids(start.outbound("FOLLOWS", hops=2).excluding(blocked).to_ids()) == []
    assert ids(g.query().to_ids()) == [] and ids(g.query().to_nodes()) == []
    two = start.outbound("FOLLOWS")
    assert ids(two.filter_nodes(F.col("properties")["name"] == "Bob").to_ids()) == ["bob"]
    assert ids(two.filter_nodes(lambda n: n["properties"]["name"].startswith("C") and "N" in n["labels"]).to_ids()) == ["charlie"]
    assert ids(g.query().starting_with_ids("dave").outbound("FOLLOWS").filter_nodes(F.lit(True)).to_ids()) == []
    for bad in (0, -1):
        with pytest.raises(ValueError):
            start.outbound("FOLLOWS", hops=bad)
    assert {r["id"]: r["degree"] for r in g.degrees("FOLLOWS").collect()}["alice"] == 2


def test_transactions(store):
    with pytest.raises(KeyError), store.transaction() as t:
        t.put_node("a")
        t.put_edge("a", "b", "X")
        raise KeyError
    assert store.graph().nodes.count() == 0 and store.graph().edges.count() == 0
    with store.transaction() as t:
        t.put_node("a")
        t.rollback()
    assert store.store.version() == 0
    with pytest.raises(RuntimeError):
        t.put_node("b")
    with store.transaction() as t:
        t.put_node("a", ["L"], {"k": "1"})
        t.put_node("a", ["L"], {"k": "2"})
        t.put_edge("a", "b", "X")
    assert store.store.version() == 1  # nodes and edges together
    assert store.graph().node("a")["properties"] == {"k": "2"} and store.graph().node("b") is None
    assert ids(store.graph().query().starting_with_ids("a").outbound("X").to_ids()) == ["b"]
    with pytest.raises(RuntimeError):
        t.rollback()


def test_supernode(store, spark):
    e = spark.range(1, 10_001).selectExpr("concat('u', id) as source_id", "'celeb' as target_id", "'FOLLOWS' as type", "cast(map() as map<string,string>) as properties")
    store.write([], e)
    assert store.graph().in_ids("celeb", "FOLLOWS").count() == 10_000


@pytest.mark.parametrize("local", [A.LOCAL, -1])
def test_breadth_first(store, local):
    nodes(store, "A", "B", "C", "D", "E")
    edges(store, "T", ("A", "B"), ("B", "C"), ("A", "D"), ("C", "A"), ("D", "ghost"), ("ghost", "E"), ("X", "A"))
    g = store.graph()
    got = {r["id"]: r["depth"] for r in A.bfs(g, "A", "T", local).collect()}
    assert got == {"A": 0, "B": 1, "D": 1, "C": 2}
    assert A.bfs(g, "ghost", "T", local).count() == 0
    assert {r["id"] for r in A.bfs(g, "E", "T", local).collect()} == {"E"}
    assert [v for v, _ in A.dfs(g, "A", "T", local)] == ["A", "B", "C", "D"]
    assert list(A.dfs(g, "ghost", "T", local)) == [] and list(A.dfs(g, "E", "T", local)) == [("E", 0)]


@pytest.mark.parametrize("local", [A.LOCAL, -1])
def test_shortest_path(store, local):
    edges(store, "R", ("A", "B"), ("B", "C"), ("A", "C"), ("C", "D"), weights=[1, 1, 10, "nonsense"])
    edges(store, "Z", ("s", "a"), ("a", "b"), ("b", "a"), ("b", "t"), weights=[1, 0, 0, 0])
    edges(store, "N", ("A", "B"), weights=[-1])
    g = store.graph()
    path = A.shortest_path(g, "A", "C", "R", local=local)
    assert [(s, t) for s, t, _ in path] == [("A", "B"), ("B", "C")] and path[-1][2] == 2.0
    assert A.shortest_path(g, "A", "D", "R", local=local)[-1] == ("C", "D", 3.0)
    assert A.shortest_path(g, "A", "D", "R", "cost", local=local)[-1][2] == 2.0  # no such property: 1 each
    assert A.shortest_path(g, "A", "A", "R", local=local) == [] and A.shortest_path(g, "C", "A", "R", local=local) is None and A.shortest_path(g, "none", "A", "R", local=local) is None
    assert [(s, t) for s, t, _ in A.shortest_path(g, "s", "t", "Z", local=local)] == [("s", "a"), ("a", "b"), ("b", "t")]
    with pytest.raises(Exception, match="negative weight"):
        A.shortest_path(g, "A", "B", "N", local=local)


def test_both_ways_agree_on_random_graphs(store):
    rng = random.Random(5)
    pairs = sorted({(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(90)})
    edges(store, "E", *pairs, weights=[rng.randrange(4) for _ in pairs])
    g = store.graph()
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(A.distances(g, "n1", "E")) == rows(A.distances(g, "n1", "E", local=-1))


def test_depth_first_beyond_local_asks_no_node_at_a_time(store, monkeypatch):
    monkeypatch.setattr(A, "STRIP", 40)
    rng = random.Random(8)
    names = [f"n{i}" for i in range(60)]
    nodes(store, *names)
    edges(store, "E", *sorted({(rng.choice(names), rng.choice([*names, "ghost"])) for _ in range(150)}), *[("n7", f"n{i}") for i in range(0, 60, 2)])
    g = store.graph()
    to, order, left = {}, [], ["n7"]
    for s, t in g.edges.select("source_id", "target_id").collect():
        to.setdefault(s, set()).add(t)
    while left:
        v = left.pop()
        if v in names and v not in order:
            order.append(v)
            left += sorted(to.get(v, ()), reverse=True)

    def ask(*a):
        raise AssertionError("a job for each node")

    monkeypatch.setattr(type(g), "out_ids", ask)
    assert len(order) > 40
    for local in (A.LOCAL, -1):
        assert list(A.dfs(g, "n7", "E", local)) == [(v, i) for i, v in enumerate(order)]
    assert A.dfs_table(g, "ghost", "E", -1).count() == 0


def test_depth_first_set_beyond_local(spark, small, monkeypatch):
    from strata import catalog

    monkeypatch.setattr(A, "STRIP", 400)
    g = catalog.follows(spark, small)
    assert ids(A.dfs_table(g, "u0", "FOLLOWS", local=-1).select("id")) == ids(A.bfs(g, "u0", "FOLLOWS").select("id"))


@pytest.mark.parametrize("local", [A.LOCAL, -1])
def test_page_rank(store, spark, local):
    edges(store, "L", ("A", "B"), ("B", "A"))
    edges(store, "M", ("A", "B"), ("B", "C"), ("A", "out"), ("out", "A"), ("C", "S"))
    g, seeds = store.graph(), lambda *s: spark.createDataFrame([(x,) for x in s], "id string")
    rank = {r["id"]: r["rank"] for r in A.page_rank(g, seeds("A", "B", "A"), "L", 20, local=local).collect()}
    assert rank == pytest.approx({"A": 0.5, "B": 0.5})
    rank = {r["id"]: r["rank"] for r in A.page_rank(g, seeds("A", "B", "C", "S", "alone"), "M", 10, local=local).collect()}
    assert sum(rank.values()) == pytest.approx(1.0) and rank["S"] > rank["C"] > rank["B"] > rank["A"] == pytest.approx(rank["alone"])
    assert A.page_rank(g, seeds(), "M", local=local).count() == 0


def test_hops_read_ids_only(store):
    nodes(store, "a", "b")
    edges(store, "E", ("a", "b"))
    plan = store.graph().query().starting_with_ids("a").outbound("E").to_ids()._jdf.queryExecution().executedPlan().toString()
    assert "labels" not in plan and "Window" not in plan
