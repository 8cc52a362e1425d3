import pytest
from pyspark.sql import functions as F

from strata.database import Database
from strata.functions import serde

USER = "email string, age int"


def test_upsert_delete_and_missing(db):
    users = db.collection("users", USER)
    users.insert("u1", email="a@x", age=25)
    users.insert("u1", email="a@x", age=26)
    assert users.get("u1")["age"] == 26 and users.count() == 1
    users.delete("u1")
    users.delete("u1", "ghost")
    assert users.get("u1") is None and users.get("ghost") is None


def test_nested_documents_and_strange_text(db):
    schema = "meta map<string,string>, tags array<string>, embedded struct<id:string,email:string,age:int>, note string"
    c = db.collection("complex", schema)
    note = "Alice O'Neil \n \t \U0001f600 (Emoji) \x01"
    c.insert("c1", meta={"a": "1"}, tags=["x", "y"], embedded={"id": "u", "email": "e", "age": 3}, note=note)
    c.insert("user:123:settings:v1", note="A" * 10_000)
    r = c.get("c1")
    assert r["meta"] == {"a": "1"} and r["tags"] == ["x", "y"] and r["embedded"].asDict() == {"id": "u", "email": "e", "age": 3} and r["note"] == note
    assert len(c.get("user:123:settings:v1")["note"]) == 10_000
    assert [x["id"] for x in c.by_id_prefix("user:123").collect()] == ["user:123:settings:v1"]
    assert c.get("user:123:settings:v1")["embedded"] is None


def test_index_follows_the_current_value(db):
    p = db.collection("products", "category string, price double")
    p.create_index("category", F.col("category"))
    p.insert_batch([{"id": "p1", "category": "Electronics", "price": 1.0}, {"id": "p2", "category": "Electronics", "price": 2.0}, {"id": "p3", "category": "Books", "price": 3.0}])
    found = lambda v: {r["id"] for r in p.by_index("category", v).collect()}
    assert found("Electronics") == {"p1", "p2"} and found("Books") == {"p3"} and not found("Food")
    p.insert("p1", category="Books, old", price=1.0)
    p.insert("p1", category="Books, old", price=1.0)
    assert found("Electronics") == {"p2"} and found("Books, old") == {"p1"}
    assert {tuple(r) for r in p.index_table("category").collect()} == {("Books, old", "p1"), ("Electronics", "p2"), ("Books", "p3")}


def test_prefixes_and_delete_all(db):
    c = db.collection("c", "v int")
    c.delete_all()
    assert db.version() == 0
    c.insert_batch([{"id": i, "v": 1} for i in ("groupA:1", "groupA:2", "groupB:1")])
    assert {r["id"] for r in c.ids_by_prefix("groupA").collect()} == {"groupA:1", "groupA:2"}
    assert {r["id"] for r in c.ids_by_prefix("groupA:", remove_prefix=True).collect()} == {"1", "2"}
    c.delete_all()
    assert c.count() == 0 and c.get("groupA:1") is None


def test_schema_evolution(spark, db):
    db.collection("users", "name string").insert("u1", name="A")
    again = Database(spark, db.store.path)
    v2 = again.collection("users", "name string, email string", {"email": "unknown"})
    assert v2.get("u1")["email"] == "unknown"
    v2.insert("u2", name="B", email="b@x")
    assert Database(spark, db.store.path).collection("users", "email string", {"email": "unknown"}).get("u2").asDict() == {"id": "u2", "email": "b@x"}


def test_explicit_null_is_kept_where_a_missing_field_gets_its_default(db):
    c = db.collection("config", "theme string, version int", {"theme": "light", "version": 1})
    c.insert("c1", theme=None, version=2)
    c.insert("c2", version=3)
    got = {r["id"]: (r["theme"], r["version"]) for r in c.df().collect()}
    assert got == {"c1": (None, 2), "c2": ("light", 3)}


def test_required_field(db):
    db.collection("c", "a int").insert("x", a=1)
    with pytest.raises(Exception, match="required field b"):
        db.collection("c", "a int, b int", required=["b"]).get("x")


def test_json_and_csv(spark, db):
    c = db.collection("j", "name string, n int, tags array<string>", {"n": 7, "tags": ["none"]})
    texts = spark.createDataFrame([("a", '{"name":"A","x":1}'), ("b", '{"name":null,"n":null,"tags":["t"]}')], "id string, json string")
    c.insert_json(texts)
    assert {r["id"]: (r["name"], r["n"], r["tags"]) for r in c.df().collect()} == {"a": ("A", 7, ["none"]), "b": (None, None, ["t"])}
    with pytest.raises(Exception):
        c.insert_json(spark.createDataFrame([("c", "{broken")], "id string, json string"))
    assert c.count() == 2
    e = db.collection("employees", "name string, department string", codec=serde.CSV)
    e.insert("1", name="Ann, B", department='say "x"')
    assert e.get("1").asDict() == {"id": "1", "name": "Ann, B", "department": 'say "x"'}
    j = db.collection("coded", "name string, n int", codec=serde.json_codec({"n": 5}))
    j.insert("1", name="A", n=None)
    assert j.get("1")["n"] is None
    assert db.collection("coded", "name string, m int", codec=serde.json_codec({"m": 5})).get("1")["m"] == 5


def test_filters_and_projections_reach_the_scan(db):
    c = db.collection("p", "brand string, size int")
    c.insert_batch([{"id": str(i), "brand": "b", "size": i} for i in range(5)])
    c.compact()
    plan = c.df().where("brand = 'b'").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(brand,b)" in plan and "size" not in plan.split("ReadSchema")[1]
    assert "Exchange" not in plan


def test_a_table_is_one_batch(spark, db):
    c = db.collection("t", "v int")
    c.insert_batch(spark.range(1000).selectExpr("concat('k', id % 100) as id", "cast(id as int) as v"), order=F.col("v"))
    assert c.count() == 100 and c.get("k7")["v"] == 907
