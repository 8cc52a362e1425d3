"""The test tables as pairs, collections, vectors and a graph; the queries over them, and their SQL.

Every query reads whole tables. SQL is for DuckDB over the same tables. Scores and
ranks are rounded to millionths, so that the order of additions doesn't show.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.database import Database
from strata.functions import serde
from strata.functions import vectors as V
from strata.operators import kv
from strata.operators.graph import Graph
from strata.operators.vectors import CellIndex, search, top_k
from strata.plans import algorithms as A
from strata.plans.traversal import two_hops_with_repeats
from strata.sources import binary
from strata.sources.lineage import settled, shared
from strata.sources.log import newest
from strata.streaming.observe import latest_stream, observe_all, observe_by_id

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def database(spark: SparkSession) -> Database:
    """A database of its own in the shared folder."""
    return Database(spark, f"{shared(spark).rstrip('/')}/strata-db-{uuid.uuid4().hex}")


def micro(c):
    return F.round(c * 1e6).cast("long")


# Key-value: events are puts by user, an error is a delete.

PUTS_SQL = "select concat('user:', user_id) as k, event_id, event_type, case when event_type = 'error' then '' else concat(event_type, ':', event_id) end as v from events"
LIVE_SQL = f"live as (select k, arg_max(v, event_id) as v from ({PUTS_SQL}) group by k having arg_max(v, event_id) <> '')"


def puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    value = F.when(F.col("event_type") == "error", "").otherwise(F.concat_ws(":", "event_type", F.col("event_id").cast("string")))
    return e.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).cast("binary").alias("key"), value.cast("binary").alias("value"), "event_id")


def _text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


@query(f"with {LIVE_SQL} select k as key, v as value from live")
def kv_latest_snapshot(spark, sf_dir):
    return _text(kv.live(puts(spark, sf_dir), F.col("event_id")))


@query(f"with {LIVE_SQL} select k as key, v as value from live where k = 'user:7'")
def kv_point_get(spark, sf_dir):
    return _text(kv.live(puts(spark, sf_dir), F.col("event_id")).where(F.col("key") == F.lit(b"user:7")))


@query(f"with {LIVE_SQL} select v as value from live where k = 'user:11'")
def kv_string_get(spark, sf_dir):
    return kv.live(puts(spark, sf_dir), F.col("event_id")).where(F.col("key") == F.lit(b"user:11")).select(F.col("value").cast("string").alias("value"))


@query(f"with {LIVE_SQL} select k as key, v as value from live where starts_with(k, 'user:1')")
def kv_prefix_scan(spark, sf_dir):
    return _text(kv.live(puts(spark, sf_dir), F.col("event_id")).where(kv.has_prefix(F.col("key"), b"user:1")))


@query(f"with {LIVE_SQL} select k as key from live where starts_with(k, 'user:1')")
def kv_prefix_keys(spark, sf_dir):
    return _text(kv.live(puts(spark, sf_dir), F.col("event_id")).where(kv.has_prefix(F.col("key"), b"user:1")).select("key"))


@query(f"with {LIVE_SQL} select k as key, v as value from live where k >= 'user:3'")
def kv_tail_scan(spark, sf_dir):
    return _text(kv.live(puts(spark, sf_dir), F.col("event_id")).where(F.col("key") >= F.lit(b"user:3")).orderBy("key"))


def _stored(spark: SparkSession, sf_dir: str) -> Database:
    """The puts in three batches of a store."""
    db, rows = database(spark), puts(spark, sf_dir)
    top = rows.agg((F.max("event_id") + 1).alias("n")).first()["n"] or 0
    for i in range(3):
        db.kv.write(rows.where((F.col("event_id") >= i * top // 3) & (F.col("event_id") < (i + 1) * top // 3)), F.col("event_id"))
    return db


@query(f"with {LIVE_SQL} select k as key, v as value from live")
def kv_store_batches(spark, sf_dir):
    return _text(_stored(spark, sf_dir).kv.df())


@query(f"with {LIVE_SQL} select k as key, v as value from live")
def compaction_equivalence(spark, sf_dir):
    db = _stored(spark, sf_dir)
    db.kv.compact()
    return _text(db.kv.df())


@query(f"with {LIVE_SQL}, after as (select k, v from live where not starts_with(k, 'user:2') union all select distinct k, 'late' from ({PUTS_SQL}) where starts_with(k, 'user:3') and k not in (select k from live)) select k as key, case when starts_with(k, 'user:3') then 'late' else v end as value from after")
def kv_write_after_compaction(spark, sf_dir):
    db, rows = _stored(spark, sf_dir), puts(spark, sf_dir)
    db.kv.compact()
    late = rows.where(kv.has_prefix(F.col("key"), b"user:2") | kv.has_prefix(F.col("key"), b"user:3")).select("key").distinct()
    db.kv.write(late.withColumn("value", F.when(kv.has_prefix(F.col("key"), b"user:3"), F.lit(b"late"))))
    return _text(db.kv.df())


@query(f"with {LIVE_SQL} select k as key, v as value from live")
def kv_segment_files(spark, sf_dir):
    """The puts of each user's newest event as sorted binary segments, read back."""
    rows = newest(puts(spark, sf_dir), ["key"], F.col("event_id")).select("key", "value")
    files = binary.encode(rows.repartitionByRange(3, "key").sortWithinPartitions("key"), binary.segment)
    return _text(binary.decode(files, binary.segment_pairs).where(F.octet_length("value") > 0).select("key", "value"))


@query("select concat('user:', user_id) as key, count(*) as writes from events group by 1")
def kv_log_replay(spark, sf_dir):
    """All puts as write-ahead logs, replayed."""
    files = binary.encode(puts(spark, sf_dir), binary.log_batch, 1000)
    return binary.decode(files, binary.log_pairs).groupBy(F.col("key").cast("string").alias("key")).agg(F.count("*").alias("writes"))


# Documents: parts by brand and number.

PART_SQL = "select concat(p_brand, ':', p_partkey) as id, p_name as name, p_brand as brand, p_size as size, p_retailprice as price from part"
PART = "name string, brand string, size int, price double"


def part_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.concat_ws(":", "p_brand", F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


def part_collection(spark: SparkSession, sf_dir: str):
    coll = database(spark).collection("parts", PART)
    coll.insert_batch(part_docs(spark, sf_dir))
    return coll


@query(f"select * from ({PART_SQL}) where id = 'Brand#17:1'")
def coll_get(spark, sf_dir):
    return part_collection(spark, sf_dir).df().where(F.col("id") == "Brand#17:1")


@query(PART_SQL)
def coll_all(spark, sf_dir):
    return part_collection(spark, sf_dir).all()


@query(f"select * from ({PART_SQL}) where starts_with(id, 'Brand#1')")
def coll_id_prefix(spark, sf_dir):
    return part_collection(spark, sf_dir).by_id_prefix("Brand#1")


@query(f"select substr(id, 8) as id from ({PART_SQL}) where starts_with(id, 'Brand#1')")
def coll_ids_prefix(spark, sf_dir):
    return part_collection(spark, sf_dir).ids_by_prefix("Brand#1", remove_prefix=True)


@query(f"select id, name from ({PART_SQL}) where brand = 'Brand#4'")
def coll_index_lookup(spark, sf_dir):
    coll = part_collection(spark, sf_dir)
    coll.create_index("brand", F.col("brand"))
    return coll.by_index("brand", "Brand#4").select("id", "name")


@query(f"select id, name, case when size % 2 = 0 then 'Brand#0' else brand end as brand from ({PART_SQL}) where case when size % 2 = 0 then 'Brand#0' else brand end in ('Brand#0', 'Brand#4')")
def coll_index_after_update(spark, sf_dir):
    coll = part_collection(spark, sf_dir)
    coll.create_index("brand", F.col("brand"))
    coll.insert_batch(part_docs(spark, sf_dir).where("size % 2 = 0").withColumn("brand", F.lit("Brand#0")))
    return coll.by_index("brand", "Brand#0").unionByName(coll.by_index("brand", "Brand#4")).select("id", "name", "brand")


@query(f"select id, case when size > 25 then 'new' else name end as name, brand, size, price from ({PART_SQL}) where size > 5")
def coll_upsert_then_read(spark, sf_dir):
    coll, docs = part_collection(spark, sf_dir), part_docs(spark, sf_dir)
    coll.insert_batch(docs.where("size > 25").withColumn("name", F.lit("new")))
    coll.log.append(docs.where("size <= 5").select("id"), "D")
    return coll.df()


@query(f"select id from ({PART_SQL}) where size = 3")
def coll_delete_all(spark, sf_dir):
    coll = part_collection(spark, sf_dir)
    coll.delete_all()
    coll.insert_batch(part_docs(spark, sf_dir).where("size = 3"))
    return coll.ids()


@query(f"select id, name, coalesce(cast(null as varchar), 'unknown') as maker from ({PART_SQL})")
def coll_schema_evolution(spark, sf_dir):
    db = database(spark)
    db.collection("parts", PART).insert_batch(part_docs(spark, sf_dir))
    return db.collection("parts", "name string, maker string", {"maker": "unknown"}).df()


EVENT_JSON = "select event_id, cast(json_extract(props, '$.k') as integer) as k, 'none' as note from events"


@query(EVENT_JSON)
def coll_json_nested(spark, sf_dir):
    from pyspark.sql import types as T

    doc = serde.decode_json(F.col("props"), T._parse_datatype_string("k int, note string"), {"note": "none"}, ["k"])
    return read(spark, sf_dir, "events").select("event_id", doc.alias("d")).select("event_id", "d.k", "d.note")


@query(f"select id, brand, price from ({PART_SQL}) where size < 10")
def coll_csv_codec(spark, sf_dir):
    coll = database(spark).collection("parts", "brand string, size int, price double", codec=serde.CSV)
    coll.insert_batch(part_docs(spark, sf_dir).select("id", "brand", "size", "price"))
    return coll.df().where("size < 10").select("id", "brand", "price")


@query("select concat(conv_id, ':', turn) as id, text from conversations where conv_id = 3")
def coll_composite_id(spark, sf_dir):
    coll = database(spark).collection("turns", "text string")
    rows = read(spark, sf_dir, "conversations")
    coll.insert_batch(rows.select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text"))
    return coll.by_id_prefix("3:")


# Vectors.


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding", "vec_id", "label")


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(stored_vectors(spark, sf_dir).where("vec_id = 0").first()["embedding"])


COSINE_SQL = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"


@query("select vec_id, cast(round(sqrt(list_inner_product(embedding::double[], embedding::double[])) * 1e6) as bigint) as magnitude from embeddings")
def vec_magnitude(spark, sf_dir):
    return stored_vectors(spark, sf_dir).select("vec_id", micro(V.magnitude(F.col("embedding"))).alias("magnitude"))


def _pairs(spark, sf_dir):
    v = stored_vectors(spark, sf_dir)
    q = F.array(*[F.lit(x).cast("float") for x in first_vector(spark, sf_dir)])
    return v.select("vec_id", "embedding", q.alias("q"))


@query("select b.vec_id, cast(round(list_inner_product(a.embedding::double[], b.embedding::double[]) * 1e6) as bigint) as dot from embeddings a, embeddings b where a.vec_id = 0")
def vec_dot(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", micro(V.dot(F.col("embedding"), F.col("q"))).alias("dot"))


@query(f"select b.vec_id, cast(round({COSINE_SQL} * 1e6) as bigint) as score from embeddings a, embeddings b where a.vec_id = 0")
def vec_cosine(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", micro(V.cosine(F.col("embedding"), F.col("q"))).alias("score"))


@query(f"select cast(b.vec_id as varchar) as id, cast(round({COSINE_SQL} * 1e6) as bigint) as score from embeddings a, embeddings b where a.vec_id = 0 order by {COSINE_SQL} desc, id limit 5")
def vec_topk_exact(spark, sf_dir):
    return search(stored_vectors(spark, sf_dir), first_vector(spark, sf_dir), 5).select("id", micro(F.col("score")).alias("score"))


TOPK_SQL = f"""with s as (select cast(a.vec_id as varchar) as query_id, cast(b.vec_id as varchar) as id, {COSINE_SQL} as c from embeddings a, embeddings b where a.vec_id % 20 = 0),
    r as (select *, row_number() over (partition by query_id order by c desc, id) as rank from s) select query_id, id, cast(round(c * 1e6) as bigint) as score, cast(rank as integer) as rank from r where rank <= 5"""


@query(TOPK_SQL)
def vec_topk_batch(spark, sf_dir):
    v = stored_vectors(spark, sf_dir)
    return top_k(v, v.where("vec_id % 20 = 0").select(F.col("id").alias("query_id"), "embedding"), 5).select("query_id", "id", micro(F.col("score")).alias("score"), "rank")


@query()
def vec_topk_ann(spark, sf_dir):
    """The queries of vec_topk_batch, from as many cells as the index was set to."""
    v = stored_vectors(spark, sf_dir)
    return CellIndex.build(v).top_k(v.where("vec_id % 20 = 0").select(F.col("id").alias("query_id"), "embedding"), 5).select("query_id", "id", micro(F.col("score")).alias("score"), "rank")


@query(TOPK_SQL)
def vec_topk_all_cells(spark, sf_dir):
    """The index with every cell probed, which is exact search."""
    v = stored_vectors(spark, sf_dir)
    index = CellIndex.build(v)
    found = index.top_k(v.where("vec_id % 20 = 0").select(F.col("id").alias("query_id"), "embedding"), 5, nprobe=len(index.centres))
    return found.select("query_id", "id", micro(F.col("score")).alias("score"), "rank")


@query("select count(*) as queries, true as enough from embeddings where vec_id % 20 = 0")
def vec_ann_recall(spark, sf_dir):
    """Whether the cells of vec_topk_ann hold nine tenths of the exact answers."""
    exact, got = vec_topk_batch(spark, sf_dir).select("query_id", "id"), vec_topk_ann(spark, sf_dir).select("query_id", "id", F.lit(1).alias("hit"))
    each = exact.join(got, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    return each.agg(F.count("*").alias("queries"), (F.sum("hits") >= 0.9 * F.sum("n")).alias("enough"))


@query("select cast(vec_id as varchar) as id from embeddings where vec_id % 2 = 1 and false")
def vec_dim_mismatch(spark, sf_dir):
    return search(stored_vectors(spark, sf_dir), [1.0, 0.0, 1.0], 5).select("id")


@query("select id, cast(0 as bigint) as score from (select cast(vec_id as varchar) as id from embeddings order by id limit 5)")
def vec_zero_query(spark, sf_dir):
    return search(stored_vectors(spark, sf_dir), [0.0] * 64, 5).select("id", micro(F.col("score")).alias("score"))


@query(f"select cast(b.vec_id as varchar) as id, cast(round({COSINE_SQL} * 1e6) as bigint) as score from embeddings a, embeddings b where a.vec_id = 0 and b.vec_id % 3 <> 0 order by {COSINE_SQL} desc, id limit 5")
def vec_store_delete(spark, sf_dir):
    coll, v = database(spark).vectors("v"), stored_vectors(spark, sf_dir)
    coll.insert_batch(v.select("id", "embedding"))
    coll.log.append(v.where("vec_id % 3 = 0").select("id"), "D")
    return coll.search(first_vector(spark, sf_dir), 5).select("id", micro(F.col("score")).alias("score"))


# The graph of the business tables, and that of consecutive events.


def _node(df: DataFrame, prefix: str, key: str, label: str, **props: str) -> DataFrame:
    p = [x for k, c in props.items() for x in (F.lit(k), F.col(c).cast("string"))]
    return df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.array(F.lit(label)).alias("labels"), F.create_map(*p).alias("properties"))


def _edge(df: DataFrame, source: tuple[str, str], target: tuple[str, str], type: str) -> DataFrame:
    end = lambda e: F.concat(F.lit(e[0]), F.col(e[1]).cast("string"))
    return df.select(end(source).alias("source_id"), end(target).alias("target_id"), F.lit(type).alias("type"), F.create_map().cast("map<string,string>").alias("properties"))


def business(spark: SparkSession, sf_dir: str) -> Graph:
    t = {n: read(spark, sf_dir, n) for n in ("region", "nation", "customer", "orders", "part", "supplier", "lineitem")}
    nodes = [
        _node(t["region"], "r", "r_regionkey", "Region", name="r_name"), _node(t["nation"], "n", "n_nationkey", "Nation", name="n_name"),
        _node(t["customer"], "c", "c_custkey", "Customer", name="c_name", segment="c_mktsegment"), _node(t["orders"], "o", "o_orderkey", "Order", status="o_orderstatus", priority="o_orderpriority"),
        _node(t["part"], "p", "p_partkey", "Part", brand="p_brand", type="p_type", size="p_size"), _node(t["supplier"], "s", "s_suppkey", "Supplier", name="s_name"),
    ]
    line = t["lineitem"]
    edges = [
        _edge(t["nation"], ("n", "n_nationkey"), ("r", "n_regionkey"), "IN_REGION"), _edge(t["customer"], ("c", "c_custkey"), ("n", "c_nationkey"), "IN_NATION"),
        _edge(t["supplier"], ("s", "s_suppkey"), ("n", "s_nationkey"), "IN_NATION"), _edge(t["orders"], ("c", "o_custkey"), ("o", "o_orderkey"), "PLACED"),
        _edge(line.select("l_orderkey", "l_partkey").distinct(), ("o", "l_orderkey"), ("p", "l_partkey"), "CONTAINS"), _edge(line.select("l_partkey", "l_suppkey").distinct(), ("p", "l_partkey"), ("s", "l_suppkey"), "SUPPLIED_BY"),
    ]

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    return Graph(union(nodes), union(edges))


FOLLOWS_SQL = "f as materialized (select concat('u', a.user_id) as s, concat('u', b.user_id) as t, min(1 + a.value) as w from events a join events b on b.event_id = a.event_id + 1 where a.user_id <> b.user_id group by 1, 2)"


def follows(spark: SparkSession, sf_dir: str) -> Graph:
    """Users, and an edge from each event's user to the next event's; weight: one more than the least value of such an event."""
    e = read(spark, sf_dir, "events")
    a = e.select(F.col("user_id").alias("a"), (F.col("event_id") + 1).alias("event_id"), "value")
    pairs = a.join(e.select("event_id", F.col("user_id").alias("b")), "event_id").where("a <> b").groupBy("a", "b").agg(F.min(1 + F.col("value")).alias("w"))
    edges = pairs.select(F.concat(F.lit("u"), F.col("a").cast("string")).alias("source_id"), F.concat(F.lit("u"), F.col("b").cast("string")).alias("target_id"), F.lit("FOLLOWS").alias("type"), F.create_map(F.lit("weight"), F.col("w").cast("string")).alias("properties"))
    nodes = e.select(F.col("user_id").cast("string").alias("i")).distinct().select(F.concat(F.lit("u"), "i").alias("id"), F.array(F.lit("User")).alias("labels"), F.create_map(F.lit("number"), F.col("i")).alias("properties"))
    return Graph(nodes, edges)


@query("select concat('c', c_custkey) as id, c_name as name from customer where c_custkey = 42")
def graph_get_node(spark, sf_dir):
    return business(spark, sf_dir).nodes.where(F.col("id") == "c42").select("id", F.col("properties")["name"].alias("name"))


@query("select concat('c', c_custkey) as id, c_name as name from customer where c_mktsegment = 'BUILDING'")
def graph_nodes_by_property(spark, sf_dir):
    return business(spark, sf_dir).nodes_by_property("Customer", "segment", "BUILDING").select("id", F.col("properties")["name"].alias("name"))


@query("select concat('c', o_custkey) as source_id, concat('o', o_orderkey) as target_id, 'PLACED' as type from orders where o_custkey = 42")
def graph_out_edges(spark, sf_dir):
    return business(spark, sf_dir).out_edges("c42", "PLACED").select("source_id", "target_id", "type")


@query("select concat('c', c_custkey) as source_id, 'n3' as target_id, 'IN_NATION' as type from customer where c_nationkey = 3 union all select concat('s', s_suppkey), 'n3', 'IN_NATION' from supplier where s_nationkey = 3")
def graph_in_edges(spark, sf_dir):
    return business(spark, sf_dir).in_edges("n3", "IN_NATION").select("source_id", "target_id", "type")


@query("select distinct concat('p', l_partkey) as target_id from lineitem where l_orderkey = 7")
def graph_out_ids(spark, sf_dir):
    return business(spark, sf_dir).out_ids("o7", "CONTAINS")


@query("select distinct concat('o', l_orderkey) as source_id from lineitem where l_partkey = 9")
def graph_in_ids(spark, sf_dir):
    return business(spark, sf_dir).in_ids("p9", "CONTAINS")


@query("select distinct concat('o', o_orderkey) as id from orders join customer on o_custkey = c_custkey where c_mktsegment = 'MACHINERY'")
def graph_1hop(spark, sf_dir):
    return business(spark, sf_dir).query().starting_with("Customer", "segment", "MACHINERY").outbound("PLACED").to_ids()


TWO_HOP_SQL = "select distinct concat('p', p_partkey) as id, p_brand as brand from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey where c_mktsegment = 'BUILDING'"


@query(TWO_HOP_SQL)
def graph_2hop(spark, sf_dir):
    nodes = business(spark, sf_dir).query().starting_with("Customer", "segment", "BUILDING").outbound("PLACED").outbound("CONTAINS").to_nodes()
    return nodes.select("id", F.col("properties")["brand"].alias("brand"))


@query("select distinct concat('c', o_custkey) as id from lineitem join orders on l_orderkey = o_orderkey where l_partkey = 9")
def graph_inbound(spark, sf_dir):
    return business(spark, sf_dir).query().starting_with_ids("p9").inbound("CONTAINS").inbound("PLACED").to_ids()


@query("select distinct concat('c', c.c_custkey) as id from customer c join nation n on c.c_nationkey = n.n_nationkey where n.n_regionkey = 1 union select distinct concat('s', s_suppkey) from supplier join nation on s_nationkey = n_nationkey where n_regionkey = 1")
def graph_inbound_from_region(spark, sf_dir):
    return business(spark, sf_dir).query().starting_with_ids("r1").inbound("IN_REGION").inbound("IN_NATION").to_ids()


@query("select distinct concat('o', b.l_orderkey) as id from lineitem a join lineitem b on a.l_partkey = b.l_partkey where a.l_orderkey = 7 and b.l_orderkey <> 7")
def graph_shared_interest(spark, sf_dir):
    g = business(spark, sf_dir)
    return g.query().starting_with_ids("o7").outbound("CONTAINS").inbound("CONTAINS").to_ids().where(F.col("id") != "o7")


@query(f"with {FOLLOWS_SQL} select distinct y.t as id from f x join f y on x.t = y.s where x.s = 'u1' and y.t <> 'u1' and y.t not in (select t from f where s = 'u1')")
def graph_fof_excluding(spark, sf_dir):
    g = follows(spark, sf_dir)
    direct = g.out_ids("u1", "FOLLOWS").withColumnRenamed("target_id", "id")
    return g.query().starting_with_ids("u1").outbound("FOLLOWS", hops=2).excluding(direct).to_ids().where(F.col("id") != "u1")


@query("select distinct concat('p', p_partkey) as id from lineitem join part on p_partkey = l_partkey where l_orderkey < 50 and p_size > 30")
def graph_filter_nodes(spark, sf_dir):
    g = business(spark, sf_dir)
    return g.query().starting_with_ids(*[f"o{i}" for i in range(50)]).outbound("CONTAINS").filter_nodes(F.col("properties")["size"].cast("int") > 30).to_ids()


@query("select distinct concat('p', p_partkey) as id from lineitem join part on p_partkey = l_partkey where l_orderkey < 50 and p_brand like '%1'")
def graph_filter_nodes_python(spark, sf_dir):
    from strata.sources.lineage import ship

    g = business(ship(spark), sf_dir)
    return g.query().starting_with_ids(*[f"o{i}" for i in range(50)]).outbound("CONTAINS").filter_nodes(lambda n: n["properties"]["brand"].endswith("1")).to_ids()


@query("select distinct concat('o', o_orderkey) as id, o_orderstatus as status from orders join customer on o_custkey = c_custkey where c_nationkey = 3 and o_orderkey % 2 = 0")
def graph_to_nodes_dangling(spark, sf_dir):
    g = business(spark, sf_dir)
    kept = Graph(g.nodes.where(~(F.col("id").startswith("o") & (F.substring("id", 2, 20).try_cast("long") % 2 != 0))), g.edges)
    nodes = kept.query().starting_with_ids("n3").inbound("IN_NATION").outbound("PLACED").to_nodes()
    return nodes.select("id", F.col("properties")["status"].alias("status"))


@query(f"with {FOLLOWS_SQL} select y.t as id from f x join f y on x.t = y.s where x.s = 'u1'")
def graph_two_hop_bag(spark, sf_dir):
    g = follows(spark, sf_dir)
    return two_hops_with_repeats(g, g.query().starting_with_ids("u1").to_ids(), "FOLLOWS")


@query("select id, count(*) as degree from (select distinct concat('p', l_partkey) as id, l_orderkey from lineitem) group by id")
def graph_degree(spark, sf_dir):
    return business(spark, sf_dir).degrees("CONTAINS", "in")


def stored_follows(spark: SparkSession, sf_dir: str):
    g, store = follows(spark, sf_dir), database(spark).graph()
    store.write(g.nodes, g.edges)
    return store


@query(f"with {FOLLOWS_SQL} select s as source_id, t as target_id, cast(round((case when s = 'u2' then 5 else w end) * 1e6) as bigint) as weight from f where s <> 'u1'")
def graph_edge_removed(spark, sf_dir):
    store = stored_follows(spark, sf_dir)
    out = store.graph().edges.where("source_id = 'u1'")
    store.edge_log.append(out, "D")
    store.edge_log.append(store.graph().edges.where("source_id = 'u2'").withColumn("properties", F.create_map(F.lit("weight"), F.lit("5.0"))))
    return store.graph().edges.select("source_id", "target_id", micro(A.weight("weight")).alias("weight"))


@query(f"with {FOLLOWS_SQL} select s as source_id, t as target_id from f union all select 'u1', 'new'")
def graph_txn_rollback(spark, sf_dir):
    store = stored_follows(spark, sf_dir)
    try:
        with store.transaction() as t:
            t.put_edge("u1", "lost", "FOLLOWS")
            raise KeyError("stop")
    except KeyError:
        pass
    with store.transaction() as t:
        t.put_edge("u2", "lost", "FOLLOWS")
        t.rollback()
    with store.transaction() as t:
        t.put_node("new", ["User"])
        t.put_edge("u1", "new", "FOLLOWS")
    return store.graph().edges.select("source_id", "target_id")


BFS_SQL = f"with recursive {FOLLOWS_SQL}, b as (select 'u0' as id, 0 as depth union select f.t, b.depth + 1 from b join f on f.s = b.id where b.depth < 24) select id, min(depth) as depth from b group by id"


@query(BFS_SQL)
def graph_bfs(spark, sf_dir):
    return A.bfs(follows(spark, sf_dir), "u0", "FOLLOWS")


@query(BFS_SQL)
def graph_bfs_joins(spark, sf_dir):
    """graph_bfs the way that large graphs go."""
    return A.bfs(follows(spark, sf_dir), "u0", "FOLLOWS", local=-1)


@query(f"select id from ({BFS_SQL})")
def graph_dfs_set(spark, sf_dir):
    return A.dfs_table(follows(spark, sf_dir), "u0", "FOLLOWS").select("id")


#: A step visits the top of the stack, and puts its children that aren't seen on what is left of it.
DFS_SQL = f"""with recursive {FOLLOWS_SQL}, c as materialized (select s, list(t order by t) as to_ids from (select distinct s, t from f) group by s),
    d as (select 'u0' as id, 0 as n, ['u0'] as seen, coalesce((select list_filter(to_ids, lambda x: x <> 'u0') from c where s = 'u0'), []::varchar[]) as stack
    union all select id, n, seen, list_filter(coalesce(to_ids, []::varchar[]), lambda x: not list_contains(seen, x)) || list_filter(rest, lambda x: not list_contains(coalesce(to_ids, []::varchar[]), x)) from
    (select stack[1] as id, n + 1 as n, list_append(seen, stack[1]) as seen, stack[2:] as rest, c.to_ids from d left join c on c.s = d.stack[1] where len(d.stack) > 0))
    select id, n as visit_order from d"""


@query(DFS_SQL)
def graph_dfs(spark, sf_dir):
    return A.dfs_table(follows(spark, sf_dir), "u0", "FOLLOWS")


def _min_plus(rounds: int = 16) -> str:
    steps = [FOLLOWS_SQL, "d0 as materialized (select 'u0' as id, 0.0::double as d)"]
    for i in range(rounds):
        steps.append(f"d{i + 1} as materialized (select id, min(d) as d from (select id, d from d{i} union all select f.t, x.d + f.w from d{i} x join f on f.s = x.id) group by id)")
    return f"with {', '.join(steps)} select id, cast(round(d * 1e6) as bigint) as distance from d{rounds}"


@query(_min_plus())
def graph_shortest_path(spark, sf_dir):
    return A.distances(follows(spark, sf_dir), "u0", "FOLLOWS").select("id", micro(F.col("distance")).alias("distance"))


@query(_min_plus())
def graph_shortest_path_joins(spark, sf_dir):
    """graph_shortest_path the way that large graphs go."""
    return A.distances(follows(spark, sf_dir), "u0", "FOLLOWS", local=-1).select("id", micro(F.col("distance")).alias("distance"))


def _rank_sql(rounds: int = 10, d: float = 0.85) -> str:
    steps = [FOLLOWS_SQL, "n as materialized (select distinct concat('u', user_id) as id from events)", "c as materialized (select count(*)::double as n from n)", "o as materialized (select s, count(*) as k from f group by s)"]
    steps.append("r0 as materialized (select id, 1.0 / (select n from c) as r from n)")
    for i in range(rounds):
        sunk = f"(select coalesce(sum(r), 0) from r{i} where id not in (select s from o))"
        steps.append(f"i{i} as materialized (select f.t as id, sum(x.r / o.k) as g from r{i} x join o on o.s = x.id join f on f.s = x.id group by f.t)")
        steps.append(f"r{i + 1} as materialized (select n.id, {1 - d} / (select n from c) + {d} * (coalesce(g, 0) + {sunk} / (select n from c)) as r from n left join i{i} on i{i}.id = n.id)")
    return f"with {', '.join(steps)} select id, cast(round(r * 1e6) as bigint) as rank from r{rounds}"


@query(_rank_sql())
def graph_pagerank(spark, sf_dir):
    g = follows(spark, sf_dir)
    return A.page_rank(g, g.nodes.select("id"), "FOLLOWS").select("id", micro(F.col("rank")).alias("rank"))


@query(_rank_sql())
def graph_pagerank_joins(spark, sf_dir):
    """graph_pagerank the way that large graphs go."""
    g = follows(spark, sf_dir)
    return A.page_rank(g, g.nodes.select("id"), "FOLLOWS", local=-1).select("id", micro(F.col("rank")).alias("rank"))


# Streams.


@query("select user_id, arg_max(event_type, event_id) as event_type, cast(round(arg_max(value, event_id) * 1e6) as bigint) as value from events group by user_id")
def stream_latest(spark, sf_dir):
    """The newest event of each user, by a stream that ends with the data there is."""
    path = f"{shared(spark).rstrip('/')}/strata-stream-{uuid.uuid4().hex}"
    latest = latest_stream(_streamed(spark, sf_dir).select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")

    def keep(rows: DataFrame, n: int) -> None:
        rows.withColumn("_n", F.lit(n)).write.mode("overwrite").parquet(f"{path}/out/_n={n}")

    q = latest.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    got = newest(spark.read.parquet(f"{path}/out").select("user_id", "event_id", "event_type", "value"), ["user_id"], F.col("event_id"))
    return settled(got.select("user_id", "event_type", micro(F.col("value")).alias("value")), "latest")


def _observed(spark: SparkSession, sf_dir: str, watch) -> list:
    """What watch's observer emits over three writes to the parts."""
    coll, seen = part_collection(spark, sf_dir), []
    q = watch(coll, seen, f"{shared(spark).rstrip('/')}/strata-observe-{uuid.uuid4().hex}")
    try:
        coll.insert("Brand#17:1", name="renamed", brand="Brand#17", size=1, price=1.0)
        coll.insert_batch(part_docs(spark, sf_dir).where("size = 3"))
        coll.delete("Brand#17:1")
        q.processAllAvailable()
    finally:
        q.stop()
    return seen


@query("select 0 as n, p_name as name from part where p_partkey = 1 and p_brand = 'Brand#17' union all select 0, null where not exists (select 1 from part where p_partkey = 1 and p_brand = 'Brand#17') union all select 1, 'renamed' union all select 2, null")
def stream_observe_by_id(spark, sf_dir):
    """A document as its observer sees it; the part with its id has another size than those written in between."""
    seen = _observed(spark, sf_dir, lambda c, seen, at: observe_by_id(c, "Brand#17:1", lambda r: seen.append(None if r is None else r["name"]), at, processingTime="0 seconds"))
    return spark.createDataFrame(list(enumerate(seen)), "n int, name string")


@query("with c as (select count(*) as docs, count(*) filter (p_partkey = 1 and p_brand = 'Brand#17') as had from part) select 0 as n, docs from c union all select 1, docs + 1 - had from c union all select 2, docs + 1 - had from c union all select 3, docs - had from c")
def stream_observe_all(spark, sf_dir):
    """How many documents each emission has."""
    seen = _observed(spark, sf_dir, lambda c, seen, at: observe_all(c, lambda df: seen.append(df.count()), at, processingTime="0 seconds"))
    return spark.createDataFrame(list(enumerate(seen)), "n int, docs long")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files."""
    e, path = read(spark, sf_dir, "events"), f"{shared(spark).rstrip('/')}/strata-events-{uuid.uuid4().hex}"
    e.repartition(4, "event_id").write.parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(path)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
