"""Graph algorithms: breadth-first and depth-first order, shortest path, PageRank.

Each takes one of two ways to the same result. Where the edges it needs are no
more than LOCAL (checked by reading one row more), they come to the driver as two
integer arrays and numpy does the rounds, as a round of a small graph costs less
than a Spark job. Beyond that every round is a join whose result is written to the
shared folder, which cuts its lineage. Edges that repeat count once.
"""

from __future__ import annotations

import heapq
import os
import tempfile
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.graph import Graph
from strata.sources.lineage import settled, shared

LOCAL = 1_000_000
#: Edges that come to the driver at once beyond LOCAL, and rows that it sends.
STRIP = 1_000_000


def weight(name: str):
    """A numeric edge property; 1 where it is missing or no number."""
    return F.coalesce(F.col("properties")[name].try_cast("double"), F.lit(1.0))


@dataclass
class _Small:
    """Edges as indices into the sorted names."""

    names: np.ndarray
    source: np.ndarray
    target: np.ndarray
    extra: np.ndarray | None

    def number(self, id: str) -> int | None:
        i = int(np.searchsorted(self.names, id))
        return i if i < len(self.names) and self.names[i] == id else None

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Order of edges by (source, target), and each node's first place in it."""
        order = np.lexsort((self.target, self.source))
        return order, np.searchsorted(self.source[order], np.arange(len(self.names) + 1))


def _small(edges: DataFrame, limit: int) -> _Small | None:
    """edges (source_id, target_id[, extra]) on the driver, if there are no more than limit."""
    t = edges.limit(limit + 1).toArrow()
    if len(t) > limit:
        return None
    both = pa.chunked_array([*t["source_id"].chunks, *t["target_id"].chunks], pa.string()).combine_chunks().dictionary_encode()
    names = np.array(both.dictionary.to_pylist(), object)
    order = np.argsort(names, kind="stable") if len(names) else np.zeros(0, int)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    at = place[both.indices.to_numpy()] if len(names) else np.zeros(0, np.int64)
    return _Small(names[order], at[: len(t)], at[len(t) :], t["extra"].to_numpy() if "extra" in t.column_names else None)


def _typed(graph: Graph, type: str) -> DataFrame:
    return graph.of_type(type).select("source_id", "target_id")


def _expandable(graph: Graph, type: str) -> DataFrame:
    """Edges whose both ends are nodes: others are neither seen nor passed."""
    ids = graph.nodes.select("id")
    e = _typed(graph, type).distinct()
    return e.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("source_id", "target_id")


def bfs(graph: Graph, start: str, type: str, local: int = LOCAL) -> DataFrame:
    """(id, depth) of all nodes that start reaches; empty where start isn't a node."""
    spark, out = graph.spark, "id string, depth int"
    if graph.node(start) is None:
        return spark.createDataFrame([], out)
    edges = _expandable(graph, type)
    small = _small(edges, local)
    if small:
        s = small.number(start)
        if s is None:
            return spark.createDataFrame([(start, 0)], out)
        order, first = small.rows()
        target, depth, front, d = small.target[order], np.full(len(small.names), -1), np.array([s]), 0
        depth[s] = 0
        while len(front):
            d += 1
            near = np.unique(np.concatenate([target[first[v] : first[v + 1]] for v in front]))
            front = near[depth[near] < 0]
            depth[front] = d
        at = np.flatnonzero(depth >= 0)
        return spark.createDataFrame(pa.table({"id": pa.array(small.names[at].tolist(), pa.string()), "depth": pa.array(depth[at], pa.int32())}))
    edges = settled(edges, "edges")
    front = seen = settled(spark.createDataFrame([(start, 0)], out), "bfs")
    depth = 0
    while not front.isEmpty():
        depth += 1
        ids = edges.join(front.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("id")).distinct()
        front = settled(ids.join(seen.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth")), "bfs")
        seen = seen.unionByName(front)
    return seen


def _preorder(first: np.ndarray, target: np.ndarray, start: int) -> array:
    """Indices in the order of a depth-first visit; those that v leads to are target[first[v]:first[v + 1]], ascending."""
    to, end, at = memoryview(target), memoryview(first), memoryview(first.copy())
    seen, order, stack = bytearray(len(first)), array("q", [start]), array("q", [start])
    seen[start] = 1
    while stack:
        v = stack[-1]
        for e in range(at[v], end[v + 1]):
            w = to[e]
            if not seen[w]:
                seen[w], at[v] = 1, e + 1
                order.append(w)
                stack.append(w)
                break
        else:
            stack.pop()
    return order


def _numbered(nodes: DataFrame) -> tuple[DataFrame, int]:
    """(id, n): ids by their place in ascending order, from 0; and how many there are."""
    ids = settled(nodes.select("id").where("id is not null").distinct().orderBy("id").withColumn("_m", F.monotonically_increasing_id()), "nodes")
    part = F.shiftrightunsigned("_m", 33)
    sizes = ids.groupBy(part.alias("_part")).agg(F.count("*").alias("size")).orderBy("_part").collect()  # a row for each task that sorted
    before = np.cumsum([0, *(r["size"] for r in sizes)]).tolist()
    firsts = nodes.sparkSession.createDataFrame([(r["_part"], b) for r, b in zip(sizes, before, strict=False)], "_part long, _first long")
    return ids.join(F.broadcast(firsts), part == F.col("_part")).select("id", (F.col("_first") + F.col("_m").bitwiseAND((1 << 33) - 1)).alias("n")), before[-1]


def _rows_on_disk(edges: DataFrame, n: int, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """first and target of _preorder for edges (s, t) of numbers below n; targets are a file in folder, and come STRIP at once."""
    edges = settled(edges, "edges")
    total = edges.count()
    strips = -(-total // STRIP) or 1
    edges = settled(edges.repartitionByRange(strips, "s", "t").withColumn("_strip", F.spark_partition_id()), "strips", "_strip")
    kind = np.int32 if n < 2**31 else np.int64
    first = np.zeros(n + 1, np.int64)
    target = np.memmap(os.path.join(folder, "targets"), kind, "w+", shape=(max(1, total),))
    at = 0
    for i in range(strips):
        t = edges.where(F.col("_strip") == i).select("s", "t").toArrow()
        s, to = t["s"].to_numpy(), t["t"].to_numpy()
        order = np.lexsort((to, s))
        target[at : at + len(order)] = to[order]
        at += len(order)
        if len(s):
            low = int(s.min())
            got = np.bincount(s - low)
            first[low + 1 : low + 1 + len(got)] += got
    return np.cumsum(first), target


def dfs_table(graph: Graph, start: str, type: str, local: int = LOCAL) -> DataFrame:
    """(id, visit order) in pre-order, children by id; empty where start isn't a node.

    The order is sequential by nature, so one walk on the driver makes it. Beyond `local` edges nodes are numbered by id
    in the shared folder and the walk has numbers alone: 33 bytes a node, and edges in a file of the driver.
    """
    spark, out = graph.spark, "id string, visit_order int"
    if graph.node(start) is None:
        return spark.createDataFrame([], out)
    small = _small(_expandable(graph, type), local)
    if small:
        s = small.number(start)
        if s is None:
            return spark.createDataFrame([(start, 0)], out)
        order, first = small.rows()
        at = np.array(_preorder(first, small.target[order], s))
        return spark.createDataFrame(pa.table({"id": pa.array(small.names[at].tolist(), pa.string()), "visit_order": pa.array(np.arange(len(at)), pa.int32())}))
    ids, n = _numbered(graph.nodes)
    ends = _typed(graph, type).join(ids.select(F.col("id").alias("source_id"), F.col("n").alias("s")), "source_id").join(ids.select(F.col("id").alias("target_id"), F.col("n").alias("t")), "target_id")
    visits = f"{shared(spark).rstrip('/')}/strata-visits-{uuid.uuid4().hex}"
    with tempfile.TemporaryDirectory() as folder:
        first, target = _rows_on_disk(ends.select("s", "t").distinct(), n, folder)
        order = _preorder(first, target, ids.where(F.col("id") == start).first()["n"])
        for i in range(0, len(order), STRIP):
            part = np.array(order[i : i + STRIP])
            spark.createDataFrame(pa.table({"n": part, "visit_order": pa.array(np.arange(i, i + len(part)), pa.int32())})).write.mode("append").parquet(visits)
    return spark.read.schema("n long, visit_order int").parquet(visits).join(ids, "n").select("id", "visit_order")


def dfs(graph: Graph, start: str, type: str, local: int = LOCAL) -> Iterator[tuple[str, int]]:
    """The rows of :func:`dfs_table` in order, by one part at a time."""
    for r in dfs_table(graph, start, type, local).orderBy("visit_order").toLocalIterator():
        yield r["id"], r["visit_order"]


def _weighted(graph: Graph, type: str, weight_name: str) -> DataFrame:
    return graph.of_type(type).select("source_id", "target_id", weight(weight_name).alias("extra")).groupBy("source_id", "target_id").agg(F.min("extra").alias("extra"))


def _cheapest(small: _Small, start: str, target: str | None) -> list[tuple[str, float, int, str | None]]:
    """(id, distance, steps, previous) by a priority queue; up to target, if it is reached."""
    if len(small.extra) and np.nanmin(small.extra) < 0:
        raise ValueError("negative weight")
    s = small.number(start)
    if s is None:
        return [(start, 0.0, 0, None)]
    order, first = small.rows()
    to, cost = small.target[order].tolist(), small.extra[order].tolist()
    best, prev, done, heap = {s: (0.0, 0)}, {s: None}, set(), [(0.0, 0, s)]
    goal = None if target is None else small.number(target)
    while heap:
        d, n, v = heapq.heappop(heap)
        if v in done:
            continue
        done.add(v)
        if v == goal:
            break
        for e in range(first[v], first[v + 1]):
            w, way = to[e], (d + cost[e], n + 1)
            if w not in best or way < best[w]:
                best[w], prev[w] = way, v
                heapq.heappush(heap, (*way, w))
            elif way == best[w] and v < prev[w]:
                prev[w] = v
    return [(small.names[v], *best[v], None if prev[v] is None else small.names[prev[v]]) for v in sorted(done)]


def distances(graph: Graph, start: str, type: str, weight_name: str = "weight", local: int = LOCAL, target: str | None = None) -> DataFrame:
    """(id, distance, steps, previous) of the cheapest ways from start; of equally cheap ones that of fewest steps, then of the smallest previous id.

    start itself is at 0. Ends of edges need not be nodes. Negative weights are an error. target: may stop when its way is settled.
    """
    spark, out = graph.spark, "id string, distance double, steps int, previous string"
    own = _weighted(graph, type, weight_name)
    small = _small(own, local)
    if small:
        return spark.createDataFrame(_cheapest(small, start, target), out)
    own = own.withColumn("extra", F.when(F.col("extra") < 0, F.raise_error(F.lit("negative weight")).cast("double")).otherwise(F.col("extra")))
    edges = settled(own, "edges")
    best = changed = settled(spark.createDataFrame([(start, 0.0, 0, None)], out), "paths")
    way = F.struct("distance", "steps")
    while not changed.isEmpty():
        step = edges.join(changed.select(F.col("id").alias("source_id"), "distance", "steps"), "source_id")
        step = step.select(F.col("target_id").alias("id"), F.struct((F.col("distance") + F.col("extra")).alias("distance"), (F.col("steps") + 1).alias("steps"), F.col("source_id").alias("previous")).alias("m"))
        step = step.groupBy("id").agg(F.min("m").alias("m")).select("id", "m.*")
        old = best.select("id", way.alias("_w"), F.col("previous").alias("_p"))
        better = F.col("_w").isNull() | (way < F.col("_w")) | ((way == F.col("_w")) & (F.col("previous") < F.col("_p")))
        found = settled(step.join(old, "id", "left").where(better).select("id", "distance", "steps", "previous", F.coalesce(way < F.col("_w"), F.lit(True)).alias("_far")), "paths")
        best = settled(best.join(found, "id", "left_anti").select("id", "distance", "steps", "previous").unionByName(found.drop("_far")), "paths")
        changed = found.where("_far").drop("_far")
    return best


def shortest_path(graph: Graph, start: str, end: str, type: str, weight_name: str = "weight", local: int = LOCAL) -> list[tuple[str, str, float]] | None:
    """The edges (source, target, distance so far) of the cheapest way; [] from a node to itself, None where there is no way."""
    if start == end:
        return []
    small = _small(_weighted(graph, type, weight_name), local)
    if small:
        way, few = None, {i: (p, d) for i, d, _, p in _cheapest(small, start, end)}
    else:
        way = settled(distances(graph, start, type, weight_name, -1, end), "way")
        rows = way.select("id", "previous", "distance").limit(local + 1).collect() if local > 0 else []
        few = {r["id"]: (r["previous"], r["distance"]) for r in rows} if 0 < len(rows) <= local else None
    out, at = [], end
    while at != start:
        if few is not None:
            row = few.get(at)
        else:  # as many lookups as the way has edges
            row = way.where(F.col("id") == at).select("previous", "distance").first()
        if row is None:
            return None
        out.append((row[0], at, row[1]))
        at = row[0]
    return out[::-1]


def page_rank(graph: Graph, seeds: DataFrame, type: str, iterations: int = 10, damping: float = 0.85, local: int = LOCAL) -> DataFrame:
    """(id, rank) over the seeds and the edges between them; rank of nodes without such edges is shared by all.

    seeds (id) count once each and need not be nodes. Ranks sum to 1.
    """
    spark = graph.spark
    seeds = seeds.select("id").where("id is not null").distinct()
    e = _typed(graph, type).distinct()
    e = e.join(seeds.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(seeds.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("source_id", "target_id")
    few = seeds.limit(local + 1).toArrow()
    small = _small(e, local) if len(few) <= local else None
    if small:
        ids = np.array(sorted(few["id"].to_pylist()), object)
        n = len(ids)
        if not n:
            return spark.createDataFrame([], "id string, rank double")
        at = np.searchsorted(ids, small.names) if len(small.names) else np.zeros(0, np.int64)
        s, t = at[small.source], at[small.target]
        out = np.bincount(s, minlength=n)
        rank = np.full(n, 1.0 / n)
        for _ in range(iterations):
            sunk = rank[out == 0].sum()
            rank = (1 - damping) / n + damping * (np.bincount(t, rank[s] / out[s], n) + sunk / n)
        return spark.createDataFrame(pa.table({"id": pa.array(ids.tolist(), pa.string()), "rank": pa.array(rank)}))
    seeds = settled(seeds, "seeds")
    n = seeds.count()
    if not n:
        return spark.createDataFrame([], "id string, rank double")
    out = e.groupBy("source_id").agg(F.count("*").alias("_out"))
    e = settled(e.join(out, "source_id").select(F.col("source_id").alias("id"), "target_id", "_out"), "edges")
    rank = seeds.select("id", F.lit(1.0 / n).alias("rank"))
    for _ in range(iterations):
        got = e.join(rank, "id").groupBy(F.col("target_id").alias("id")).agg(F.sum(F.col("rank") / F.col("_out")).alias("_in"))
        got = settled(got, "rank")
        sunk = 1.0 - (got.agg(F.sum("_in")).first()[0] or 0.0)  # ranks sum to 1, so what didn't flow was sunk
        rank = settled(seeds.join(got, "id", "left").select("id", (F.lit((1 - damping) / n + damping * sunk / n) + damping * F.coalesce("_in", F.lit(0.0))).alias("rank")), "rank")
    return rank
