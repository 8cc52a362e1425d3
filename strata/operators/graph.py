"""Property graphs: nodes and directed, typed edges.

A node is (id, labels, properties), an edge (source_id, target_id, type,
properties); both have string properties, and an edge is known by its ends and
type. :class:`Graph` reads any two such tables; :class:`GraphStore` keeps them in
a store, where a transaction writes nodes and edges as one version.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.sources.log import Log, Store

STRINGS = T.MapType(T.StringType(), T.StringType())
NODE = T.StructType().add("id", "string").add("labels", T.ArrayType(T.StringType())).add("properties", STRINGS)
EDGE = T.StructType().add("source_id", "string").add("target_id", "string").add("type", "string").add("properties", STRINGS)
EDGE_KEYS = ["type", "source_id", "target_id"]


class Graph:
    """Reads over two tables."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges, self.spark = nodes, edges, nodes.sparkSession

    def node(self, id: str) -> Row | None:
        return self.nodes.where(F.col("id") == id).first()

    def nodes_by_property(self, label: str, key: str, value: str) -> DataFrame:
        """Nodes that have the label and the value now."""
        return self.nodes.where(F.array_contains("labels", label) & (F.col("properties")[key] == value))

    def of_type(self, type: str) -> DataFrame:
        return self.edges.where(F.col("type") == type)

    def out_edges(self, source: str, type: str) -> DataFrame:
        return self.of_type(type).where(F.col("source_id") == source)

    def in_edges(self, target: str, type: str) -> DataFrame:
        return self.of_type(type).where(F.col("target_id") == target)

    def out_ids(self, source: str, type: str) -> DataFrame:
        return self.out_edges(source, type).select("target_id")

    def in_ids(self, target: str, type: str) -> DataFrame:
        return self.in_edges(target, type).select("source_id")

    def degrees(self, type: str, direction: str = "out") -> DataFrame:
        """(id, degree) of every node with an edge in that direction."""
        end = "source_id" if direction == "out" else "target_id"
        return self.of_type(type).groupBy(F.col(end).alias("id")).agg(F.count("*").alias("degree"))

    def query(self):
        from strata.plans.traversal import Traversal

        return Traversal(self)


class GraphStore:
    """Nodes and edges in a store."""

    def __init__(self, store: Store, name: str = "graph"):
        self.store, self.spark = store, store.spark
        self.node_log, self.edge_log = Log(store, f"{name}-nodes", NODE, ["id"]), Log(store, f"{name}-edges", EDGE, EDGE_KEYS)

    def _nodes(self, nodes: Iterable[tuple[str, Iterable[str], Mapping[str, str]]]) -> DataFrame:
        rows = [(i, sorted(set(labels)), dict(p), n) for n, (i, labels, p) in enumerate(nodes)]
        return self.spark.createDataFrame(rows, T.StructType([*NODE.fields, T.StructField("_at", T.LongType())]))

    def _edges(self, edges: Iterable[tuple[str, str, str, Mapping[str, str]]]) -> DataFrame:
        rows = [(s, t, kind, dict(p), n) for n, (s, t, kind, p) in enumerate(edges)]
        return self.spark.createDataFrame(rows, T.StructType([*EDGE.fields, T.StructField("_at", T.LongType())]))

    def put_node(self, id: str, labels: Iterable[str] = (), properties: Mapping[str, str] | None = None) -> int:
        """Put a node; one that is there is replaced whole."""
        return self.write([(id, labels, properties or {})], [])

    def put_edge(self, source: str, target: str, type: str, properties: Mapping[str, str] | None = None) -> int:
        return self.write([], [(source, target, type, properties or {})])

    def remove_edge(self, source: str, target: str, type: str) -> int:
        return self.edge_log.append(self._edges([(source, target, type, {})]), "D")

    def remove_node(self, *ids: str) -> int:
        """Remove nodes; their edges stay and dangle."""
        return self.node_log.append(self.spark.createDataFrame([(i,) for i in ids], "id string"), "D")

    def write(self, nodes: Iterable[tuple] | DataFrame, edges: Iterable[tuple] | DataFrame) -> int:
        """Put nodes and edges as one version."""
        made = []
        for log, rows, build in ((self.node_log, nodes, self._nodes), (self.edge_log, edges, self._edges)):
            if isinstance(rows, DataFrame):
                made.append(log.stage(rows))
            elif rows := list(rows):
                made.append(log.stage(build(rows), order=F.col("_at")))
        return self.store.publish(made) if made else self.store.version()

    @contextmanager
    def transaction(self):
        """What the block puts is written as one version when it ends, and not at all where it raises or rolls back."""
        t = Transaction()
        try:
            yield t
        except BaseException:
            t.open = False
            raise
        if t.open:
            t.open = False
            self.write(t.nodes, t.edges)

    def graph(self, version: int | None = None) -> Graph:
        """The graph of a version, the newest by default."""
        v = self.store.version() if version is None else version
        return Graph(self.node_log.snapshot(v), self.edge_log.snapshot(v))

    def compact(self) -> int:
        self.node_log.compact()
        return self.edge_log.compact()


class Transaction:
    """Puts that wait; none can be read before the end."""

    def __init__(self):
        self.nodes, self.edges, self.open = [], [], True

    def _check(self) -> None:
        if not self.open:
            raise RuntimeError("this transaction has ended")

    def put_node(self, id: str, labels: Iterable[str] = (), properties: Mapping[str, str] | None = None) -> None:
        self._check()
        self.nodes.append((id, tuple(labels), dict(properties or {})))

    def put_edge(self, source: str, target: str, type: str, properties: Mapping[str, str] | None = None) -> None:
        self._check()
        self.edges.append((source, target, type, dict(properties or {})))

    def rollback(self) -> None:
        """Drop what was put; the block may end, and nothing is written."""
        self._check()
        self.nodes, self.edges, self.open = [], [], False
