"""The fluent traversal: a set of ids that steps along edges.

Every step adds to one lazy plan over ids alone; properties are read only by
:meth:`Traversal.filter_nodes` and :meth:`Traversal.to_nodes`. Ids are a set after
every step. A walk may come back to where it was; ids without a node go on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.graph import Graph


class Traversal:
    """Ids so far; none at first."""

    def __init__(self, graph: Graph, ids: DataFrame | None = None):
        self.graph = graph
        self.ids = ids if ids is not None else graph.spark.createDataFrame([], "id string")

    def starting_with(self, label: str, key: str, value: str) -> Traversal:
        """The nodes that have the label and the property value."""
        return Traversal(self.graph, self.graph.nodes_by_property(label, key, value).select("id"))

    def starting_with_ids(self, *ids: str) -> Traversal:
        return Traversal(self.graph, self.graph.spark.createDataFrame([(i,) for i in sorted(set(ids))], "id string"))

    def _hop(self, type: str, hops: int, here: str, there: str) -> Traversal:
        if hops <= 0:
            raise ValueError("hops must be positive")
        at = self.ids
        for _ in range(hops):
            edges = self.graph.of_type(type).select(F.col(here).alias("id"), F.col(there).alias("_to"))
            at = edges.join(at, "id", "left_semi").select(F.col("_to").alias("id")).distinct()
        return Traversal(self.graph, at)

    def outbound(self, type: str, hops: int = 1) -> Traversal:
        """Where edges of a type lead, in exactly so many steps."""
        return self._hop(type, hops, "source_id", "target_id")

    def inbound(self, type: str, hops: int = 1) -> Traversal:
        """Where edges of a type come from, in exactly so many steps."""
        return self._hop(type, hops, "target_id", "source_id")

    def filter_nodes(self, predicate: Column | Callable[[dict], bool]) -> Traversal:
        """The ids whose node there is and satisfies a Column over id, labels and properties, or a function of these as a dict."""
        nodes = self.graph.nodes.join(self.ids, "id", "left_semi")
        if isinstance(predicate, Column):
            return Traversal(self.graph, nodes.where(predicate).select("id"))
        import pyarrow as pa

        def run(batches):
            for b in batches:
                rows = [{**r, "properties": dict(r["properties"] or ())} for r in b.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([r["id"] for r in rows if predicate(r)], pa.string())], ["id"])

        return Traversal(self.graph, nodes.select("id", "labels", "properties").mapInArrow(run, "id string"))

    def excluding(self, ids: DataFrame) -> Traversal:
        """The ids that are not in a table's column id."""
        return Traversal(self.graph, self.ids.join(ids.select("id"), "id", "left_anti"))

    def to_ids(self) -> DataFrame:
        return self.ids

    def to_nodes(self) -> DataFrame:
        """The nodes of the ids that have one."""
        return self.graph.nodes.join(self.ids, "id", "left_semi")


def two_hops_with_repeats(graph: Graph, starts: DataFrame, type: str) -> DataFrame:
    """(id) of the ends of all two-step walks from starts, one row for each walk."""
    e = graph.of_type(type).select("source_id", "target_id")
    first = e.join(starts.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("_mid"))
    return first.join(e, F.col("_mid") == F.col("source_id")).select(F.col("target_id").alias("id"))
