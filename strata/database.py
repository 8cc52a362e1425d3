"""The entry: a database is a folder on any file system that Spark reads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from strata.functions.serde import Codec
from strata.operators.collection import Collection
from strata.operators.graph import GraphStore
from strata.operators.kv import KeyValues
from strata.operators.vectors import VectorCollection
from strata.sources.log import Store


class Database:
    """Key-value pairs, collections, vectors and a graph in one store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)
        self.kv = KeyValues(self.store)
        self._collections: dict[str, Collection] = {}

    def collection(self, name: str, schema: T.StructType | str | None = None, defaults: Mapping[str, Any] | None = None, required: Sequence[str] = (), codec: Codec | None = None) -> Collection:
        """The collection; without a schema, as it was last opened here."""
        if schema is not None:
            self._collections[name] = Collection(self.store, name, schema, defaults, required, codec)
        return self._collections[name]

    def vectors(self, name: str) -> VectorCollection:
        return VectorCollection(self.store, name)

    def graph(self, name: str = "graph") -> GraphStore:
        return GraphStore(self.store, name)

    def version(self) -> int:
        return self.store.version()

    def drop_all(self) -> None:
        """Delete the whole folder."""
        self.store.drop_all()

    def close(self) -> None:
        """Nothing is held open; for symmetry with `with`."""

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_) -> None:
        self.close()
